"""Parent-child rows to full hierarchies by distributed tree contraction.

Each round works on all trees at once: leaves are raked (removed, remembering their parent), then an independent set of
nodes in unary chains is compressed into the edge that passes through them (chosen by a hash coin: heads below tails),
which shortens a chain of any length by a constant share per round. An edge remembers the nodes compressed into it. A
node whose own edge leads back to itself stands for a contracted cycle; its loop is removed and it goes on as an
ordinary node. When a round changes nothing, nodes with one parent and several children are merged into it, which
also reduces every tree with additional back edges. What then still has edges is a core that is no tree at all (nodes
with several parents on intertwined cycles); its strongly connected parts are found by colour propagation.

The recorded contractions are reversed to give root, depth, path and descendants. Rounds grow with the logarithm of the
number of nodes; all state lives in shuffled tables, so neither tree size nor tree depth is bounded by a task.

Graphs of at most `local_nodes` node and edge rows are contracted many at a time inside Arrow tasks, by the same rounds
on NumPy arrays; larger graphs take the distributed rounds. Both paths give the same rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.session import Scratch, small_broadcast

#: Status depth of a node on a cycle, and of one below a cycle.
ON_CYCLE, BELOW_CYCLE = -1, -2


def _coin(seed: int, name: str):
    return F.xxhash64(F.lit(seed), F.col("g"), F.col(name)) % 2 == 0


def _rake(e: DataFrame) -> DataFrame:
    """e with whether d has no child."""
    out = e.groupBy("g", F.col("s").alias("d")).agg(F.lit(True).alias("has_child"))
    return e.join(out, ["g", "d"], "left").withColumn("leaf", F.col("has_child").isNull()).drop("has_child")


def contract(s: np.ndarray, d: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tree contraction of the edges s -> d over nodes 0..n-1: root (-1 on and below cycles), depth, and cycle (-1: on none).

    The array form of the distributed rounds; depth counts from the root and is without meaning where root is -1.
    """
    w, bad = np.ones(len(s), np.int64), np.zeros(len(s), bool)  # bad: the edge passes through a node on a cycle
    prio = np.random.default_rng(7).permutation(n)
    loop = np.zeros(n, bool)
    records, merge = [], False
    while len(s):
        turned = s == d
        loop[s[turned]] = True
        s, d, w, bad = s[~turned], d[~turned], w[~turned], bad[~turned]
        _, first, of = np.unique(s * n + d, return_index=True, return_inverse=True)
        some = np.zeros(len(first), bool)
        np.logical_or.at(some, of, bad)
        s, d, w, bad = s[first], d[first], w[first], some
        n_out = np.bincount(s, minlength=n)
        leaf = n_out[d] == 0
        progress = bool(turned.any())
        waits = np.zeros(n, bool)
        waits[s[leaf]] = True
        if leaf.any():
            records.append((d[leaf][::-1], s[leaf][::-1], w[leaf][::-1], bad[leaf][::-1], None))  # in order of s: the smallest parent is written last
            s, d, w, bad = s[~leaf], d[~leaf], w[~leaf], bad[~leaf]
            progress = True
        n_in = np.bincount(d, minlength=n)
        cand = (n_in == 1) & ~waits & ((n_out == 1) | merge) & (n_out > 0)
        rank = np.where(cand, prio, -1)
        child = np.full(n, -1)
        np.maximum.at(child, s, rank[d])
        parent, up, past = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool)
        parent[d], up[d], past[d] = s, w, bad
        chosen = cand & (parent >= 0)
        chosen &= (rank > child) & (rank > np.where(parent >= 0, rank[parent], -1))
        if chosen.any():
            v = np.flatnonzero(chosen)
            from_v = chosen[s]
            records.append((v, parent[v], up[v], past[v], (s[from_v], d[from_v])))
            keep = ~chosen[d]
            s, w, bad = np.where(from_v, parent[s], s), np.where(from_v, w + up[s], w), bad | (from_v & (past[s] | loop[s]))
            s, d, w, bad = s[keep], d[keep], w[keep], bad[keep]
            progress = True
        if not progress and merge:
            break
        merge = not progress
    root, depth, cycle = np.arange(n), np.zeros(n, np.int64), np.where(loop, np.arange(n), -1)
    if len(s):
        _local_core(s, d, w, bad, root, depth, cycle)
    root[cycle >= 0] = -1
    for v, p, k, b, children in reversed(records):
        root[v], depth[v] = root[p], depth[p] + k
        root[v[b | (root[p] < 0)]] = -1
        if children is not None:
            a, c = children
            up = np.full(n, -1)
            up[v] = p
            same = (cycle[c] >= 0) & (cycle[c] == cycle[up[a]])
            cycle[a[same]] = cycle[c[same]]
        root[v[cycle[v] >= 0]] = -1
    return root, depth, cycle


def _local_core(s: np.ndarray, d: np.ndarray, w: np.ndarray, bad: np.ndarray, root: np.ndarray, depth: np.ndarray, cycle: np.ndarray) -> None:
    """States of what cannot be contracted: its cycles by reachability, then what is above and below them."""
    down: dict[int, list[int]] = {}
    for a, b in zip(s.tolist(), d.tolist()):
        down.setdefault(a, []).append(b)

    def reach(a: int) -> set[int]:
        seen, todo = set(), list(down.get(a, ()))
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += down.get(x, ())
        return seen

    near = {a: reach(a) for a in set(s.tolist()) | set(d.tolist())}
    for a, r in near.items():
        if a in r:
            cycle[a] = max(x for x in r if a in near[x])
    below = {x for a, r in near.items() if a in r for x in r}
    for b in set(d[bad].tolist()):
        below |= {b} | near[b]
    up: dict[int, tuple[int, int]] = {}
    for a, b, k in sorted(zip(s.tolist(), d.tolist(), w.tolist()), reverse=True):
        up[b] = (a, k)
    for a in near:
        if cycle[a] >= 0:
            continue
        if a in below:
            root[a] = -1
            continue
        x, k = a, 0
        while x in up:
            k, x = k + up[x][1], up[x][0]
        root[a], depth[a] = x, k


def _local(paths: bool):
    """Contracts all graphs of one bucket; rows are nodes (s null) and edges (v null)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = pdf[pdf["v"].notna()].sort_values(["g", "v"], kind="stable").drop_duplicates(["g", "v"])
        at = pd.MultiIndex.from_arrays([nodes["g"], nodes["v"]])
        e = pdf[pdf["v"].isna()]
        s = at.get_indexer(pd.MultiIndex.from_arrays([e["g"], e["s"]])) if len(e) else np.zeros(0, np.int64)
        d = at.get_indexer(pd.MultiIndex.from_arrays([e["g"], e["d"]])) if len(e) else np.zeros(0, np.int64)
        ok = (s >= 0) & (d >= 0)
        s, d = s[ok], d[ok]
        order = np.lexsort((d, s))
        s, d = s[order].astype(np.int64), d[order].astype(np.int64)
        root, depth, cycle = contract(s, d, len(nodes))
        names = nodes["v"].to_numpy(object)
        out = pd.DataFrame({"dag_id": nodes["g"].to_numpy(), "node_id": names, "root_id": np.where(root < 0, "", names[root]), "depth": np.where(cycle >= 0, ON_CYCLE, np.where(root < 0, BELOW_CYCLE, depth)).astype(np.int32)})
        if paths:
            up = np.full(len(nodes), -1)
            up[d[::-1]] = s[::-1]
            way: list = [None] * len(nodes)
            for i in np.argsort(depth, kind="stable"):
                if root[i] >= 0:
                    way[i] = [names[i]] if up[i] < 0 else [*way[up[i]], names[i]]
            out["path"] = way
        return out

    return run


def hierarchy(spark: SparkSession, nodes: DataFrame, edges: DataFrame, paths: bool = True, local_nodes: int | None = None, bucket_rows: int | None = None) -> DataFrame:
    """Root, depth and path of every node of every graph.

    nodes: (dag_id, node_id, ...), edges: (dag_id, src, dst, ...); further columns are ignored whatever their names.
    Result: (dag_id, node_id, root_id, depth) and, with paths, path (array of node ids from the root to the node).
    A node on a cycle, self-edges included: root_id '', depth -1, path null; a node below one: '', -2, null.
    Null ids and edges with a null or unknown end are ignored, repeated rows count once, ids are compared without
    surrounding blanks; empty tables give an empty result. A node with several parents outside any cycle follows its
    smallest parent when it is raked.
    Graphs of at most local_nodes rows are contracted in tasks of about bucket_rows rows, larger ones by all executors. As a
    chain has half the square of its length in path elements, fewer rows share a task if paths are wanted.
    """
    local_nodes, bucket_rows = local_nodes or (4_000 if paths else 50_000), bucket_rows or (20_000 if paths else 100_000)
    n = nodes.select(F.col("dag_id").alias("g"), F.trim("node_id").alias("v")).where("g is not null and v is not null")
    e = edges.select(F.col("dag_id").alias("g"), F.trim("src").alias("s"), F.trim("dst").alias("d")).where("g is not null and s is not null and d is not null")
    sizes = n.select("g").unionByName(e.select("g")).groupBy("g").agg(F.count(F.lit(1)).alias("k"))
    total, large = sizes.agg(F.sum("k"), F.count_if(F.col("k") > local_nodes)).first()
    if large == 0:
        return _locally(n, e, total or 0, paths, bucket_rows)
    big = small_broadcast(Scratch(spark, "hierarchy").put(sizes.where(F.col("k") > local_nodes).select("g")))
    far = distributed(spark, n.join(big, "g", "left_semi"), e.join(big, "g", "left_semi"), paths)
    return far.unionByName(_locally(n.join(big, "g", "left_anti"), e.join(big, "g", "left_anti"), total, paths, bucket_rows))


def _locally(n: DataFrame, e: DataFrame, total: int, paths: bool, bucket_rows: int) -> DataFrame:
    """Graphs whole within hash buckets; a bucket holds many graphs, none larger than the local limit."""
    none = F.lit(None).cast("string")
    rows = n.select("g", "v", none.alias("s"), none.alias("d")).unionByName(e.select("g", none.alias("v"), "s", "d"))
    buckets = total // bucket_rows + 1
    schema = "dag_id long, node_id string, root_id string, depth int" + ", path array<string>" * paths
    return rows.groupBy(F.pmod(F.xxhash64("g"), F.lit(buckets)).alias("_b")).applyInPandas(_drop_bucket(_local(paths)), schema)


def _drop_bucket(f):
    return lambda pdf: f(pdf[["g", "v", "s", "d"]])


def distributed(spark: SparkSession, nodes: DataFrame, edges: DataFrame, paths: bool = True, max_rounds: int = 400) -> DataFrame:
    """hierarchy() of (g, v) and (g, s, d) by rounds over shuffled tables, for graphs of any size."""
    tmp = Scratch(spark, "hierarchy")
    all_nodes = tmp.put(nodes.distinct())
    e = edges.distinct().join(all_nodes.select("g", F.col("v").alias("s")), ["g", "s"], "left_semi").join(all_nodes.select("g", F.col("v").alias("d")), ["g", "d"], "left_semi")
    e = tmp.put(e.select("g", "s", "d", F.array().cast("array<string>").alias("via") if paths else F.lit(0).alias("via"), F.lit(False).alias("bad")))
    between = (lambda a, m, b: F.concat(a, F.array(m), b)) if paths else (lambda a, m, b: a + b + 1)
    records: list[tuple[DataFrame, DataFrame | None]] = []
    loops: list[DataFrame] = []
    merge = False
    for r in range(max_rounds):
        live = e.where("s <> d")
        raked = _rake(live)
        kept = raked.where("not leaf").drop("leaf")
        incoming = kept.groupBy("g", "d").agg(F.count(F.lit(1)).alias("n_in"), F.min("s").alias("p"), F.min("via").alias("p_via"), F.max("bad").alias("p_bad"))
        outgoing = raked.groupBy("g", F.col("s").alias("d")).agg(F.count(F.lit(1)).alias("n_out"), F.count_if("leaf").alias("n_leaf"))
        # a node with a leaf below it waits: the leaf goes first, so no two records of a round depend on each other
        one = incoming.where("n_in = 1").join(outgoing.where("n_leaf = 0" if merge else "n_leaf = 0 and n_out = 1"), ["g", "d"])
        chosen = one.where(_coin(r, "d") & ~_coin(r, "p")).select("g", F.col("d").alias("v"), "p", "p_via", "p_bad")
        if loops:
            chosen = chosen.join(_union(loops).distinct().withColumn("on", F.lit(True)), ["g", "v"], "left").withColumn("p_on", F.coalesce("p_bad", F.lit(False)) | F.coalesce("on", F.lit(False))).drop("on")
        else:
            chosen = chosen.withColumn("p_on", F.col("p_bad"))
        into = chosen.select("g", F.col("v").alias("d"), F.lit(True).alias("gone"))
        chosen = chosen.drop("p_bad")
        moved = kept.join(chosen.withColumnRenamed("v", "s"), ["g", "s"], "left").join(into, ["g", "d"], "left")
        moved = moved.select(
            "g", F.coalesce("p", "s").alias("s"), "d",
            F.when(F.col("p").isNotNull(), between(F.col("p_via"), F.col("s"), F.col("via"))).otherwise(F.col("via")).alias("via"), (F.col("bad") | F.coalesce("p_on", F.lit(False))).alias("bad"),
            F.when(F.col("gone"), F.lit("merged")).when(F.col("p").isNotNull(), F.lit("passed")).otherwise(F.lit("edge")).alias("kind"),
            F.when(F.col("p").isNotNull(), F.col("s")).alias("mid"),
        )
        none = F.lit(None).cast("string").alias("mid")
        leaves = raked.where("leaf").select("g", "s", "d", "via", "bad", F.lit("leaf").alias("kind"), none)
        turned = e.where("s = d").select("g", "s", "d", "via", "bad", F.lit("loop").alias("kind"), none)
        step = tmp.put(moved.unionByName(leaves).unionByName(turned))
        n = {k: c for k, c in step.groupBy("kind").count().collect()}  # at most five rows
        if n.get("loop"):
            loops.append(step.where("kind = 'loop'").select("g", F.col("d").alias("v")))
        e = step.where("kind in ('edge', 'passed')").groupBy("g", "s", "d").agg(F.min("via").alias("via"), F.max("bad").alias("bad"))
        if n.get("leaf") or n.get("merged"):
            record = step.where("kind in ('leaf', 'merged')").select("g", F.col("d").alias("v"), F.col("s").alias("p"), "via", "bad")
            children = step.where("kind = 'passed'").select("g", F.col("mid").alias("v"), F.col("d").alias("c"))
            records.append((record, children if n.get("passed") else None))
            merge = False
        elif not n.get("edge") and not n.get("passed"):
            break
        elif merge and not n.get("loop") and one.isEmpty():
            break
        else:
            merge = True
    core = e.where("s <> d") if not e.isEmpty() else None
    seen = _survivors(all_nodes, records, tmp)
    cyc = _union(loops) if loops else None
    if core is not None and not core.isEmpty():
        cyc_core = _core_cycles(core, tmp)
        cyc = cyc_core.select("g", "v") if cyc is None else cyc.unionByName(cyc_core.select("g", "v"))
        done = _core_states(seen, core, cyc_core, paths, tmp)
    else:
        own = F.array("v") if paths else F.lit(0)
        done = seen.select("g", "v", F.col("v").alias("root"), own.alias("at"), F.lit(None).cast("string").alias("scc"))
    if cyc is not None:
        cyc = tmp.put(cyc.distinct())
        done = done.join(cyc.withColumn("self", F.lit(True)), ["g", "v"], "left")
        done = done.select("g", "v", F.when(F.col("self"), "").otherwise(F.col("root")).alias("root"), "at", F.coalesce("scc", F.when(F.col("self"), F.col("v"))).alias("scc"))
    done = tmp.put(done)
    parts = [done]
    for record, children in reversed(records):
        up = done.select("g", F.col("v").alias("p"), F.col("root").alias("p_root"), F.col("at").alias("p_at"), F.col("scc").alias("p_scc"))
        x = record.join(up, ["g", "p"])
        # a leaf with several parents follows the smallest, and is below a cycle if any of them is
        x = x.groupBy("g", "v").agg(F.max(F.col("bad") | (F.col("p_root") == "")).alias("low"), F.min(F.struct("p", "via", "p_root", "p_at", "p_scc")).alias("m")).select("g", "v", "low", "m.*")
        x = x.withColumn("p_root", F.when(F.col("low"), "").otherwise(F.col("p_root"))).drop("low")
        at = F.concat("p_at", "via", F.array("v")) if paths else F.col("p_at") + F.col("via") + 1
        if cyc is None:
            x = x.select("g", "v", F.col("p_root").alias("root"), at.alias("at"), F.lit(None).cast("string").alias("scc"))
        else:
            back = F.lit(None).cast("string")
            if children is not None:
                ends = done.select("g", F.col("v").alias("c"), F.col("scc").alias("c_scc")).where("c_scc is not null")
                near = children.join(ends, ["g", "c"]).select("g", "v", "c_scc").distinct()
                x = x.join(near, (x.g == near.g) & (x.v == near.v) & (x.p_scc == near.c_scc), "left").select(x["*"], near.c_scc)
                back = F.col("c_scc")
            x = x.join(cyc.withColumn("self", F.lit(True)), ["g", "v"], "left")
            scc = F.coalesce(back, F.when(F.col("self"), F.col("v")))
            x = x.select("g", "v", F.when(scc.isNotNull(), "").otherwise(F.col("p_root")).alias("root"), at.alias("at"), scc.alias("scc"))
        parts.append(tmp.put(x))
        done = done.unionByName(parts[-1])
    depth = F.size("at") - 1 if paths else F.col("at")
    bad = F.col("root") == ""
    got = done.select(
        F.col("g").alias("dag_id"), F.col("v").alias("node_id"), F.col("root").alias("root_id"),
        F.when(F.col("scc").isNotNull(), ON_CYCLE).when(bad, BELOW_CYCLE).otherwise(depth).cast("int").alias("depth"),
        *([F.when(~bad, F.col("at")).alias("path")] if paths else []),
    )
    return got


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def _survivors(n: DataFrame, records: list, tmp: Scratch) -> DataFrame:
    gone = None
    for record, _ in records:
        x = record.select("g", "v")
        gone = x if gone is None else gone.unionByName(x)
    return n if gone is None else n.join(gone, ["g", "v"], "left_anti")


def _reach(start: DataFrame, step: DataFrame, tmp: Scratch) -> DataFrame:
    """start (g, v, colour) with what is reached over step (g, v, w) as long as colours agree."""
    seen = front = tmp.put(start)
    while not front.isEmpty():
        nxt = front.join(step, ["g", "v"]).select("g", F.col("w").alias("v"), "colour").distinct()
        front = tmp.put(nxt.join(seen, ["g", "v", "colour"], "left_anti"))
        seen = tmp.put(seen.unionByName(front))
    return seen


def _core_cycles(core: DataFrame, tmp: Scratch) -> DataFrame:
    """(g, v, scc) of the nodes on cycles of an irreducible core: largest colours flow forward, their owners look back."""
    left, found = tmp.put(core.select("g", "s", "d").distinct()), None
    while not left.isEmpty():
        col = tmp.put(left.select("g", F.col("s").alias("v")).union(left.select("g", "d")).distinct().withColumn("c", F.col("v")))
        while True:
            got = left.join(col.withColumnRenamed("v", "s"), ["g", "s"]).select("g", F.col("d").alias("v"), "c")
            new = tmp.put(col.unionByName(got).groupBy("g", "v").agg(F.max("c").alias("c")))
            if new.join(col, ["g", "v", "c"], "left_anti").isEmpty():
                break
            col = new
        inside = left.join(col.select("g", F.col("v").alias("s"), F.col("c").alias("cs")), ["g", "s"]).join(col.select("g", F.col("v").alias("d"), F.col("c").alias("cd")), ["g", "d"]).where("cs = cd")
        back = inside.select("g", F.col("d").alias("v"), F.col("s").alias("w"))
        comp = _reach(col.where("v = c").select("g", "v", F.col("c").alias("colour")), back, tmp)
        big = comp.groupBy("g", "colour").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
        part = tmp.put(comp.join(big, ["g", "colour"], "left_semi").select("g", "v", F.col("colour").alias("scc")))
        found = part if found is None else found.unionByName(part)
        gone = comp.select("g", "v")
        left = tmp.put(left.join(gone.withColumnRenamed("v", "s"), ["g", "s"], "left_anti").join(gone.withColumnRenamed("v", "d"), ["g", "d"], "left_anti"))
    return tmp.put(found)


def _core_states(seen: DataFrame, core: DataFrame, cyc: DataFrame, paths: bool, tmp: Scratch) -> DataFrame:
    """States of the nodes left with a core: its cycles, what lies below them, and trees above them, level by level."""
    seen = tmp.put(seen)
    on = cyc.select("g", "v", F.lit("").alias("root"), (F.array("v") if paths else F.lit(0)).alias("at"), "scc")
    heads = core.select("g", F.col("d").alias("v")).distinct()
    roots = seen.join(heads, ["g", "v"], "left_anti").join(cyc, ["g", "v"], "left_anti")
    done = tmp.put(on.unionByName(roots.select("g", "v", F.col("v").alias("root"), (F.array("v") if paths else F.lit(0)).alias("at"), F.lit(None).cast("string").alias("scc"))))
    todo = tmp.put(seen.join(done, ["g", "v"], "left_anti"))
    while not todo.isEmpty():
        into = core.join(todo.withColumnRenamed("v", "d"), ["g", "d"], "left_semi")
        up = done.select("g", F.col("v").alias("s"), "root", "at")
        known = into.join(up, ["g", "s"], "left").groupBy("g", F.col("d").alias("v")).agg(
            F.count_if(F.col("root").isNull()).alias("open"), F.max(F.col("root") == "").alias("low"), F.max("bad").alias("past"), F.min(F.struct("s", "root", "at", "via")).alias("m"))
        at = F.concat("m.at", "m.via", F.array("v")) if paths else F.col("m.at") + F.col("m.via") + 1
        ready = known.where("open = 0").select("g", "v", F.when(F.col("low") | F.col("past"), "").otherwise(F.col("m.root")).alias("root"), at.alias("at"), F.lit(None).cast("string").alias("scc"))
        done = tmp.put(done.unionByName(ready))
        todo = tmp.put(todo.join(done, ["g", "v"], "left_anti"))
    return done


def descendants(tree: DataFrame) -> DataFrame:
    """(dag_id, node_id, descendant_id, distance) for every node above another, from the paths of hierarchy()."""
    t = tree.where("path is not null").select("dag_id", F.col("node_id").alias("descendant_id"), F.posexplode("path").alias("pos", "node_id"), "depth")
    return t.where("pos < depth").select("dag_id", "node_id", "descendant_id", (F.col("depth") - F.col("pos")).alias("distance"))


def descendant_counts(tree: DataFrame) -> DataFrame:
    """tree with n_descendants (0 for leaves, null on and below cycles)."""
    n = descendants(tree).groupBy("dag_id", "node_id").agg(F.count(F.lit(1)).alias("n"))
    return tree.join(n, ["dag_id", "node_id"], "left").withColumn("n_descendants", F.when(F.col("root_id") != "", F.coalesce("n", F.lit(0)))).drop("n")
