"""The distance kernel: fuzzy edit distance between conversations and flow graphs.

A conversation is aligned with the cheapest root-to-leaf path of a flow: a turn without a node costs `insertion`, a node
without a turn `deletion`, a node with a turn `alpha * (d1 + d2)`, where d1 is the cosine distance of the turn to the
node's bucket and d2 that of the bucket to the best bucket of the turn's actor. One row of the dynamic programme is kept
per node and taken as the element-wise minimum over its parents, so paths are never enumerated.

Flows are made ready once each and spread with blocks of conversations: a task holds a bundle of flows and one block, and
treats all nodes of one depth at once, for as many conversations as fit a processor's cache. The insertion chain of a row is
a running minimum (new[j] = j + min over k <= j of a[k] - k).
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowspark.session import Scratch, small_broadcast

#: Cost of an impossible substitution, and the constant edit costs.
IMPOSSIBLE, INSERTION, DELETION, ALPHA = 1e9, 1.0, 1.0, 0.5
EPSILON = 1e-9
ROOT = "__ROOT__"
#: Cells of one turn that are treated at once.
CELLS = 1 << 14


def edit_distance(path: Column, turns: Column, cost) -> Column:
    """Edit distance of two arrays as a higher-order expression; cost(node, turn) is the substitution cost, insertions and deletions cost 1."""
    first = F.transform(F.concat(F.array(F.lit(0)), F.sequence(F.lit(1), F.size(turns))), lambda i: i.cast("double"))
    first = F.when(F.size(turns) > 0, first).otherwise(F.array(F.lit(0.0)))

    def row(old, node):
        start = F.array(F.element_at(old, 1) + DELETION)
        cells = F.zip_with(F.slice(old, 1, F.size(turns)), F.zip_with(F.slice(old, 2, F.size(turns)), turns, lambda o, t: F.struct(o.alias("up"), t.alias("t"))), lambda diag, x: F.least(diag + cost(node, x["t"]), x["up"] + DELETION))
        return F.aggregate(cells, start, lambda acc, c: F.concat(acc, F.array(F.least(c, F.element_at(acc, -1) + INSERTION))))

    return F.element_at(F.aggregate(path, first, row), -1)


def levels(nodes: list[str], parents: list[tuple[str, str]]) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
    """Longest-path level of every node reachable from the root (0: unreachable), and the edges into each level."""
    at = {v: i for i, v in enumerate(nodes)}
    up: dict[int, list[int]] = {}
    down: dict[int, list[int]] = {}
    for p, v in parents:
        i, j = at.get(p, -1) if p != ROOT else -1, at.get(v)
        if j is None or (p != ROOT and i < 0):
            continue
        up.setdefault(j, []).append(i)
        down.setdefault(i, []).append(j)
    # reachable part, then Kahn's order inside it
    seen, todo = set(), [-1]
    while todo:
        for j in down.get(todo.pop(), ()):
            if j not in seen:
                seen.add(j)
                todo.append(j)
    wait = {j: sum(i < 0 or i in seen for i in up[j]) for j in seen}
    level = np.zeros(len(nodes), np.int64)
    ready = [(-1, 0)]
    while ready:
        i, k = ready.pop()
        for j in down.get(i, ()):
            level[j] = max(level[j], k + 1)
            wait[j] -= 1
            if wait[j] == 0:
                ready.append((j, int(level[j])))
    if any(wait.values()):
        raise ValueError("the flow has a cycle")
    rows: list[list[tuple[int, int]]] = [[] for _ in range(int(level.max(initial=0)) + 1)]
    for j in sorted(seen):
        rows[level[j]] += [(i, j) for i in up[j] if i < 0 or i in seen]
    return level, rows


class Flow:
    """A flow ready for scoring: nodes by level with their buckets, and the buckets' centroids by actor."""

    def __init__(self, nodes: list[tuple[str, str]], edges: list[tuple[str, str]], buckets: list[tuple[str, str, np.ndarray]]):
        """nodes (id, bucket), edges (parent, child), buckets (name, actor, centroid) in order of preference."""
        names = [v for v, _ in nodes]
        self.level, self.rows = levels(names, edges)
        at = {b: i for i, (b, _, _) in enumerate(buckets)}
        self.bucket = np.array([at.get(b, -1) for _, b in nodes], np.int64)
        self.actor = np.array([a for _, a, _ in buckets], dtype=object)
        dim = max((len(c) for _, _, c in buckets), default=1)
        self.c = np.array([c if len(c) else np.zeros(dim) for _, _, c in buckets], np.float64).reshape(len(buckets), dim)
        self.norm = np.sqrt((self.c * self.c).sum(1))
        inner = {i for i, _ in (e for r in self.rows for e in r)}
        self.leaves = np.array([j for j in range(len(names)) if self.level[j] > 0 and j not in inner], np.int64)
        self._steps, self.layered = None, True
        self.d2 = 1 - self.c @ self.c.T / (self.norm[:, None] * self.norm[None, :] + EPSILON) if len(buckets) else np.zeros((0, 0))

    def substitution(self, actors: np.ndarray, x: np.ndarray, alpha: float = ALPHA) -> np.ndarray:
        """(bucket, turn) costs; x: turn vectors, zero where there is none."""
        n = len(actors)
        if not len(self.c):
            return np.full((0, n), IMPOSSIBLE)
        same = self.actor[:, None] == actors[None, :]
        d1 = 1 - self.c @ x.T / (self.norm[:, None] * np.sqrt((x * x).sum(1))[None, :] + EPSILON)
        d1 = np.where(same, d1, IMPOSSIBLE)
        best = d1.argmin(0)  # the first bucket wins a tie
        cost = alpha * (d1 + self.d2[:, best])
        return np.where(same, cost, IMPOSSIBLE)

    def score(self, actors: np.ndarray, x: np.ndarray, dwell: float | None = None, alpha: float = ALPHA) -> float:
        """Distance of one conversation; its number of turns if the flow has no leaf. dwell: cost of staying on a node for another turn."""
        return float(self.scores([self.substitution(actors, x, alpha)], dwell)[0])

    def steps(self) -> list[tuple]:
        """Per level: places of the parents, first edge of each child, buckets and leaves' places; in a layered flow places are those of the level before, else those of all nodes in order of level, the root being 0."""
        if self._steps is None:
            parts = [np.array(r, np.int64).reshape(-1, 2) for r in self.rows[1:]]
            self.layered = all((p[:, 0] < 0).all() if k == 0 else (p[:, 0] >= 0).all() and (self.level[p[:, 0]] == k).all() for k, p in enumerate(parts))
            at, done, out = np.zeros(len(self.level) + 1, np.int64), 1, []  # the root is the last node, at place 0
            is_leaf = np.zeros(len(self.level), bool)
            is_leaf[self.leaves] = True
            for e in parts:
                up = at[e[:, 0]]
                order = np.lexsort((up, e[:, 1]))
                child, first = np.unique(e[order, 1], return_index=True)
                if len(child) == len(e):  # one parent each: children in the order of their parents, so that rows are read in order
                    order = np.argsort(up, kind="stable")
                    child, first = e[order, 1], None
                at[child] = np.arange(len(child)) + (0 if self.layered else done)
                done += len(child)
                up = up[order]
                out.append((up, first, self.bucket[child], np.flatnonzero(is_leaf[child])))
            self._steps = out
        return self._steps

    def packed(self) -> bytes:
        """What scores() needs, with two numbers per edge instead of names."""
        width = np.int32 if len(self.level) < 1 << 30 else np.int64
        small = [tuple(None if x is None else x.astype(width) for x in step) for step in self.steps()]
        return pickle.dumps({"c": self.c, "actor": self.actor, "norm": self.norm, "d2": self.d2, "leaves": self.leaves, "layered": self.layered, "_steps": small})

    @classmethod
    def unpacked(cls, data: bytes) -> Flow:
        """A flow from packed(), for scores() and substitution() only."""
        f = cls.__new__(cls)
        f.__dict__.update(pickle.loads(data))
        f._steps = [tuple(None if x is None else x.astype(np.int64) for x in step) for step in f._steps]
        return f

    def together(self) -> int:
        """How many conversations are scored at once, so that a row of the widest level stays in a processor's cache."""
        return max(1, min(64, CELLS // max([1, *(len(b) for _, _, b, _ in self.steps())])))

    def scores(self, subs: list[np.ndarray], dwell: float | None = None) -> np.ndarray:
        """Distances of several conversations, given their (bucket, turn) substitution costs.

        A cell holds the cost less its turn number, so that an insertion costs nothing and a row is a running minimum; cells are laid
        out by turn, node and conversation, so that a node's are copied at once, and the nodes of a level are treated at once. No cell depends on later turns, so shorter
        conversations run along with longer ones and are read at their own last turn.
        """
        size = np.array([sub.shape[1] for sub in subs], np.int64)
        if not len(self.leaves):
            return size.astype(np.float64)
        n, each = int(size.max()), np.arange(len(subs))
        steps, m = self.steps(), len(subs)
        s = np.full((n, len(self.c) + 1, m), IMPOSSIBLE)  # the last: nodes whose bucket is unknown
        for i, sub in enumerate(subs):
            s[: size[i], : len(self.c), i] = sub.T
        stay = np.minimum(0.0, s + (dwell - INSERTION)) if dwell is not None else None
        s -= INSERTION
        old, best = np.zeros((n + 1, 1, m)), np.full(m, np.inf)
        table = None if self.layered else np.zeros((n + 1, 1 + sum(len(b) for _, _, b, _ in steps), m))
        done = 1
        for up, first, bucket, leaf in steps:
            width = len(bucket)
            new = np.empty((n + 1, width, m))
            before = None
            for j in range(n + 1):
                row = old[j] if self.layered else table[j]
                row = row.take(up, axis=0)
                row = row if first is None else np.minimum.reduceat(row, first, axis=0)
                a = np.add(row, DELETION, out=new[j])
                if j:
                    t = s[j - 1].take(bucket, axis=0)
                    t += before
                    np.minimum(a, t, out=a)
                    if stay is None:
                        np.minimum(a, new[j - 1], out=a)
                    else:
                        t = stay[j - 1].take(bucket, axis=0)
                        t += new[j - 1]
                        np.minimum(a, t, out=a)
                before = row
            if len(leaf):
                best = np.minimum(best, new[size, leaf[:, None], each].min(0))
            if self.layered:
                old = new
            else:
                table[:, done : done + width] = new
                done += width
        return best + size * INSERTION


def paths_distance(paths: list[list[int]], sub: np.ndarray, n: int) -> float:
    """The plain form: least edit distance over enumerated paths of bucket numbers (for comparison)."""
    if not paths:
        return float(n)
    best = np.inf
    for p in paths:
        old = [k * INSERTION for k in range(n + 1)]
        for b in p:
            new = [old[0] + DELETION]
            for k in range(n):
                new.append(min(old[k + 1] + DELETION, new[k] + INSERTION, old[k] + (sub[b, k] if b >= 0 else IMPOSSIBLE)))
            old = new
        best = min(best, old[n])
    return float(best)


def _compile(key: tuple, flow: pd.DataFrame) -> pd.DataFrame:
    b = flow[flow["kind"] == "b"].sort_values("ord")
    n = flow[flow["kind"] == "n"]
    one = n.drop_duplicates("node")
    f = Flow(list(zip(one["node"], one["bucket"])), list(zip(n["parent"], n["node"])), [(x, a, np.asarray(c if c is not None else [], np.float64)) for x, a, c in zip(b["bucket"], b["actor"], b["centroid"])])
    return pd.DataFrame([(*key, f.packed())], columns=["flow_id", "flow"])


def _score_block(dwells: tuple[float | None, ...], alpha: float):
    def run(key: tuple, talk: pd.DataFrame, flows: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame(columns=["flow_id", "dialogue_id", "n_turns", "regime", "distance"])]
        talk = talk.sort_values(["dialogue_id", "turn"])
        ids, first, size = np.unique(talk["dialogue_id"].to_numpy(), return_index=True, return_counts=True)
        actors, vectors = talk["actor"].to_numpy(object), talk["vector"].to_numpy(object)
        wanted: dict[str, list[int]] = {}
        for i, names in enumerate(talk["flows"].to_numpy(object)[first]):
            for name in names:
                wanted.setdefault(name, []).append(i)
        for name, packed in zip(flows["flow_id"], flows["flow"]):
            mine = np.array(wanted.get(name, []), np.int64)
            if not len(mine):
                continue
            f = Flow.unpacked(packed)
            dim = f.c.shape[1] if len(f.c) else 1
            zero = np.zeros(dim)
            dist = np.empty((len(dwells), len(mine)))
            order = np.argsort(size[mine], kind="stable")  # conversations of about one length are scored together
            for k in range(0, len(order), step := f.together()):
                some = order[k : k + step]
                turns = np.concatenate([np.arange(i, i + m) for i, m in zip(first[mine[some]], size[mine[some]])])
                x = np.array([v if v is not None and len(v) == dim else zero for v in vectors[turns]], np.float64)
                subs = np.split(f.substitution(actors[turns], x, alpha), np.cumsum(size[mine[some]])[:-1], axis=1)
                for d, dwell in zip(dist, dwells):
                    d[some] = f.scores(subs, dwell)
            out += [pd.DataFrame({"flow_id": name, "dialogue_id": ids[mine], "n_turns": size[mine], "regime": i, "distance": d}) for i, d in enumerate(dist)]
        return pd.concat(out[1:] or out)

    return run


def flow_distances(talk: DataFrame, nodes: DataFrame, centroids: DataFrame, pairs: DataFrame, block: int = 1024, dwell: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """(flow_id, dialogue_id, n_turns, distance) of every pair, as by regime_distances()."""
    return regime_distances(talk, nodes, centroids, pairs, (dwell,), block, alpha).drop("regime")


def regime_distances(talk: DataFrame, nodes: DataFrame, centroids: DataFrame, pairs: DataFrame, dwells: tuple[float | None, ...], block: int = 1024, alpha: float = ALPHA) -> DataFrame:
    """(flow_id, dialogue_id, n_turns, regime, distance) of every pair, once for each of the costs of staying, by their places.

    talk: (dialogue_id, turn, actor, vector); nodes: (flow_id, node, parent, bucket), a node once per parent; centroids:
    (flow_id, bucket, actor, ord, centroid); pairs: (dialogue_id, flow_id[, bundle]), distinct. Flows are made ready once each and
    then hold two numbers per node. Conversations with a bundle in common (without the column, a flow) are scored in blocks of
    about `block` pairs, to which all flows of the bundle go, and the turns of a conversation once; pairs without turns have no
    row. A cycle in a flow is an error.
    """
    tmp = Scratch(talk.sparkSession, "flows")
    if "bundle" not in pairs.columns:
        pairs = pairs.withColumn("bundle", F.col("flow_id"))
    n = nodes.select("flow_id", F.lit("n").alias("kind"), "node", "parent", "bucket", F.lit(None).cast("string").alias("actor"), F.lit(0).cast("long").alias("ord"), F.lit(None).cast("array<double>").alias("centroid"))
    b = centroids.select("flow_id", F.lit("b").alias("kind"), F.lit(None).cast("string").alias("node"), F.lit(None).cast("string").alias("parent"), "bucket", "actor", "ord", "centroid")
    ready = tmp.put(n.unionByName(b).groupBy("flow_id").applyInPandas(_compile, "flow_id string, flow binary"))
    sized = pairs.groupBy("bundle").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("parts"), F.collect_set("flow_id").alias("flows"))  # a bundle has few flows
    sized = small_broadcast(tmp.put(sized))
    p = pairs.groupBy("bundle", "dialogue_id").agg(F.collect_list("flow_id").alias("flows")).join(sized.drop("flows"), "bundle").select("bundle", F.pmod(F.xxhash64("dialogue_id"), "parts").alias("part"), "dialogue_id", "flows")
    left = talk.select("dialogue_id", "turn", "actor", "vector").join(p, "dialogue_id")
    parts = sized.select("bundle", F.explode("flows").alias("flow_id"), "parts").select("bundle", "flow_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    right = ready.join(parts, "flow_id").select("bundle", "part", "flow_id", "flow")
    return left.groupBy("bundle", "part").cogroup(right.groupBy("bundle", "part")).applyInPandas(_score_block(dwells, alpha), "flow_id string, dialogue_id long, n_turns long, regime int, distance double")


class Paths:
    """Distinct label sequences as a prefix tree, level by level, so that shared beginnings are compared once."""

    def __init__(self, paths: list[list[str]]):
        self.number: dict[str, int] = {}
        at: dict[tuple[int, int], int] = {}
        here = [(tuple(self.number.setdefault(x, len(self.number)) for x in p), -1) for p in {tuple(p) for p in paths}]
        self.empty = any(not p for p, _ in here)
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # parent in the level before, label, whether a path ends
        depth, here = 0, [x for x in here if x[0]]
        while here:
            at, parent, label, end, nxt = {}, [], [], [], []
            for p, up in here:
                k = at.setdefault((up, p[depth]), len(at))
                if k == len(parent):
                    parent.append(max(up, 0))
                    label.append(p[depth])
                    end.append(False)
                if len(p) == depth + 1:
                    end[k] = True
                else:
                    nxt.append((p, k))
            self.levels.append((np.array(parent), np.array(label), np.array(end)))
            here, depth = nxt, depth + 1

    def distance(self, labels: list[str], other: float = 2.0) -> float:
        """Least edit distance of labels to any path: insertions and deletions cost one, another label `other`."""
        y = np.array([self.number.get(x, -1) for x in labels], np.int64)
        j = np.arange(len(y) + 1, dtype=np.float64)
        table, best = j[None, :], float(len(y)) if self.empty else np.inf
        for parent, label, end in self.levels:
            old = table[parent]
            a = old + DELETION
            a[:, 1:] = np.minimum(a[:, 1:], old[:, :-1] + np.where(label[:, None] == y[None, :], 0.0, other))
            table = np.minimum.accumulate(a - j * INSERTION, axis=1) + j * INSERTION
            if end.any():
                best = min(best, float(table[end, -1].min()))
        return best


def path_distances(sequences: DataFrame, paths: DataFrame, block: int = 1024) -> DataFrame:
    """(flow_id, dialogue_id, distance): least edit distance of each sequence (flow_id, dialogue_id, labels) to a path (flow_id, labels) of its flow.

    Flows without a path give no row. A flow's paths go to as many tasks as it has blocks of sequences.
    """
    sized = sequences.groupBy("flow_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("long").alias("parts"))
    left = sequences.join(sized, "flow_id").select("flow_id", F.pmod(F.xxhash64("dialogue_id"), "parts").alias("part"), "dialogue_id", "labels")
    known = Scratch(paths.sparkSession, "paths").put(paths.select("flow_id", "labels").distinct())
    right = known.join(sized, "flow_id").select("flow_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "labels")

    def run(key: tuple, s: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(s) or not len(p):
            return pd.DataFrame(columns=["flow_id", "dialogue_id", "distance"])
        tree = Paths([list(x) for x in p["labels"]])
        return pd.DataFrame({"flow_id": key[0], "dialogue_id": s["dialogue_id"], "distance": [tree.distance(list(x)) for x in s["labels"]]})

    by = ["flow_id", "part"]
    return left.groupBy(by).cogroup(right.groupBy(by)).applyInPandas(run, "flow_id string, dialogue_id long, distance double")
