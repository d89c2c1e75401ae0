"""Dialogue-flow graphs: prefix tries, task definitions, buckets and centroids, leaves and paths, repairs and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.vectors import mean_vectors, norm, normalised
from flowspark.session import Scratch

ROOT = "__ROOT__"
#: Separates the steps of a prefix.
STEP = "|"


def bucket_name(actor="actor", label="label"):
    return F.concat(F.substring(actor, 1, 1), F.lit(":"), F.col(label))


def training_turns(turns: DataFrame, sides: DataFrame) -> DataFrame:
    """Turns of training dialogues with flow_id = corpus:stratum."""
    s = sides.where("side = 'train'").select("dialogue_id", F.concat_ws(":", "corpus", "stratum").alias("flow_id"))
    return turns.join(s, "dialogue_id")


def trie(train: DataFrame) -> DataFrame:
    """Prefix-trie nodes (flow_id, node, parent, bucket, depth, n_dialogues); node is the joined prefix, parent of depth 1 the root.

    Prefixes run along a dialogue in one window; equal prefixes of different dialogues meet in one partially aggregated count.
    """
    w = Window.partitionBy("flow_id", "dialogue_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    steps = F.collect_list(bucket_name()).over(w)
    p = train.select("flow_id", "dialogue_id", steps.alias("s"))
    n = p.select("flow_id", F.array_join("s", STEP).alias("node"), F.when(F.size("s") == 1, ROOT).otherwise(F.array_join(F.slice("s", 1, F.size("s") - 1), STEP)).alias("parent"), F.element_at("s", -1).alias("bucket"), F.size("s").cast("long").alias("depth"))
    return n.groupBy("flow_id", "node", "parent", "bucket", "depth").agg(F.count(F.lit(1)).alias("n_dialogues"))


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes that are nobody's parent."""
    return nodes.join(nodes.select("flow_id", F.col("parent").alias("node")).distinct(), ["flow_id", "node"], "left_anti")


def trie_paths(nodes: DataFrame) -> DataFrame:
    """(flow_id, path): the root-to-leaf paths, which in a trie are the leaves' own prefixes."""
    return leaves(nodes).select("flow_id", F.split("node", r"\|").alias("path"))


def buckets(train: DataFrame) -> DataFrame:
    """(flow_id, bucket, actor, label, ord, n_utterances, texts): one bucket per actor and label of a flow.

    texts are distinct, in order of first appearance; ord orders the buckets of a flow by theirs.
    """
    seen = train.groupBy("flow_id", "actor", "label", "text").agg(F.min(F.struct("dialogue_id", "turn")).alias("at"), F.count(F.lit(1)).alias("n"))
    b = seen.groupBy("flow_id", "actor", "label").agg(F.min("at").alias("first"), F.sum("n").alias("n_utterances"), F.sort_array(F.collect_list(F.struct("at", "text"))).alias("t"))
    b = b.withColumn("ord", F.row_number().over(Window.partitionBy("flow_id").orderBy("first")).cast("long"))
    return b.select("flow_id", bucket_name().alias("bucket"), "actor", "label", "ord", "n_utterances", F.col("t.text").alias("texts"))


def centroids(train: DataFrame) -> DataFrame:
    """(flow_id, bucket, actor, label, ord, centroid): unit mean of the vectors of a bucket's utterances; a zero mean stays zero, buckets without vectors have none."""
    m = mean_vectors(train, ["flow_id", "actor", "label"], "vector", "mean")
    first = train.groupBy("flow_id", "actor", "label").agg(F.min(F.struct("dialogue_id", "turn")).alias("first"))
    o = first.withColumn("ord", F.row_number().over(Window.partitionBy("flow_id").orderBy("first")).cast("long")).drop("first")
    return m.join(o, ["flow_id", "actor", "label"]).select("flow_id", bucket_name().alias("bucket"), "actor", "label", "ord", F.when(norm(F.col("mean")) > 0, normalised(F.col("mean"))).otherwise(F.col("mean")).alias("centroid"))


def task_flow(replies: DataFrame) -> DataFrame:
    """Edges of a task definition (task, state, next map): roots are states nobody leads to, or the first state if there is none."""
    e = replies.select("task", F.explode(F.map_entries("next")).alias("e")).select("task", F.col("e.key").alias("src"), F.col("e.value").alias("dst"))
    starts = e.select("task", F.col("src").alias("dst")).distinct().join(e.select("task", "dst").distinct(), ["task", "dst"], "left_anti")
    none = e.groupBy("task").agg(F.min("src").alias("dst")).join(starts.select("task").distinct(), "task", "left_anti")
    roots = starts.unionByName(none).select("task", F.lit(ROOT).alias("src"), "dst")
    return e.unionByName(roots)


def known_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges both of whose ends are nodes and that are no loops."""
    n = nodes.select("dag_id", "node_id").distinct()
    e = edges.where("src <> dst").select("dag_id", "src", "dst").distinct()
    return e.join(n.withColumnRenamed("node_id", "src"), ["dag_id", "src"], "left_semi").join(n.withColumnRenamed("node_id", "dst"), ["dag_id", "dst"], "left_semi")


def excise(edges: DataFrame, nodes: DataFrame, empty: DataFrame) -> DataFrame:
    """Edges (dag_id, src, dst) after the empty nodes are bridged by their parents and children; nodes left without a parent hang on the root.

    Reachability through empty nodes is closed by doubling: a round squares the length of the bridges covered.
    """
    spark = edges.sparkSession
    tmp = Scratch(spark, "excise")
    gone = tmp.put(empty.select("dag_id", "node_id").distinct())
    e = tmp.put(edges.select("dag_id", "src", "dst").distinct())
    inner = e.join(gone.withColumnRenamed("node_id", "src"), ["dag_id", "src"], "left_semi")
    reach = tmp.put(inner.join(gone.withColumnRenamed("node_id", "dst"), ["dag_id", "dst"], "left_semi").select("dag_id", "src", "dst"))
    while not reach.isEmpty():
        step = reach.join(reach.select("dag_id", F.col("src").alias("dst"), F.col("dst").alias("far")), ["dag_id", "dst"]).select("dag_id", "src", F.col("far").alias("dst"))
        new = tmp.put(reach.unionByName(step).distinct())
        if new.count() == reach.count():
            break
        reach = new
    into = e.join(gone.withColumnRenamed("node_id", "dst"), ["dag_id", "dst"], "left_semi").join(gone.withColumnRenamed("node_id", "src"), ["dag_id", "src"], "left_anti").select("dag_id", F.col("src").alias("p"), F.col("dst").alias("m"))
    out = inner.join(gone.withColumnRenamed("node_id", "dst"), ["dag_id", "dst"], "left_anti").select("dag_id", F.col("src").alias("m"), F.col("dst").alias("c"))
    hop = reach.select("dag_id", F.col("src").alias("m"), F.col("dst").alias("k")).unionByName(gone.select("dag_id", F.col("node_id").alias("m"), F.col("node_id").alias("k")))
    bridge = into.join(hop, ["dag_id", "m"]).join(out.withColumnRenamed("m", "k"), ["dag_id", "k"]).where("p <> c").select("dag_id", F.col("p").alias("src"), F.col("c").alias("dst"))
    kept = e.join(gone.withColumnRenamed("node_id", "src"), ["dag_id", "src"], "left_anti").join(gone.withColumnRenamed("node_id", "dst"), ["dag_id", "dst"], "left_anti")
    full = tmp.put(kept.unionByName(bridge).distinct())
    left = nodes.select("dag_id", "node_id").distinct().join(gone, ["dag_id", "node_id"], "left_anti")
    roots = left.join(full.select("dag_id", F.col("dst").alias("node_id")), ["dag_id", "node_id"], "left_anti").select("dag_id", F.lit(ROOT).alias("src"), F.col("node_id").alias("dst"))
    return full.unionByName(roots)


def dag_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per graph: nodes, edges, user, agent and other nodes, unlabelled nodes, edges between nodes of one actor, loops."""
    n = nodes.groupBy("dag_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("actor") == "user").alias("n_user"), F.count_if(F.col("actor") == "agent").alias("n_agent"), F.count_if(F.col("actor").isNull()).alias("n_unknown"), F.count_if(F.coalesce("label", F.lit("")) == "").alias("n_unlabelled"))
    a = nodes.select("dag_id", "node_id", "actor")
    x = edges.join(a.withColumnsRenamed({"node_id": "src", "actor": "sa"}), ["dag_id", "src"]).join(a.withColumnsRenamed({"node_id": "dst", "actor": "da"}), ["dag_id", "dst"])
    e = x.groupBy("dag_id").agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("sa") == F.col("da")).alias("n_same_actor"), F.count_if(F.col("src") == F.col("dst")).alias("n_loops"))
    return n.join(e, "dag_id", "left").fillna(0, ["n_edges", "n_same_actor", "n_loops"])


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dag_id, node_id, component): the smallest node of those connected by edges in either direction.

    Every round takes the smallest name among the neighbours and then that name's own, so rounds grow with the logarithm of the
    longest way, not with the way.
    """
    tmp = Scratch(nodes.sparkSession, "weak")
    e = edges.select("dag_id", "src", "dst")
    e = tmp.put(e.unionByName(e.select("dag_id", F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    c = tmp.put(nodes.select("dag_id", "node_id").distinct().withColumn("component", F.col("node_id")))
    while True:
        near = e.join(c.withColumnRenamed("node_id", "src"), ["dag_id", "src"]).select("dag_id", F.col("dst").alias("node_id"), "component")
        # a name that a node takes is offered to the name the node had, too
        offer = near.join(c.withColumnRenamed("component", "had"), ["dag_id", "node_id"]).select("dag_id", F.col("had").alias("node_id"), "component")
        new = tmp.put(c.unionByName(near).unionByName(offer).groupBy("dag_id", "node_id").agg(F.min("component").alias("component")).join(nodes.select("dag_id", "node_id").distinct(), ["dag_id", "node_id"], "left_semi"))
        up = new.select("dag_id", F.col("node_id").alias("component"), F.col("component").alias("top"))
        new = tmp.put(new.join(up, ["dag_id", "component"]).select("dag_id", "node_id", F.col("top").alias("component")))
        if new.join(c, ["dag_id", "node_id", "component"], "left_anti").isEmpty():
            return new
        c = new


def dag_validity(tree: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(dag_id, acyclic, n_roots, n_on_cycle, n_components, alternates, actors_known, ok) of every graph; tree is hierarchy() of it.

    n_components counts weak components, of which a valid graph has one. Cycles are not enumerated, their number can grow
    exponentially: the nodes on any are counted. A graph without nodes has no row.
    """
    ends = tree.select("dag_id", "node_id").distinct()
    inner = edges.join(ends.withColumnRenamed("node_id", "src"), ["dag_id", "src"], "left_semi").join(ends.withColumnRenamed("node_id", "dst"), ["dag_id", "dst"], "left_semi")
    parts = weak_components(ends, inner).groupBy("dag_id").agg(F.countDistinct("component").alias("n_components"))
    c = tree.groupBy("dag_id").agg((F.count_if(F.col("depth") == -1) == 0).alias("acyclic"), F.count_if(F.col("depth") == 0).alias("n_roots"), F.count_if(F.col("depth") == -1).alias("n_on_cycle"))
    s = dag_stats(nodes, edges).select("dag_id", (F.col("n_same_actor") == 0).alias("alternates"), (F.col("n_unknown") == 0).alias("actors_known"))
    r = c.join(parts, "dag_id").join(s, "dag_id")
    return r.withColumn("ok", F.col("acyclic") & (F.col("n_components") <= 1) & F.col("alternates") & F.col("actors_known"))
