"""Labels and clusters: alignment to anchors, fallback labels, taxonomies, chunked labels, caches, verdicts, clustering."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.functions.vectors import EPSILON, cosine_distance, mean_vectors, normalised
from flowspark.session import BROADCAST_BYTES, Scratch, small_broadcast
from flowspark.sources.tables import squashed

#: Length of a taxonomy version, hexadecimal digits.
VERSION_DIGITS = 16


def canonical_json(value: object) -> str:
    """JSON with sorted keys and non-ASCII characters kept: the text that versions and cache keys are hashes of."""
    return json.dumps(value, sort_keys=True, ensure_ascii=False)


def taxonomy_version(taxonomy: DataFrame) -> DataFrame:
    """(corpus, version): digest of the canonical JSON of each corpus's labels by actor; a changed label, description or order changes it."""
    quote = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    entry = F.concat(F.lit('{"description": '), quote("description"), F.lit(', "label": '), quote("label"), F.lit("}"))
    t = taxonomy.groupBy("corpus", "actor").agg(F.sort_array(F.collect_list(F.struct("ord", entry.alias("e")))).alias("t"))
    t = t.select("corpus", F.struct("actor", F.concat(quote("actor"), F.lit(": ["), F.array_join("t.e", ", "), F.lit("]")).alias("part")).alias("p"))
    t = t.groupBy("corpus").agg(F.sort_array(F.collect_list("p")).alias("p"))
    return t.select("corpus", F.substring(F.sha2(F.concat(F.lit("{"), F.array_join("p.part", ", "), F.lit("}")), 256), 1, VERSION_DIGITS).alias("version"))


def cache_key(model: Column, stage: Column, payload: Column) -> Column:
    """Content address of a labelling call."""
    return F.sha2(F.concat_ws("\n", model, stage, payload), 256)


def cached_calls(calls: DataFrame, cache: DataFrame, labeler: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> DataFrame:
    """(key, response, hit): answers of calls (key, payload) from the cache (key, response), else from the labeler, once per distinct key."""
    c = calls.groupBy("key").agg(F.min("payload").alias("payload"))
    hit = c.join(cache.select("key", "response"), "key").select("key", "response", F.lit(True).alias("hit"))
    miss = c.join(cache.select("key"), "key", "left_anti").mapInPandas(labeler, "key string, response string")
    return hit.unionByName(miss.withColumn("hit", F.lit(False)))


def dedupe_taxonomy(taxonomy: DataFrame) -> DataFrame:
    """First occurrence (by ord) of every label spelling per corpus and actor."""
    g = taxonomy.groupBy("corpus", "actor", squashed("label").alias("k")).agg(F.min(F.struct("ord", "label", "description")).alias("m"))
    return g.select("corpus", "actor", "m.ord", "m.label", "m.description")


def assign_anchors(points: DataFrame, anchors: DataFrame, places: int = 9) -> DataFrame:
    """(id, anchor, distance): nearest anchor of the same group; ties go to the smallest ord. points (id, g, vector), anchors (g, anchor, ord, vector).

    Points without a vector or without an anchor in their group have no row. Anchors of at most the broadcast limit travel with the
    tasks, which multiply whole batches with them; more anchors are joined.
    """
    tmp = Scratch(points.sparkSession, "anchors")
    a = tmp.put(anchors.select("g", "anchor", "ord", "vector"))
    if tmp.bytes(a) > BROADCAST_BYTES:
        d = F.round(cosine_distance(F.col("vector"), F.col("_a")), places)
        x = points.where("vector is not null").join(a.withColumnRenamed("vector", "_a"), "g").select("id", d.alias("d"), "ord", "anchor")
        return x.groupBy("id").agg(F.min(F.struct("d", "ord", "anchor")).alias("m")).select("id", F.col("m.anchor").alias("anchor"), F.col("m.d").alias("distance"))
    sets = {}
    for g, part in a.where("vector is not null").toPandas().sort_values(["ord", "anchor"], kind="stable").groupby("g"):
        v = np.stack(part["vector"].to_numpy()).astype(np.float64)
        sets[g] = part["anchor"].to_numpy(object), v, np.sqrt((v * v).sum(1))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for g, part in b.groupby("g"):
                if g not in sets:
                    continue
                names, v, norm = sets[g]
                fit = part["vector"].map(lambda x, n=v.shape[1]: len(x) == n).to_numpy(bool)
                x = np.full((len(part), v.shape[1]), np.nan)
                if fit.any():
                    x[fit] = np.stack(part["vector"].to_numpy()[fit]).astype(np.float64)
                d = np.round(1 - x @ v.T / (np.sqrt((x * x).sum(1))[:, None] * norm[None, :] + EPSILON), places)
                k = np.where(np.isnan(d), np.inf, d).argmin(1)  # the first anchor wins a tie
                yield pd.DataFrame({"id": part["id"].to_numpy(), "anchor": names[k], "distance": d[np.arange(len(d)), k]})

    kinds = dict(points.select("id").dtypes)
    return points.where("vector is not null").select("id", "g", "vector").mapInPandas(nearest, f"id {kinds['id']}, anchor string, distance double")


def recentre(points: DataFrame, assigned: DataFrame, anchors: DataFrame) -> DataFrame:
    """anchors with the unit mean of the points assigned to each; an anchor without points stays where it is."""
    m = mean_vectors(points.join(assigned.select("id", "anchor"), "id"), ["g", "anchor"], "vector", "_m")
    return anchors.join(m, ["g", "anchor"], "left").select("g", "anchor", "ord", F.coalesce(normalised(F.col("_m")), F.col("vector")).alias("vector"))


def align_history(spark: SparkSession, points: DataFrame, anchors: DataFrame, passes: int = 2) -> list[tuple[DataFrame, DataFrame]]:
    """Assignments, and (g, converged) per group, before and after each of up to `passes` recentrings; it ends early when nothing moves.

    points and anchors as in assign_anchors(). A group has converged when a pass changed none of its assignments; before the
    first pass nothing has.
    """
    tmp = Scratch(spark, "align")
    p, a = tmp.put(points), tmp.put(anchors)
    groups = p.select("g").distinct()
    out = [(tmp.put(assign_anchors(p, a)), tmp.put(groups.withColumn("converged", F.lit(False))))]
    for _ in range(passes):
        now = out[-1][0]
        a = tmp.put(recentre(p, now, a))
        nxt = tmp.put(assign_anchors(p, a))
        moved = nxt.join(now.select("id", F.col("anchor").alias("old")), "id").where("anchor <> old").select("id")
        moved = p.select("id", "g").join(moved, "id").select("g").distinct()
        state = tmp.put(groups.join(moved.withColumn("m", F.lit(True)), "g", "left").select("g", F.col("m").isNull().alias("converged")))
        out.append((nxt, state))
        if state.where("not converged").isEmpty():
            break
    return out


def align(spark: SparkSession, points: DataFrame, anchors: DataFrame, passes: int = 2) -> tuple[DataFrame, DataFrame]:
    """The last assignments and states of align_history()."""
    return align_history(spark, points, anchors, passes)[-1]


def coverage(assigned: DataFrame, anchors: DataFrame) -> DataFrame:
    """(g, anchor, n, share, empty): points per anchor, and whether it has none and falls back to its own label."""
    n = assigned.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    x = anchors.select("g", "anchor").join(n, "anchor", "left").fillna(0, ["n"])
    return x.withColumn("share", F.try_divide("n", F.sum("n").over(Window.partitionBy("g")))).withColumn("empty", F.col("n") == 0)


def fallback_labels(labelled: DataFrame, valid: DataFrame, nearest: DataFrame) -> DataFrame:
    """(id, label, valid): the label if it is valid for the actor, else the nearest one. labelled (id, actor, label), valid (actor, label), nearest (id, anchor)."""
    v = small_broadcast(valid.select("actor", "label").distinct().withColumn("ok", F.lit(True)))
    x = labelled.join(v, ["actor", "label"], "left").join(nearest.select("id", "anchor"), "id", "left")
    return x.select("id", F.when(F.col("ok"), F.col("label")).otherwise(F.col("anchor")).alias("label"), F.coalesce("ok", F.lit(False)).alias("valid"))


def last_chunk_wins(chunks: DataFrame) -> DataFrame:
    """(dialogue_id, turn, label): where chunks overlap, the label of the chunk that starts last. chunks (dialogue_id, start, turn, label)."""
    return chunks.groupBy("dialogue_id", "turn").agg(F.max(F.struct("start", "label")).alias("m")).select("dialogue_id", "turn", "m.label")


def resolve_replies(replies: DataFrame, turns: DataFrame, nearest: DataFrame) -> DataFrame:
    """(dialogue_id, turn, label, answered): replies (dialogue_id, pos, turn, label) by turn; the last reply of a turn wins, turns that do not exist are ignored, missing ones get the nearest label (dialogue_id, turn, anchor)."""
    r = replies.groupBy("dialogue_id", "turn").agg(F.max(F.struct("pos", "label")).alias("m")).select("dialogue_id", "turn", "m.label")
    x = turns.select("dialogue_id", "turn").join(r, ["dialogue_id", "turn"], "left").join(nearest.select("dialogue_id", "turn", "anchor"), ["dialogue_id", "turn"], "left")
    return x.select("dialogue_id", "turn", F.coalesce("label", "anchor").alias("label"), F.col("label").isNotNull().alias("answered"))


def merge_labels(spark: SparkSession, labels: DataFrame, similar: DataFrame) -> DataFrame:
    """(ord, label, merged): groups of labels joined by similar (a, b) ords, named after their first member; equal names get _2, _3, ... in order.

    Smallest ords spread along the links until nothing changes. labels (ord, label); a taxonomy is small, but nothing relies on it.
    """
    tmp = Scratch(spark, "merge")
    both = tmp.put(similar.select("a", "b").unionByName(similar.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    now = tmp.put(labels.select("ord", F.col("ord").alias("rep")))
    while True:
        got = both.join(now.withColumnRenamed("ord", "a"), "a").select(F.col("b").alias("ord"), "rep")
        nxt = tmp.put(now.unionByName(got).groupBy("ord").agg(F.min("rep").alias("rep")))
        same = nxt.join(now, ["ord", "rep"], "left_anti").isEmpty()
        now = nxt
        if same:
            break
    name = now.select("rep").distinct().join(labels.select(F.col("ord").alias("rep"), "label"), "rep")
    name = name.withColumn("_k", F.row_number().over(Window.partitionBy("label").orderBy("rep"))).select("rep", F.when(F.col("_k") > 1, F.concat_ws("_", "label", F.col("_k").cast("string"))).otherwise(F.col("label")).alias("merged"))
    return labels.join(now, "ord").join(name, "rep").select("ord", "label", "merged")


def verdict_scores(rules: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(session_id, rule_id, kind, score): one row per rule of a session; rules without verdict score 0, verdicts on unknown rules are dropped, two verdicts on a rule are an error."""
    v = verdicts.groupBy("session_id", "rule_id").agg(F.count(F.lit(1)).alias("_n"), F.max("score").alias("score"))
    bad = F.raise_error(F.concat(F.lit("two verdicts on rule "), F.col("rule_id"))).cast("int")
    v = v.select("session_id", "rule_id", F.when(F.col("_n") > 1, bad).otherwise(F.col("score")).alias("score"))
    s = verdicts.select("session_id").distinct().join(rules)
    return s.join(v, ["session_id", "rule_id"], "left").select("session_id", "rule_id", "kind", F.coalesce("score", F.lit(0)).alias("score"))


def session_scores(scores: DataFrame) -> DataFrame:
    """(session_id, score, adherence, n_judged): mean of the scores other than 0 (null if there are none), and it scaled to [0, 1]."""
    m = F.avg(F.when(F.col("score") != 0, F.col("score")))
    return scores.groupBy("session_id").agg(m.alias("score"), ((m + 1) / 2).alias("adherence"), F.count_if(F.col("score") != 0).alias("n_judged"))


def independent_judge(judge: str, generators: dict[str, str], judges: dict[str, str]) -> str:
    """The judge's model, unless it is unknown or one of the generators' models."""
    if judge not in judges:
        raise ValueError(f"unknown judge {judge}")
    if judges[judge] in generators.values():
        raise ValueError(f"{judge} would judge its own graphs")
    return judges[judge]


def average_linkage(x: np.ndarray, cut: float) -> np.ndarray:
    """Cluster numbers of unit vectors by average linkage on cosine distance, cut at distance `cut`; numbered by first member."""
    n = len(x)
    d = 1 - x @ x.T
    np.fill_diagonal(d, np.inf)
    size, alive, label = np.ones(n), np.ones(n, bool), np.arange(n)
    while alive.sum() > 1:
        i, j = divmod(int(d.argmin()), n)
        if d[i, j] > cut:
            break
        i, j = min(i, j), max(i, j)
        d[i] = d[:, i] = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        d[i, i] = np.inf
        d[j] = d[:, j] = np.inf
        size[i] += size[j]
        alive[j] = False
        label[label == j] = i
    return np.unique(label, return_inverse=True)[1]


def agglomerative(points: DataFrame, similarity: float = 0.55) -> DataFrame:
    """(g, id, cluster): average linkage inside each group of points (g, id, vector). A group is one task's work (quadratic), meant for label lists."""

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("id")
        x = np.stack(b["vector"].to_numpy()).astype(np.float64)
        n = np.sqrt((x * x).sum(1, keepdims=True))
        return pd.DataFrame({"g": b["g"], "id": b["id"], "cluster": average_linkage(x / np.where(n > 0, n, 1), 1 - similarity)})

    kinds = dict(points.dtypes)
    return points.where("vector is not null").select("g", "id", "vector").groupBy("g").applyInPandas(run, f"g {kinds['g']}, id {kinds['id']}, cluster long")


def kmeans_sweep(points: DataFrame, least: int = 3, most: int = 20, seed: int = 42) -> DataFrame:
    """(k, silhouette, best) of Euclidean k-means on (id, vector), with cosine silhouettes, for k up to one less than the points; by
    MLlib, so clusters are found by all executors. The best k has the greatest silhouette (ties: the smallest k)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator
    from pyspark.ml.functions import array_to_vector

    spark = points.sparkSession
    v = Scratch(spark, "kmeans").put(points.where("vector is not null").select("id", "vector")).select("id", array_to_vector("vector").alias("features"))
    rows, n = [], v.count()
    for k in range(least, min(most, n - 1) + 1):
        made = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster").fit(v).transform(v)
        rows.append((k, float(ClusteringEvaluator(predictionCol="cluster", distanceMeasure="cosine").evaluate(made))))
    best = max(rows, key=lambda r: (r[1], -r[0]))[0] if rows else None
    return spark.createDataFrame([(*r, r[0] == best) for r in rows], "k int, silhouette double, best boolean")


def kmeans_clusters(points: DataFrame, least: int = 3, most: int = 20, seed: int = 42) -> DataFrame:
    """(id, cluster) of points (id, vector) by k-means with the k of the best silhouette; fewer points than least + 1 are one cluster each."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    best = kmeans_sweep(points, least, most, seed).where("best").first()
    x = points.where("vector is not null").select("id", array_to_vector("vector").alias("features"))
    if best is None:
        return x.select("id", (F.row_number().over(Window.orderBy("id")) - 1).cast("int").alias("cluster"))
    return KMeans(k=best["k"], seed=seed, featuresCol="features", predictionCol="cluster").fit(x).transform(x).select("id", "cluster")


def coverage_totals(covered: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_nodes, n_real, n_empty, coverage_frac) of coverage(): nodes with points of their own and their share."""
    g = covered.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(~F.col("empty")).alias("n_real"), F.count_if("empty").alias("n_empty"))
    return g.withColumn("coverage_frac", F.try_divide("n_real", "n_nodes"))


def coverage_samples(assigned: DataFrame, texts: DataFrame, n: int = 3) -> DataFrame:
    """(anchor, samples): the first n texts, by id, assigned to each anchor. texts: (id, text). Only the smallest n of a group are kept on the way."""
    x = assigned.select("id", "anchor").join(texts.select("id", "text"), "id")
    x = x.withColumn("_k", F.row_number().over(Window.partitionBy("anchor").orderBy("id"))).where(F.col("_k") <= n)
    return x.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("id", "text"))).alias("x")).select("anchor", F.col("x.text").alias("samples"))


def canonical_by_cluster(labels: DataFrame, least: int = 2, most: int = 60, seed: int = 42) -> DataFrame:
    """(label, cluster, canonical): labels (label, n, vector) clustered by k-means with the k of the best silhouette; the most frequent
    label of a cluster (ties: the smallest) is its canonical one. Labels without a vector stay as they are. Meant for label lists."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    tmp = Scratch(labels.sparkSession, "canonical")
    v = tmp.put(labels.where("vector is not null").select("label", "n", "vector"))
    best = kmeans_sweep(v.select(F.col("label").alias("id"), "vector"), least, most, seed).where("best").first()
    x = v.select("label", "n", array_to_vector("vector").alias("features"))
    made = KMeans(k=best["k"], seed=seed, featuresCol="features", predictionCol="cluster").fit(x).transform(x).select("label", "n", "cluster") if best else v.select("label", "n", F.xxhash64("label").alias("cluster"))
    made = tmp.put(made)
    top = made.groupBy("cluster").agg(F.min(F.struct((-F.col("n")).alias("o"), "label")).alias("m")).select("cluster", F.col("m.label").alias("canonical"))
    rest = labels.where("vector is null").select("label", F.lit(None).cast("long").alias("cluster"), F.col("label").alias("canonical"))
    return made.join(top, "cluster").select("label", F.col("cluster").cast("long").alias("cluster"), "canonical").unionByName(rest)


def representatives(points: DataFrame, n: int = 5, places: int = 9) -> DataFrame:
    """(g, id, rank): the n points of each group nearest to its unit mean. points (g, id, vector)."""
    m = mean_vectors(points, ["g"], "vector", "_m").select("g", normalised(F.col("_m")).alias("_m"))
    x = points.where("vector is not null").join(small_broadcast(m), "g").select("g", "id", F.round(cosine_distance(F.col("vector"), F.col("_m")), places).alias("d"))
    return x.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy("d", "id"))).where(F.col("rank") <= n).select("g", "id", "rank")
