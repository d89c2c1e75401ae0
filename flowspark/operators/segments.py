"""Segmentation: nearest centroid per turn, smoothed run-length encoding, and segment vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.vectors import cosine_distance
from flowspark.session import small_broadcast


def nearest_bucket(talk: DataFrame, centroids: DataFrame, places: int = 9) -> DataFrame:
    """(dialogue_id, turn, flow_id, bucket, distance): the nearest same-actor bucket of every flow given for the dialogue.

    talk: (dialogue_id, turn, actor, vector, flow_id). Centroids are few (one per label and flow) and travel to the turns if
    their size allows; each turn keeps only its best, found by a partially aggregated minimum. Distances are compared rounded,
    so that the first bucket wins a tie; turns without vector or same-actor bucket have no row.
    """
    c = small_broadcast(centroids.select("flow_id", F.col("actor").alias("actor"), "bucket", "ord", "centroid"))
    x = talk.where("vector is not null").join(c, ["flow_id", "actor"])
    d = F.round(cosine_distance(F.col("vector"), F.col("centroid")), places)
    g = x.select("flow_id", "dialogue_id", "turn", d.alias("d"), "ord", "bucket").groupBy("flow_id", "dialogue_id", "turn").agg(F.min(F.struct("d", "ord", "bucket")).alias("m"))
    return g.select("dialogue_id", "turn", "flow_id", F.col("m.bucket").alias("bucket"), F.col("m.d").alias("distance"))


def smoothed_runs(labels: list, min_run: int = 1) -> list[list[int]]:
    """Index runs of equal labels; interior runs shorter than min_run whose neighbours agree are absorbed, leftmost first, until none is left."""
    runs: list[tuple[object, list[int]]] = []
    for i, x in enumerate(labels):
        if runs and runs[-1][0] == x:
            runs[-1][1].append(i)
        else:
            runs.append((x, [i]))
    i = 1
    while i < len(runs) - 1:
        if len(runs[i][1]) < min_run and runs[i - 1][0] == runs[i + 1][0]:
            runs[i - 1 : i + 2] = [(runs[i - 1][0], runs[i - 1][1] + runs[i][1] + runs[i + 1][1])]
            i = 1  # a merge may have made an earlier run absorbable
        else:
            i += 1
    return [r for _, r in runs]


def _segment(min_run: int):
    def run(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("turn").reset_index(drop=True)
        b["place"] = np.arange(len(b))
        rows = []
        for actor in ("agent", "user"):
            t = b[b["actor"] == actor].reset_index(drop=True)
            many = len(t) and int(t["n_buckets"].iloc[0]) >= 2
            runs = smoothed_runs(t["bucket"].tolist(), min_run) if many else [[i] for i in range(len(t))]
            for r in runs:
                v = [x for x in t["vector"].iloc[r] if x is not None]
                mean = np.mean(np.array(v, np.float64), axis=0) if v else None
                n = float(np.sqrt((mean * mean).sum())) if v else 0.0
                rows.append((key[0], key[1], int(t["turn"].iloc[r[0]]), actor, len(r), f"[seg@{t['place'].iloc[r[0]]}x{len(r)}] " + " | ".join(t["text"].iloc[r]), None if mean is None else (mean / n if n > 0 else mean).tolist()))
        out = pd.DataFrame(rows, columns=["flow_id", "dialogue_id", "first_turn", "actor", "n_turns", "text", "vector"]).sort_values("first_turn", kind="stable")
        out.insert(2, "segment", np.arange(len(out)))
        return out

    return run


def segment(talk: DataFrame, centroids: DataFrame, min_run: int = 1) -> DataFrame:
    """Segments of each dialogue under each flow given for it: (flow_id, dialogue_id, segment, first_turn, actor, n_turns, text, vector).

    Turns of one actor that run through the same nearest bucket become one segment with the unit mean of their vectors; an actor
    with fewer than two buckets keeps one segment per turn. The text begins with the place of the first turn in the conversation and the
    number of turns, so that equal texts stay apart. A conversation is handled in one task.
    """
    near = nearest_bucket(talk, centroids).select("flow_id", "dialogue_id", "turn", "bucket")
    n = centroids.groupBy("flow_id", "actor").agg(F.count(F.lit(1)).cast("int").alias("n_buckets"))
    x = talk.join(near, ["flow_id", "dialogue_id", "turn"], "left").join(n, ["flow_id", "actor"], "left").fillna(0, ["n_buckets"])
    x = x.select("flow_id", "dialogue_id", "turn", "actor", "text", "vector", F.coalesce("bucket", F.lit("")).alias("bucket"), "n_buckets")
    return x.groupBy("flow_id", "dialogue_id").applyInPandas(_segment(min_run), "flow_id string, dialogue_id long, segment long, first_turn int, actor string, n_turns int, text string, vector array<double>")


def substitution_costs(talk: DataFrame, centroids: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(flow_id, dialogue_id, turn, bucket, cost): alpha times the turn's distance to a same-actor bucket plus that bucket's distance to the turn's best one."""
    c = centroids.select("flow_id", "actor", "bucket", "centroid")
    best = nearest_bucket(talk, centroids).select("flow_id", "dialogue_id", "turn", F.col("bucket").alias("_best"))
    d2 = c.join(c.select("flow_id", "actor", F.col("bucket").alias("_best"), F.col("centroid").alias("_c")), ["flow_id", "actor"])
    d2 = small_broadcast(d2.select("flow_id", "actor", "bucket", "_best", "centroid", cosine_distance(F.col("centroid"), F.col("_c")).alias("_d2")))
    x = talk.where("vector is not null").join(best, ["flow_id", "dialogue_id", "turn"]).join(d2, ["flow_id", "actor", "_best"])
    return x.select("flow_id", "dialogue_id", "turn", "bucket", (F.lit(alpha) * (cosine_distance(F.col("vector"), F.col("centroid")) + F.col("_d2"))).alias("cost"))


def _block_minima(key: tuple, talk: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
    cols = ["flow_id", "dialogue_id", "turn", "bucket", "distance"]
    if not len(talk) or not len(train):
        return pd.DataFrame(columns=cols)
    train = train.sort_values("bucket", kind="stable")
    x, y = np.stack(talk["vector"].to_numpy()).astype(np.float64), np.stack(train["vector"].to_numpy()).astype(np.float64)
    names, start = np.unique(train["bucket"].to_numpy(object), return_index=True)
    d = 1 - x @ y.T / (np.sqrt((x * x).sum(1))[:, None] * np.sqrt((y * y).sum(1))[None, :] + 1e-9)
    m = np.minimum.reduceat(d, start, axis=1)
    n, k = m.shape
    return pd.DataFrame({"flow_id": key[0], "dialogue_id": np.repeat(talk["dialogue_id"].to_numpy(), k), "turn": np.repeat(talk["turn"].to_numpy(), k), "bucket": np.tile(names, n), "distance": m.ravel()}, columns=cols)


def nearest_member(talk: DataFrame, train: DataFrame, block: int = 4096) -> DataFrame:
    """(flow_id, dialogue_id, turn, bucket, distance): least distance of a turn to any utterance of each same-actor bucket of its flow.

    Both sides are cut into blocks of about `block` rows per flow and actor; a task multiplies two blocks, and only the
    minima per turn and bucket leave it.
    """
    keys = ["flow_id", "actor"]

    def cut(df: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        n = df.groupBy(*keys).agg((F.floor(F.count(F.lit(1)) / block) + 1).cast("int").alias("_n"))
        return df.join(n, keys).withColumn(name, F.pmod(F.xxhash64("dialogue_id", "turn"), F.col("_n")).cast("int")).drop("_n"), n

    a, na = cut(talk.where("vector is not null").select(*keys, "dialogue_id", "turn", "vector"), "_i")
    b, nb = cut(train.where("vector is not null").select(*keys, "dialogue_id", "turn", "bucket", "vector"), "_j")
    a = a.join(nb, keys).withColumn("_j", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    b = b.select(*keys, "bucket", "vector", "_j").join(na, keys).withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")
    m = a.groupBy(*keys, "_i", "_j").cogroup(b.groupBy(*keys, "_i", "_j")).applyInPandas(_block_minima, "flow_id string, dialogue_id long, turn int, bucket string, distance double")
    return m.groupBy("flow_id", "dialogue_id", "turn", "bucket").agg(F.min("distance").alias("distance"))
