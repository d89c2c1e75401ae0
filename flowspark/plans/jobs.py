"""One function per entry point: each takes a session and a folder of tables and returns the report as a DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.operators import conversations as C
from flowspark.operators import flows as G
from flowspark.operators import kernel as K
from flowspark.operators import labelling as L
from flowspark.operators import reports as R
from flowspark.operators import segments as W
from flowspark.operators import statistics as S
from flowspark.session import Scratch, small_broadcast
from flowspark.sources.tables import read


def scores(spark: SparkSession, d: str, corpus: str | None = None, min_run: int | None = None, dwell: float | None = None, least_train: int = 1, least_test: int = 1) -> DataFrame:
    """(flow_id, dialogue_id, stratum, pool, length, distance, score) of test conversations against the tries of their corpus.

    Strata with fewer training or test conversations than given are left out. min_run segments the conversations first.
    """
    tmp = Scratch(spark, "job")
    t, s = tmp.put(C.conversations(spark, d, True)), C.sides(spark, d)
    if corpus:
        s = s.where(F.col("corpus") == corpus)
    s = tmp.put(s.withColumn("stratum", F.concat_ws(":", "corpus", "stratum")))
    big = s.groupBy("stratum").agg(F.count_if(F.col("side") == "train").alias("a"), F.count_if(F.col("side") == "test").alias("b")).where((F.col("a") >= least_train) & (F.col("b") >= least_test)).select("stratum")
    s = tmp.put(s.join(small_broadcast(tmp.put(big)), "stratum", "left_semi"))
    train = t.join(s.where("side = 'train'").select("dialogue_id", F.col("stratum").alias("flow_id")), "dialogue_id")
    nodes, cents = tmp.put(G.trie(train)), tmp.put(G.centroids(train))
    flows = small_broadcast(nodes.select("flow_id", F.split("flow_id", ":")[0].alias("corpus")).distinct())
    pairs = tmp.put(s.where("side = 'test'").join(flows, "corpus").select("dialogue_id", "flow_id", "stratum", F.when(F.col("stratum") == F.col("flow_id"), "positive").otherwise("negative").alias("pool")))
    if min_run is None:
        got = K.flow_distances(t, nodes, cents, pairs, dwell=dwell)
    else:  # segments differ by flow: each pair's segments are a conversation of their own
        talk = t.join(pairs.select("dialogue_id", "flow_id"), "dialogue_id")
        seg = tmp.put(W.segment(talk, cents, min_run).withColumn("pair", F.xxhash64("flow_id", "dialogue_id")))
        ids = seg.select("pair", "flow_id", "dialogue_id").distinct()
        got = K.flow_distances(seg.select(F.col("pair").alias("dialogue_id"), F.col("segment").alias("turn"), "actor", "vector"), nodes, cents, ids.select(F.col("pair").alias("dialogue_id"), "flow_id"), dwell=dwell)
        got = got.withColumnRenamed("dialogue_id", "pair").join(ids, ["pair", "flow_id"]).drop("pair")
    x = got.join(pairs, ["flow_id", "dialogue_id"]).withColumnRenamed("n_turns", "length")
    return tmp.put(x.withColumn("score", F.when(F.col("length") > 0, F.col("distance") / F.col("length")).otherwise(F.col("distance"))))


def validate_discrimination(spark: SparkSession, d: str, corpus: str = "STAR") -> DataFrame:
    """Means, deviations, ratio and gap per flow."""
    return S.discrimination(scores(spark, d, corpus), "flow_id")


def significance(spark: SparkSession, d: str, corpus: str = "STAR", splits: int = 5) -> DataFrame:
    """Split ratios per flow with U test and bootstrap interval of the pooled scores."""
    s = scores(spark, d, corpus)
    parts = S.discrimination(s.withColumn("split", F.pmod(F.xxhash64("dialogue_id"), F.lit(splits))), "flow_id", "split")
    u = S.mann_whitney_p(S.mann_whitney(s, "flow_id")).select("flow_id", "u", "rbc", "p_less")
    return R.split_summary(parts, "flow_id").join(u, "flow_id").join(S.bootstrap_ratio(s, "flow_id"), "flow_id")


def star_validation(spark: SparkSession, d: str, alpha: float = 0.01) -> DataFrame:
    """U test of every STAR task with at least five training and three test conversations, against a threshold shared by all tests."""
    return _tested(scores(spark, d, "STAR", least_train=5, least_test=3), alpha)


def tv_prefix_trees(spark: SparkSession, d: str, min_run: int | None = None, alpha: float = 0.01) -> DataFrame:
    """The same for TV phases with at least five conversations on both sides, segmented if min_run is given."""
    return _tested(scores(spark, d, "TV", min_run, least_train=5, least_test=5), alpha)


def _tested(s: DataFrame, alpha: float) -> DataFrame:
    u = S.mann_whitney_p(S.mann_whitney(s, "flow_id")).select("flow_id", "u", "rbc", "p_less")
    x = S.discrimination(s, "flow_id").join(u, "flow_id")
    n = x.agg(F.count(F.lit(1)).alias("n_tests"))
    return x.crossJoin(F.broadcast(n)).withColumn("passed", (F.col("p_less") < F.lit(alpha) / F.col("n_tests")) & (F.col("gap") > 0))


def phase_confusion(spark: SparkSession, d: str, corpus: str = "TV", min_run: int | None = None) -> DataFrame:
    """Mean score of every stratum's test conversations under every flow, pivoted by stratum."""
    s = scores(spark, d, corpus, min_run)
    return s.groupBy("flow_id").pivot("stratum").agg(F.avg(F.col("distance") / F.greatest(F.lit(1), F.col("length"))))


def length_matched(spark: SparkSession, d: str, corpus: str = "TV", min_run: int | None = None) -> DataFrame:
    """Raw and length-matched ratios with permutation p."""
    s = scores(spark, d, corpus, min_run)
    return R.length_confound(s, "flow_id").join(S.permutation_p(s, "flow_id"), "flow_id", "left")


def align_graphs(spark: SparkSession, d: str, passes: int = 3) -> DataFrame:
    """Coverage of the labels' anchors by the utterances aligned to them, after up to `passes` recentrings."""
    from flowspark.plans.flows import _points

    p, a = _points(spark, d, Scratch(spark, "align"))
    got, _ = L.align(spark, p, a, passes)
    return L.coverage(got, a)


def graph_discrimination(spark: SparkSession, d: str, variants: dict[str, dict] | None = None, corpus: str = "TV") -> DataFrame:
    """Ratios of scoring variants (arguments of scores()) compared over the flows for which all of them have one."""
    rows = None
    for name, kw in (variants or {"plain": {}, "segmented": {"min_run": 2}, "dwell": {"dwell": 0.25}}).items():
        r = S.discrimination(scores(spark, d, corpus, **kw), "flow_id").select(F.lit(name).alias("variant"), F.col("flow_id").alias("phase"), "ratio")
        rows = r if rows is None else rows.unionByName(r)
    return R.common_phase_summary(rows)


def label_dialogues(spark: SparkSession, d: str, labeler, cache: DataFrame | None = None, mode: str = "whole", width: int = 5, stride: int = 4) -> DataFrame:
    """(dialogue_id, turn, label, answered): labels of all turns by an injected labeler, behind a cache.

    The labeler maps batches of (key, payload) to (key, response), response being one label per line. Modes: 'whole', one call per
    dialogue; 'agent', the same for its agent turns only, user turns being named after the next labelled agent turn; 'window', one
    call per turn with `width` turns around it; 'chunk', one call per `width` turns every `stride`, the later one winning where they
    overlap. Turns the labeler gives no valid label for take the label of the nearest anchor.
    """
    from flowspark.functions.text import chunk_starts, context_window, render_dialogue
    from flowspark.plans.flows import _points

    tmp = Scratch(spark, "label")
    t = tmp.put(C.conversations(spark, d))
    packed = tmp.put(C.packed(t).select("dialogue_id", "turns"))
    turns, n = F.col("turns"), F.size("turns")
    every = F.sequence(F.lit(0), n - 1)
    if mode == "whole":
        calls = packed.select("dialogue_id", F.lit(0).alias("start"), every.alias("places"), turns.alias("part"))
    elif mode == "agent":
        calls = packed.select("dialogue_id", F.lit(0).alias("start"), F.filter(every, lambda i: turns[i]["actor"] == "agent").alias("places"), turns.alias("part"))
    elif mode == "window":
        at = packed.select("dialogue_id", "turns", F.explode(every).alias("start"))
        calls = at.select("dialogue_id", "start", F.array("start").alias("places"), context_window(turns, F.col("start"), width).alias("part"))
    elif mode == "chunk":
        at = packed.select("dialogue_id", "turns", F.explode(chunk_starts(n, width, stride)).alias("start"))
        calls = at.select("dialogue_id", "start", F.sequence("start", F.least(F.col("start") + width, n) - 1).alias("places"), F.slice("turns", F.col("start") + 1, width).alias("part"))
    else:
        raise ValueError(f"unknown mode: {mode}")
    # a window's place inside its turns is part of the question
    payload = F.concat_ws("\n", render_dialogue(F.col("part")), *[F.concat(F.lit("turn "), F.col("start").cast("string"))] * (mode == "window"))
    calls = calls.withColumn("payload", payload)
    calls = tmp.put(calls.select("dialogue_id", "start", "places", "payload", L.cache_key(F.lit("labeler"), F.lit(mode), F.col("payload")).alias("key")))
    known = cache if cache is not None else spark.createDataFrame([], "key string, response string")
    answer = L.cached_calls(calls.select("key", "payload"), known, labeler)
    lines = calls.join(answer, "key").select("dialogue_id", "start", "places", F.posexplode(F.split("response", "\n")).alias("line", "label")).where(F.col("line") < F.size("places"))
    valid = read(spark, d, "taxonomy").select("label").distinct()
    place = packed.select("dialogue_id", F.posexplode("turns.turn").alias("place", "turn"))
    replies = lines.select("dialogue_id", F.col("start").alias("pos"), F.col("places")[F.col("line")].alias("place"), "label").join(small_broadcast(valid), "label", "left_semi").join(place, ["dialogue_id", "place"]).drop("place")
    p, a = _points(spark, d, tmp)
    near = L.assign_anchors(p, a).select(F.floor(F.col("id") / 1000).alias("dialogue_id"), F.pmod("id", F.lit(1000)).cast("int").alias("turn"), F.regexp_replace("anchor", "^[a-z]+:", "").alias("anchor"))
    got = L.resolve_replies(replies, t, near)
    if mode != "agent":
        return got
    named = C.context_labels(t.drop("label").join(got, ["dialogue_id", "turn"]))
    return named.select("dialogue_id", "turn", F.col("intent").alias("label"), (F.col("answered") & (F.col("actor") == "agent")).alias("answered"))


def bootstrap_taxonomy(spark: SparkSession, d: str, labeler, mode: str = "cluster", cache: DataFrame | None = None, most: int = 20, samples: int = 5, limit: int = 40_000) -> DataFrame:
    """(actor, ord, label, description): a taxonomy from the utterances by an injected labeler, behind a cache.

    The labeler maps batches of (key, payload) to (key, response), response being lines 'label: description'. Modes: 'cluster', one
    call for each cluster with its most typical texts, the first line naming it; 'single', one call per actor with evenly sampled
    texts of about `limit` characters; 'hybrid', one call per actor with the typical texts of all its clusters. Repeated labels of an
    actor keep the first description.
    """
    from flowspark.functions.prompts import numbered
    from flowspark.functions.text import even_sample
    from flowspark.functions.vectors import normalised

    if mode not in ("cluster", "single", "hybrid"):
        raise ValueError(f"unknown mode: {mode}")
    tmp = Scratch(spark, "taxonomy")
    t = tmp.put(C.conversations(spark, d, True).withColumn("id", F.col("dialogue_id") * 1000 + F.col("turn")).where("text <> ''"))
    if mode == "single":
        texts = even_sample(t.select("actor", "id", "text"), "actor", "id", "text", limit).groupBy("actor").agg(F.sort_array(F.collect_list(F.struct("id", "text"))).alias("x"))
        calls = texts.select("actor", F.lit(0).alias("cluster"), F.col("x.text").alias("texts"))
    else:
        parts = None
        for actor in ("agent", "user"):
            p = tmp.put(t.where(F.col("actor") == actor).select("id", normalised(F.col("vector")).alias("vector")).where("vector is not null and not exists(vector, x -> x is null)"))
            made = L.kmeans_clusters(p, 3, most).select("id", F.concat_ws(":", F.lit(actor), F.col("cluster").cast("string")).alias("g")).join(p, "id")
            parts = made if parts is None else parts.unionByName(made)
        top = L.representatives(tmp.put(parts), samples).join(t.select("id", "text"), "id")
        texts = top.groupBy("g").agg(F.sort_array(F.collect_list(F.struct("rank", "text"))).alias("x")).select(F.split("g", ":")[0].alias("actor"), F.split("g", ":")[1].cast("int").alias("cluster"), F.col("x.text").alias("texts"))
        if mode == "hybrid":
            texts = texts.groupBy("actor").agg(F.sort_array(F.collect_list(F.struct("cluster", "texts"))).alias("x")).select("actor", F.lit(0).alias("cluster"), F.flatten("x.texts").alias("texts"))
        calls = texts
    calls = tmp.put(calls.withColumn("payload", F.concat(F.col("actor"), F.lit("\n"), numbered(F.col("texts")))).withColumn("key", L.cache_key(F.lit("taxonomy"), F.lit(mode), F.col("payload"))))
    known = cache if cache is not None else spark.createDataFrame([], "key string, response string")
    answer = L.cached_calls(calls.select("key", "payload"), known, labeler)
    lines = calls.join(answer, "key").select("actor", "cluster", F.posexplode(F.split("response", "\n")).alias("line", "x")).where(F.trim("x") != "")
    if mode == "cluster":
        lines = lines.where("line = 0")
    part = F.split("x", ":", 2)
    found = lines.select("actor", (F.col("cluster") * 1000 + F.col("line")).alias("ord"), F.trim(part[0]).alias("label"), F.trim(F.coalesce(F.try_element_at(part, F.lit(2)), F.lit(""))).alias("description"))
    return L.dedupe_taxonomy(found.withColumn("corpus", F.lit("new"))).drop("corpus")
