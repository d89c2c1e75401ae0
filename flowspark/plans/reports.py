"""Queries on cost forms, summaries over splits and variants, usage, and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.text import token_estimate
from flowspark.functions.vectors import normalised
from flowspark.operators import conversations as C
from flowspark.operators import embedding as E
from flowspark.operators import flows as G
from flowspark.operators import kernel as K
from flowspark.operators import labelling as L
from flowspark.operators import reports as R
from flowspark.operators import segments as W
from flowspark.operators import statistics as S
from flowspark.plans.base import CENTROIDS, CONV, SIDES, TRIE
from flowspark.plans.flows import _KERNEL, _NEAR, _points, _scored, _talk
from flowspark.session import Scratch, small_broadcast
from flowspark.sources.tables import read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_COS = "1 - list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b})) + 1e-9)"


@query(f"""WITH {_NEAR}, bc AS (SELECT n.*, c.centroid AS bc FROM near n JOIN cent c ON c.flow_id = n.flow_id AND c.bucket = n.bucket)
SELECT t.dialogue_id, t.turn, t.flow_id, b.bucket, round(0.5::DOUBLE * ({_COS.format(a='t.vector', b='b.centroid')} + {_COS.format(a='b.centroid', b='bc.bc')}), 6) AS cost FROM talk t JOIN cent b ON b.flow_id = t.flow_id AND b.actor = t.actor JOIN bc ON bc.flow_id = t.flow_id AND bc.dialogue_id = t.dialogue_id AND bc.turn = t.turn WHERE t.vector IS NOT NULL""")
def substitution_cost(spark: SparkSession, d: str) -> DataFrame:
    talk, cents = _talk(spark, d, Scratch(spark, "costs"))
    return W.substitution_costs(talk, cents).select("dialogue_id", "turn", "flow_id", "bucket", F.round("cost", 6).alias("cost"))


@query(f"""WITH {_NEAR}, tr AS (SELECT flow_id, bucket, actor, vector FROM train WHERE vector IS NOT NULL) SELECT t.dialogue_id, t.turn, t.flow_id, tr.bucket, round(min({_COS.format(a='t.vector', b='tr.vector')}), 6) AS distance FROM talk t JOIN tr ON tr.flow_id = t.flow_id AND tr.actor = t.actor WHERE t.vector IS NOT NULL GROUP BY ALL""")
def d1_min_method(spark: SparkSession, d: str) -> DataFrame:
    tmp = Scratch(spark, "nearest")
    talk, _ = _talk(spark, d, tmp)
    train = tmp.put(G.training_turns(C.conversations(spark, d, True), C.sides(spark, d)).withColumn("bucket", G.bucket_name()))
    return W.nearest_member(talk, train).select("dialogue_id", "turn", "flow_id", "bucket", F.round("distance", 6).alias("distance"))


#: Splits of the held-out runs.
SPLITS = 10
_HELD = f"""{CONV}, {SIDES}, i AS (SELECT dialogue_id, corpus || ':' || stratum AS stratum FROM sides), h AS (SELECT stratum, count(*) // 2 AS half FROM i GROUP BY stratum), s0 AS (SELECT i.*, r.split, md5('0-' || r.split || '-' || dialogue_id) AS h FROM i, range(0, {SPLITS}) r(split)),
p0 AS (SELECT split, s0.stratum, dialogue_id, row_number() OVER (PARTITION BY split, s0.stratum ORDER BY s0.h, dialogue_id) AS k, half FROM s0 JOIN h USING (stratum)), g0 AS (SELECT split, h.stratum, dialogue_id, row_number() OVER (PARTITION BY split, h.stratum ORDER BY s0.h, dialogue_id) AS k, half FROM s0 JOIN h ON s0.stratum <> h.stratum),
ms AS (SELECT stratum || '#' || split AS flow_id, dialogue_id, 'positive' AS pool FROM p0 WHERE k <= half UNION ALL SELECT stratum || '#' || split, dialogue_id, 'negative' FROM g0 WHERE k <= half),
train AS (SELECT c.*, p0.stratum || '#' || p0.split AS flow_id, left(c.actor, 1) || ':' || c.label AS bucket FROM conv c JOIN p0 USING (dialogue_id) WHERE k > half), {TRIE}, {CENTROIDS},
test AS (SELECT dialogue_id, CASE pool WHEN 'positive' THEN flow_id ELSE '' END AS own, '' AS corpus, flow_id FROM ms),
""" + _KERNEL.split("WHERE s.side = 'test'),\n", 1)[1]


#: The same once, against flows of all conversations of a stratum.
_WITHIN = _HELD.replace(f"range(0, {SPLITS}) r(split)", "range(0, 1) r(split)").replace("JOIN p0 USING (dialogue_id) WHERE k > half)", "JOIN p0 USING (dialogue_id))")


def _held_out(spark: SparkSession, d: str, tmp: Scratch, dwells: tuple[float | None, ...] = (None,), splits: int = SPLITS, held_out: bool = True, negatives: bool = True) -> DataFrame:
    """(stratum, split, flow_id, dialogue_id, pool, n_turns, regime, distance, score): per split, half of a stratum against the flow of its other half.

    Not held out, the flow is that of the whole stratum, the scored half included. Without negatives only a stratum's own half is
    scored. The regimes are the places of the costs of staying on a node.
    """
    t = tmp.put(C.conversations(spark, d, True))
    items = tmp.put(C.sides(spark, d).select("dialogue_id", F.concat_ws(":", "corpus", "stratum").alias("stratum")))
    ms = tmp.put(S.multi_split(items, "stratum", "dialogue_id", splits, negatives=negatives))
    flow = F.concat_ws("#", "stratum", "split").alias("flow_id")
    rest = items.crossJoin(spark.range(splits).select(F.col("id").cast("int").alias("split")))
    if held_out:
        rest = rest.join(ms.where("pool = 'positive'").select("split", "stratum", "dialogue_id"), ["split", "stratum", "dialogue_id"], "left_anti")
    train = t.join(rest.select("dialogue_id", flow), "dialogue_id")
    nodes, cents = tmp.put(G.trie(train)), tmp.put(G.centroids(train))
    pairs = tmp.put(ms.select("dialogue_id", flow, "stratum", "split", "pool"))
    x = K.regime_distances(t, nodes, cents, pairs.select("dialogue_id", "flow_id", F.element_at(F.split("flow_id", "#"), 1).alias("bundle")), dwells).join(pairs, ["flow_id", "dialogue_id"])
    return tmp.put(x.withColumn("score", F.when(F.col("n_turns") > 0, F.col("distance") / F.col("n_turns")).otherwise(F.col("distance"))))


@query(f"""WITH RECURSIVE {_HELD}, r AS (SELECT flow_id, CASE WHEN avg(score) FILTER (pool = 'positive') > 0 THEN avg(score) FILTER (pool = 'negative') / avg(score) FILTER (pool = 'positive') END AS ratio FROM sc GROUP BY ALL)
SELECT split_part(flow_id, '#', 1) AS stratum, count(ratio) AS n_splits, round(avg(ratio), 6) AS mean, round(coalesce(stddev_samp(ratio), 0), 6) AS std, round(min(ratio), 6) AS least, round(max(ratio), 6) AS most FROM r GROUP BY 1""")
def multi_split_summary(spark: SparkSession, d: str) -> DataFrame:
    """Ratios over splits, the flow of each built from the half that is held out from scoring."""
    r = R.split_summary(S.discrimination(_held_out(spark, d, Scratch(spark, "heldout")), "stratum", "split"), "stratum")
    return r.select("stratum", "n_splits", *[F.round(c, 6).alias(c) for c in ("mean", "std", "least", "most")])


@query(f"WITH RECURSIVE {_HELD} SELECT split_part(flow_id, '#', 1) AS stratum, dialogue_id, count(*) AS n_splits, round(avg(score), 6) AS mean_score FROM sc WHERE pool = 'positive' GROUP BY ALL")
def conversation_averages(spark: SparkSession, d: str) -> DataFrame:
    """Mean held-out score of every conversation over the splits in which it was scored against its own stratum's flow."""
    return S.averages(_held_out(spark, d, Scratch(spark, "heldout"), negatives=False)).withColumn("mean_score", F.round("mean_score", 6))


@query(f"""WITH RECURSIVE {_WITHIN} SELECT split_part(flow_id, '#', 1) AS stratum, count(*) FILTER (pool = 'positive') AS n_pos, count(*) FILTER (pool = 'negative') AS n_neg, round(avg(score) FILTER (pool = 'positive'), 6) AS mean_pos, round(avg(score) FILTER (pool = 'negative'), 6) AS mean_neg,
round(CASE WHEN avg(score) FILTER (pool = 'positive') > 0 THEN avg(score) FILTER (pool = 'negative') / avg(score) FILTER (pool = 'positive') END, 6) AS ratio FROM sc GROUP BY 1""")
def in_distribution(spark: SparkSession, d: str) -> DataFrame:
    """Half of every stratum and as many others against the flow of the whole stratum."""
    g = S.discrimination(_held_out(spark, d, Scratch(spark, "within"), splits=1, held_out=False), "stratum")
    return g.select("stratum", "n_pos", "n_neg", *[F.round(c, 6).alias(c) for c in ("mean_pos", "mean_neg", "ratio")])


@query()
def paired_regimes(spark: SparkSession, d: str) -> DataFrame:
    """Signed-rank comparison, per stratum, of held-out averages with and without staying on a node."""
    tmp = Scratch(spark, "regimes")
    x = _held_out(spark, d, tmp, (None, 0.25), negatives=False)
    of = lambda k: F.avg(F.when(F.col("regime") == k, F.col("score")))
    # rounded, else the last digits of equal averages would be ranked
    p = tmp.put(x.groupBy("stratum", "dialogue_id").agg(F.round(of(0) - of(1), 9).alias("score")))
    w = tmp.put(S.paired(p, p.withColumn("score", F.lit(0.0)), "dialogue_id", by=("stratum",)))
    return S.paired_p(w).select("stratum", "n", *[F.round(c, 9).alias(c) for c in ("median_diff", "w_plus", "w_minus", "p_less", "p_greater", "p_two_sided")])


@query(f"""WITH RECURSIVE {_KERNEL}, b AS (SELECT flow_id, n_turns // 3 AS bin, count(*) FILTER (pool = 'positive') AS np, count(*) FILTER (pool = 'negative') AS nq, sum(score) FILTER (pool = 'positive') AS sp, avg(score) FILTER (pool = 'negative') AS mq FROM sc GROUP BY ALL),
v AS (SELECT 'raw' AS variant, flow_id AS phase, CASE WHEN avg(score) FILTER (pool = 'positive') > 0 THEN avg(score) FILTER (pool = 'negative') / avg(score) FILTER (pool = 'positive') END AS ratio FROM sc GROUP BY flow_id UNION ALL SELECT 'matched', flow_id, sum(np * mq) FILTER (np >= 2 AND nq >= 2) / sum(sp) FILTER (np >= 2 AND nq >= 2) FROM b GROUP BY flow_id),
f AS (SELECT phase FROM v WHERE ratio IS NOT NULL GROUP BY phase HAVING count(DISTINCT variant) = 2), g AS (SELECT variant, count(DISTINCT phase) AS n_phases, avg(ratio) AS m FROM v JOIN f USING (phase) WHERE ratio IS NOT NULL GROUP BY variant) SELECT variant, n_phases, round(m, 6) AS mean_ratio, m = max(m) OVER () AS best FROM g""")
def variant_summary_common_phases(spark: SparkSession, d: str) -> DataFrame:
    tmp = Scratch(spark, "scores")
    s = tmp.put(_scored(spark, d, tmp).withColumnRenamed("n_turns", "length"))
    raw = S.discrimination(s, "flow_id").select(F.lit("raw").alias("variant"), F.col("flow_id").alias("phase"), "ratio")
    lm = S.length_matched(s, "flow_id", least=2).select(F.lit("matched").alias("variant"), F.col("flow_id").alias("phase"), F.col("lm_ratio").alias("ratio"))
    return R.common_phase_summary(raw.unionByName(lm)).withColumn("mean_ratio", F.round("mean_ratio", 6))


@query(f"""WITH {CONV}, t AS (SELECT dialogue_id, (sum(length(text)) // 4)::BIGINT AS tok, count(*) AS n FROM conv GROUP BY dialogue_id), c AS (SELECT CASE WHEN dialogue_id % 2 = 0 THEN 'small' WHEN dialogue_id % 5 = 0 THEN 'other' ELSE 'large' END AS model, dialogue_id % 3 = 0 AS hit, tok AS ti, n * 3 AS too FROM t),
p(model, pi, po) AS (VALUES ('small', 0.25, 1.0), ('large', 2.5, 10.0)), g AS (SELECT model, count(*) AS n_calls, count(*) FILTER (hit) AS n_hits, coalesce(sum(ti) FILTER (NOT hit), 0)::BIGINT AS tokens_in, coalesce(sum(too) FILTER (NOT hit), 0)::BIGINT AS tokens_out FROM c GROUP BY model)
SELECT g.*, round(coalesce((tokens_in * pi::DOUBLE + tokens_out * po::DOUBLE) / 1e6, 0), 9) AS cost FROM g LEFT JOIN p USING (model)""")
def usage_totals(spark: SparkSession, d: str) -> DataFrame:
    p = C.packed(C.conversations(spark, d)).select("dialogue_id", token_estimate(F.col("turns.text")).alias("tokens_in"), (F.size("turns") * 3).cast("long").alias("tokens_out"))
    model = F.when(F.col("dialogue_id") % 2 == 0, "small").when(F.col("dialogue_id") % 5 == 0, "other").otherwise("large")
    prices = spark.createDataFrame([("small", 0.25, 1.0), ("large", 2.5, 10.0)], "model string, price_in double, price_out double")
    return R.usage_totals(p.select(model.alias("model"), (F.col("dialogue_id") % 3 == 0).alias("hit"), "tokens_in", "tokens_out"), F.broadcast(prices)).withColumn("cost", F.round("cost", 9))


@query("SELECT subject, min(dialogue_id) AS dialogue_id, count(DISTINCT dialogue_id) AS n_sessions FROM dialogues WHERE subject IS NOT NULL GROUP BY subject")
def first_session_per_subject(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "dialogues").where("subject is not null")
    return t.groupBy("subject").agg(F.min("dialogue_id").alias("dialogue_id"), F.countDistinct("dialogue_id").alias("n_sessions"))


@query()
def bonferroni_pass(spark: SparkSession, d: str) -> DataFrame:
    tmp = Scratch(spark, "scores")
    s = _scored(spark, d, tmp)
    p = S.mann_whitney_p(S.mann_whitney(s, "flow_id")).select("flow_id", F.col("p_less").alias("p"))
    return R.pass_count(tmp.put(p.join(S.discrimination(s, "flow_id").select("flow_id", "gap"), "flow_id")))


@query()
def length_confound_report(spark: SparkSession, d: str) -> DataFrame:
    tmp = Scratch(spark, "scores")
    s = tmp.put(_scored(spark, d, tmp).withColumnRenamed("n_turns", "length"))
    return R.length_confound(s, "flow_id", least=2)


@query()
def budget_stability(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance to the assigned anchor after one, two and three recentrings, per actor."""
    tmp = Scratch(spark, "budget")
    p, a = _points(spark, d, tmp)
    rows = None
    for got, state in L.align_history(spark, p, a, passes=3)[1:]:
        r = got.join(p.select("id", "g"), "id").groupBy("g").agg(F.avg("distance").alias("ratio")).join(state, "g")
        rows = r if rows is None else rows.unionByName(r)
    return R.budget_stability(tmp.put(rows), "g")


@query(f"""WITH {CONV}, {SIDES}, t AS (SELECT dialogue_id, actor, actor || ':' || label AS label, list_transform(vector, lambda y: y / sqrt(list_dot_product(vector, vector))) AS v FROM conv WHERE vector IS NOT NULL AND label <> 'unknown' AND list_dot_product(vector, vector) > 0),
x AS (SELECT t.*, s.side FROM t JOIN sides s USING (dialogue_id)), m AS (SELECT label, i, avg(v[i]) AS m FROM x, range(1, 97) r(i) WHERE side = 'train' GROUP BY ALL), c0 AS (SELECT label, list(m ORDER BY i) AS v FROM m GROUP BY label), ce AS (SELECT label, split_part(label, ':', 1) AS actor, list_transform(v, lambda y: y / sqrt(list_dot_product(v, v))) AS v FROM c0),
te AS (SELECT actor, label, v FROM x WHERE side = 'test'), p AS (SELECT te.label, avg(1 - list_dot_product(te.v, ce.v)) AS pos FROM te JOIN ce USING (label) GROUP BY 1), q AS (SELECT ce.label, avg(1 - list_dot_product(te.v, ce.v)) AS neg FROM te JOIN ce USING (actor) WHERE te.label <> ce.label GROUP BY 1)
SELECT label, round(pos, 6) AS pos, round(neg, 6) AS neg, round(neg - pos, 6) AS gap, neg - pos >= 0.2 AS passed FROM p JOIN q USING (label)""")
def embedding_gate(spark: SparkSession, d: str) -> DataFrame:
    """Per actor and label of training turns: mean distance of test turns with and without the label to the label's centre."""
    tmp = Scratch(spark, "gate")
    t = tmp.put(C.conversations(spark, d, True).where("vector is not null and label <> 'unknown'").withColumn("label", F.concat_ws(":", "actor", "label")).withColumn("vector", normalised(F.col("vector"))).where("not exists(vector, x -> x is null)"))
    s = C.sides(spark, d).select("dialogue_id", "side")
    x = tmp.put(t.join(s, "dialogue_id"))
    centre = E.label_centres(x.where("side = 'train'")).select("label", normalised(F.col("vector")).alias("vector"))
    centre = tmp.put(centre)
    test = x.where("side = 'test'").select("actor", "label", "vector")
    other = test.select("actor", F.col("label").alias("own"), "vector").join(small_broadcast(centre.select("label", F.split("label", ":")[0].alias("actor"))), "actor").where("label <> own").select("label", "vector")
    return E.embedding_gate(centre, test.select("label", "vector"), other).select("label", *[F.round(c, 6).alias(c) for c in ("pos", "neg", "gap")], "passed")
