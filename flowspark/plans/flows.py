"""Queries on flow graphs, the distance kernel and the statistics on its scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.functions.vectors import cosine_distance, normalised
from flowspark.operators import conversations as C
from flowspark.operators import flows as G
from flowspark.operators import kernel as K
from flowspark.operators import labelling as L
from flowspark.operators import reports as R
from flowspark.operators import segments as W
from flowspark.operators import statistics as S
from flowspark.operators.diagrams import acyclic_edges, mermaid
from flowspark.operators.hierarchy import hierarchy
from flowspark.plans.base import CENTROIDS, CONV, SIDES, TRAIN, TRIE
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


def _train(spark: SparkSession, d: str, vectors: bool = False) -> DataFrame:
    return G.training_turns(C.conversations(spark, d, vectors), C.sides(spark, d))


@query(f"WITH {CONV}, {SIDES}, {TRAIN}, f AS (SELECT flow_id, actor, label, count(*) AS n, count(DISTINCT text) AS t, min((dialogue_id, turn)) AS a FROM train GROUP BY ALL) SELECT flow_id, left(actor, 1) || ':' || label AS bucket, row_number() OVER (PARTITION BY flow_id ORDER BY a) AS ord, n AS n_utterances, t AS n_texts FROM f")
def intent_buckets(spark: SparkSession, d: str) -> DataFrame:
    return G.buckets(_train(spark, d)).select("flow_id", "bucket", "ord", F.col("n_utterances").cast("long").alias("n_utterances"), F.size("texts").cast("long").alias("n_texts"))


@query(f"WITH {CONV}, {SIDES}, {TRAIN}, {CENTROIDS} SELECT flow_id, bucket, ord, (i - 1)::INT AS dim, round(centroid[i], 6) AS value FROM cent, range(1, 97) r(i)")
def bucket_centroids(spark: SparkSession, d: str) -> DataFrame:
    c = G.centroids(_train(spark, d, True))
    return c.select("flow_id", "bucket", "ord", F.posexplode("centroid").alias("dim", "value")).select("flow_id", "bucket", "ord", "dim", F.round("value", 6).alias("value"))


@query(f"WITH {CONV}, {SIDES}, {TRAIN}, {CENTROIDS} SELECT a.flow_id, a.bucket AS a, b.bucket AS b, round(1 - list_dot_product(a.centroid, b.centroid) / (sqrt(list_dot_product(a.centroid, a.centroid)) * sqrt(list_dot_product(b.centroid, b.centroid)) + 1e-9), 6) AS distance FROM cent a JOIN cent b ON a.flow_id = b.flow_id AND a.actor = b.actor")
def cosine_matrix(spark: SparkSession, d: str) -> DataFrame:
    c = Scratch(spark, "centroids").put(G.centroids(_train(spark, d, True)))
    x = c.select("flow_id", "actor", F.col("bucket").alias("a"), F.col("centroid").alias("x")).join(c.select("flow_id", "actor", F.col("bucket").alias("b"), F.col("centroid").alias("y")), ["flow_id", "actor"])
    return x.select("flow_id", "a", "b", F.round(cosine_distance(F.col("x"), F.col("y")), 6).alias("distance"))


@query(f"WITH {CONV}, {SIDES}, {TRAIN}, {TRIE} SELECT flow_id, node, depth, bucket, n_dialogues FROM trie")
def trie_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.trie(_train(spark, d)).select("flow_id", "node", "depth", "bucket", "n_dialogues")


@query(f"WITH {CONV}, {SIDES}, {TRAIN}, {TRIE} SELECT flow_id, parent AS src, node AS dst FROM trie")
def trie_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.trie(_train(spark, d)).select("flow_id", F.col("parent").alias("src"), F.col("node").alias("dst"))


@query(f"WITH {CONV}, {SIDES}, {TRAIN}, {TRIE} SELECT flow_id, node, depth FROM trie t WHERE NOT EXISTS (SELECT 1 FROM trie c WHERE c.flow_id = t.flow_id AND c.parent = t.node)")
def trie_leaves(spark: SparkSession, d: str) -> DataFrame:
    return G.leaves(Scratch(spark, "trie").put(G.trie(_train(spark, d)))).select("flow_id", "node", "depth")


@query(f"WITH {CONV}, {SIDES}, {TRAIN}, {TRIE} SELECT flow_id, count(*) AS n_paths, max(depth) AS longest, sum(depth)::BIGINT AS total_steps FROM trie t WHERE NOT EXISTS (SELECT 1 FROM trie c WHERE c.flow_id = t.flow_id AND c.parent = t.node) GROUP BY flow_id")
def trie_paths(spark: SparkSession, d: str) -> DataFrame:
    p = G.trie_paths(Scratch(spark, "trie").put(G.trie(_train(spark, d))))
    n = F.size("path").cast("long")
    return p.groupBy("flow_id").agg(F.count(F.lit(1)).alias("n_paths"), F.max(n).alias("longest"), F.sum(n).alias("total_steps"))


_TASK = r"""rep AS (SELECT DISTINCT flow_id AS task, bucket AS src, lead(bucket) OVER (PARTITION BY flow_id, dialogue_id ORDER BY turn) AS dst FROM train), e AS (SELECT task, src, min(dst) AS dst FROM rep WHERE dst IS NOT NULL GROUP BY task, src)"""


@query(f"WITH {CONV}, {SIDES}, {TRAIN}, {_TASK}, s AS (SELECT task, src AS dst FROM e EXCEPT SELECT task, dst FROM e) SELECT task, src, dst FROM e UNION ALL SELECT task, '__ROOT__', dst FROM s UNION ALL SELECT task, '__ROOT__', min(src) FROM e WHERE task NOT IN (SELECT task FROM s) GROUP BY task")
def task_definition_flow(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    t = _train(spark, d).withColumn("bucket", G.bucket_name())
    nxt = t.select("flow_id", F.col("bucket").alias("src"), F.lead("bucket").over(Window.partitionBy("flow_id", "dialogue_id").orderBy("turn")).alias("dst")).where("dst is not null")
    one = nxt.groupBy("flow_id", "src").agg(F.min("dst").alias("dst"))
    definition = one.groupBy(F.col("flow_id").alias("task")).agg(F.map_from_entries(F.collect_list(F.struct("src", "dst"))).alias("next"))  # one entry per label of a task
    return G.task_flow(Scratch(spark, "task").put(definition))


def _scored(spark: SparkSession, d: str, tmp: Scratch, dwell: float | None = None) -> DataFrame:
    """(flow_id, dialogue_id, pool, n_turns, distance, score): test conversations against all flows of their corpus, written, as ranks read them several times."""
    t = tmp.put(C.conversations(spark, d, True))
    s = tmp.put(C.sides(spark, d))
    train = G.training_turns(t, s)
    nodes, cents = tmp.put(G.trie(train)), tmp.put(G.centroids(train))
    flows = small_broadcast(nodes.select("flow_id", F.split("flow_id", ":")[0].alias("corpus")).distinct())
    own = F.concat_ws(":", "corpus", "stratum")
    pairs = s.where("side = 'test'").select("dialogue_id", own.alias("own"), "corpus").join(flows, "corpus").select("dialogue_id", "flow_id", F.when(F.col("own") == F.col("flow_id"), "positive").otherwise("negative").alias("pool"))
    pairs = tmp.put(pairs)
    got = K.flow_distances(t, nodes, cents, pairs.withColumn("bundle", F.split("flow_id", ":")[0]), dwell=dwell)
    x = got.join(pairs, ["flow_id", "dialogue_id"])
    return tmp.put(x.withColumn("score", F.when(F.col("n_turns") > 0, F.col("distance") / F.col("n_turns")).otherwise(F.col("distance"))))


_KERNEL = rf"""{CONV}, {SIDES}, {TRAIN}, {TRIE}, {CENTROIDS},
test AS (SELECT s.dialogue_id, s.corpus || ':' || s.stratum AS own, s.corpus, f.flow_id FROM sides s JOIN (SELECT DISTINCT flow_id FROM trie) f ON split_part(f.flow_id, ':', 1) = s.corpus WHERE s.side = 'test'),
tv AS (SELECT t.flow_id, t.dialogue_id, c.turn, c.actor, coalesce(c.vector, list_transform(range(0, 96), lambda i: 0.0::DOUBLE)) AS x FROM test t JOIN conv c USING (dialogue_id)),
d1 AS (SELECT tv.flow_id, tv.dialogue_id, tv.turn, b.bucket, b.ord, b.centroid, 1 - list_dot_product(tv.x, b.centroid) / (sqrt(list_dot_product(tv.x, tv.x)) * sqrt(list_dot_product(b.centroid, b.centroid)) + 1e-9) AS d FROM tv JOIN cent b ON b.flow_id = tv.flow_id AND b.actor = tv.actor),
best AS (SELECT flow_id, dialogue_id, turn, arg_min(centroid, (d, ord)) AS bc FROM d1 GROUP BY ALL),
sub AS (SELECT d1.flow_id, d1.dialogue_id, d1.turn, d1.bucket, 0.5 * (d + 1 - list_dot_product(centroid, bc) / (sqrt(list_dot_product(centroid, centroid)) * sqrt(list_dot_product(bc, bc)) + 1e-9)) AS s FROM d1 JOIN best USING (flow_id, dialogue_id, turn)),
allb AS (SELECT tv.flow_id, tv.dialogue_id, b.bucket, list(coalesce(s.s, 1e9) ORDER BY tv.turn) AS s FROM tv JOIN (SELECT DISTINCT flow_id, bucket FROM trie) b USING (flow_id) LEFT JOIN sub s USING (flow_id, dialogue_id, turn, bucket) GROUP BY ALL),
len AS (SELECT flow_id, dialogue_id, count(*) AS n FROM tv GROUP BY ALL),
dp(flow_id, dialogue_id, node, r) AS (
  SELECT flow_id, dialogue_id, '__ROOT__', list_transform(range(0, n + 1), lambda i: i::DOUBLE) FROM len
  UNION ALL
  SELECT flow_id, dialogue_id, node, list_transform(range(0, len(a)), lambda j: list_min(list_transform(range(0, j + 1), lambda k: a[k + 1] + (j - k)))) FROM (
    SELECT dp.flow_id, dp.dialogue_id, t.node, [dp.r[1] + 1] || list_transform(range(1, len(dp.r)), lambda j: least(dp.r[j + 1] + 1, dp.r[j] + b.s[j])) AS a
    FROM dp JOIN trie t ON t.flow_id = dp.flow_id AND t.parent = dp.node JOIN allb b ON b.flow_id = dp.flow_id AND b.dialogue_id = dp.dialogue_id AND b.bucket = t.bucket)),
leaf AS (SELECT flow_id, node FROM trie t WHERE NOT EXISTS (SELECT 1 FROM trie c WHERE c.flow_id = t.flow_id AND c.parent = t.node)),
scored AS (SELECT dp.flow_id, dp.dialogue_id, min(dp.r[len(dp.r)]) AS distance, any_value(l.n) AS n_turns, any_value(CASE WHEN t.own = dp.flow_id THEN 'positive' ELSE 'negative' END) AS pool FROM dp JOIN leaf USING (flow_id, node) JOIN len l ON l.flow_id = dp.flow_id AND l.dialogue_id = dp.dialogue_id JOIN test t ON t.flow_id = dp.flow_id AND t.dialogue_id = dp.dialogue_id GROUP BY dp.flow_id, dp.dialogue_id),
sc AS (SELECT *, distance / n_turns AS score FROM scored)"""


@query(f"WITH RECURSIVE {_KERNEL} SELECT flow_id, dialogue_id, n_turns, pool, round(distance, 6) AS distance FROM sc")
def flow_distance_dag(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, Scratch(spark, "scores")).select("flow_id", "dialogue_id", "n_turns", "pool", F.round("distance", 6).alias("distance"))


@query(f"WITH RECURSIVE {_KERNEL} SELECT flow_id, dialogue_id, round(score, 6) AS score FROM sc")
def score_normalised(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d, Scratch(spark, "scores")).select("flow_id", "dialogue_id", F.round("score", 6).alias("score"))


@query(f"WITH RECURSIVE {_KERNEL} SELECT flow_id, count(*) FILTER (pool = 'positive') AS n_pos, count(*) FILTER (pool = 'negative') AS n_neg, round(avg(score) FILTER (pool = 'positive'), 6) AS mean_pos, round(avg(score) FILTER (pool = 'negative'), 6) AS mean_neg, round(coalesce(stddev_samp(score) FILTER (pool = 'positive'), 0), 6) AS std_pos, round(coalesce(stddev_samp(score) FILTER (pool = 'negative'), 0), 6) AS std_neg, round(CASE WHEN avg(score) FILTER (pool = 'positive') > 0 THEN avg(score) FILTER (pool = 'negative') / avg(score) FILTER (pool = 'positive') END, 6) AS ratio, round(avg(score) FILTER (pool = 'negative') - avg(score) FILTER (pool = 'positive'), 6) AS gap FROM sc GROUP BY flow_id")
def discrimination_ratio(spark: SparkSession, d: str) -> DataFrame:
    g = S.discrimination(_scored(spark, d, Scratch(spark, "scores")), "flow_id")
    return g.select("flow_id", "n_pos", "n_neg", *[F.round(c, 6).alias(c) for c in ("mean_pos", "mean_neg", "std_pos", "std_neg", "ratio", "gap")])


#: The kernel with staying on a node for another turn: running costs of that are sums p, one list per bucket.
_DWELL = _KERNEL.replace("list(coalesce(s.s, 1e9) ORDER BY tv.turn) AS s FROM", "list(coalesce(s.s, 1e9) ORDER BY tv.turn) AS s, [0.0::DOUBLE] || list(w.c ORDER BY tv.turn) AS p FROM").replace(
    "LEFT JOIN sub s USING (flow_id, dialogue_id, turn, bucket) GROUP BY ALL)",
    "LEFT JOIN sub s USING (flow_id, dialogue_id, turn, bucket) JOIN (SELECT tv.flow_id, tv.dialogue_id, tv.turn, b.bucket, sum(least(1.0::DOUBLE, coalesce(s.s, 1e9) + 0.25::DOUBLE)) OVER (PARTITION BY tv.flow_id, tv.dialogue_id, b.bucket ORDER BY tv.turn) AS c FROM tv JOIN (SELECT DISTINCT flow_id, bucket FROM trie) b USING (flow_id) LEFT JOIN sub s USING (flow_id, dialogue_id, turn, bucket)) w USING (flow_id, dialogue_id, turn, bucket) GROUP BY ALL)",
).replace("list_min(list_transform(range(0, j + 1), lambda k: a[k + 1] + (j - k)))) FROM", "list_min(list_transform(range(0, j + 1), lambda k: a[k + 1] - p[k + 1])) + p[j + 1]) FROM").replace("AS a\n    FROM dp", "AS a, b.p AS p\n    FROM dp")


@query(f"WITH RECURSIVE {_DWELL} SELECT flow_id, dialogue_id, n_turns, round(distance, 6) AS distance FROM sc")
def flow_distance_dwell(spark: SparkSession, d: str) -> DataFrame:
    """Distances where a node may be kept for a further turn at a quarter of an insertion more than its substitution cost."""
    return _scored(spark, d, Scratch(spark, "scores"), dwell=0.25).select("flow_id", "dialogue_id", "n_turns", F.round("distance", 6).alias("distance"))


@query(f"""WITH RECURSIVE {_KERNEL}, r AS (SELECT flow_id, pool, rank() OVER (PARTITION BY flow_id ORDER BY q) + (count(*) OVER (PARTITION BY flow_id, q) - 1) / 2.0::DOUBLE AS rk FROM (SELECT *, round(score, 9) AS q FROM sc)), g AS (SELECT flow_id, count(*) FILTER (pool = 'positive') AS n_pos, count(*) FILTER (pool <> 'positive') AS n_neg, coalesce(sum(rk) FILTER (pool = 'positive'), 0) AS r1 FROM r GROUP BY flow_id)
SELECT flow_id, n_pos, n_neg, r1 - n_pos * (n_pos + 1) / 2 AS u, round(CASE WHEN n_pos > 0 AND n_neg > 0 THEN 1 - 2 * (r1 - n_pos * (n_pos + 1) / 2) / (n_pos * n_neg) END, 6) AS rbc FROM g""")
def mann_whitney_u(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d, Scratch(spark, "scores")).withColumn("score", F.round("score", 9))
    return S.mann_whitney(s, "flow_id").select("flow_id", "n_pos", "n_neg", "u", F.round("rbc", 6).alias("rbc"))


@query(f"""WITH RECURSIVE {_KERNEL}, r AS (SELECT flow_id, own, rank() OVER (PARTITION BY flow_id, own ORDER BY q) + (count(*) OVER (PARTITION BY flow_id, own, q) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY flow_id, own ORDER BY n_turns) + (count(*) OVER (PARTITION BY flow_id, own, n_turns) - 1) / 2.0::DOUBLE AS b FROM (SELECT sc.*, o.own, round(score, 9) AS q FROM sc JOIN (SELECT DISTINCT dialogue_id, own FROM test) o USING (dialogue_id) WHERE pool = 'negative'))
SELECT flow_id, own AS stratum, round(CASE WHEN isfinite(corr(a, b)) THEN corr(a, b) END, 6) + 0.0 AS rho, count(*) AS n FROM r GROUP BY flow_id, own""")
def block_rho(spark: SparkSession, d: str) -> DataFrame:
    """Rank correlation of score and length inside every block of negatives from one stratum."""
    s = _scored(spark, d, Scratch(spark, "scores")).where("pool = 'negative'").withColumn("score", F.round("score", 9))
    s = s.join(C.sides(spark, d).select("dialogue_id", F.concat_ws(":", "corpus", "stratum").alias("stratum")), "dialogue_id")
    return S.spearman(s, "score", "n_turns", "flow_id", "stratum").select("flow_id", "stratum", (F.round("rho", 6) + 0.0).alias("rho"), "n")


@query()
def mw_pvalue(spark: SparkSession, d: str) -> DataFrame:
    tmp = Scratch(spark, "scores")
    u = tmp.put(S.mann_whitney(_scored(spark, d, tmp), "flow_id"))
    return S.mann_whitney_p(u).select("flow_id", "u", F.round("p_less", 9).alias("p_less"))


@query(f"""WITH RECURSIVE {_KERNEL}, r AS (SELECT flow_id, rank() OVER (PARTITION BY flow_id ORDER BY q) + (count(*) OVER (PARTITION BY flow_id, q) - 1) / 2.0::DOUBLE AS a, rank() OVER (PARTITION BY flow_id ORDER BY n_turns) + (count(*) OVER (PARTITION BY flow_id, n_turns) - 1) / 2.0::DOUBLE AS b FROM (SELECT *, round(score, 9) AS q FROM sc))
SELECT flow_id, round(CASE WHEN isfinite(corr(a, b)) THEN corr(a, b) END, 6) AS rho, count(*) AS n FROM r GROUP BY flow_id""")
def spearman_rho(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d, Scratch(spark, "scores")).withColumn("score", F.round("score", 9))
    return S.spearman(s, "score", "n_turns", "flow_id").select("flow_id", F.round("rho", 6).alias("rho"), "n")


@query(f"""WITH RECURSIVE {_KERNEL}, b AS (SELECT flow_id, n_turns // 3 AS bin, count(*) FILTER (pool = 'positive') AS np, count(*) FILTER (pool = 'negative') AS nq, sum(score) FILTER (pool = 'positive') AS sp, avg(score) FILTER (pool = 'negative') AS mq FROM sc GROUP BY ALL)
SELECT flow_id, round(sum(np * mq) FILTER (np >= 2 AND nq >= 2) / sum(sp) FILTER (np >= 2 AND nq >= 2), 6) AS lm_ratio, round(coalesce(sum(np) FILTER (np >= 2 AND nq >= 2) / nullif(sum(np), 0), 0), 6) AS coverage, count(*) FILTER (np >= 2 AND nq >= 2) AS n_bins FROM b GROUP BY flow_id""")
def length_matched_ratio(spark: SparkSession, d: str) -> DataFrame:
    s = _scored(spark, d, Scratch(spark, "scores")).withColumnRenamed("n_turns", "length")
    return S.length_matched(s, "flow_id", least=2).select("flow_id", F.round("lm_ratio", 6).alias("lm_ratio"), F.round("coverage", 6).alias("coverage"), "n_bins")


@query(f"WITH RECURSIVE {_KERNEL} SELECT flow_id, own AS stratum, round(avg(score), 6) AS mean_score, round(avg(score), 6) = min(round(avg(score), 6)) OVER (PARTITION BY own) AS column_min FROM sc JOIN (SELECT DISTINCT dialogue_id, own FROM test) USING (dialogue_id) GROUP BY flow_id, own")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    s = _scored(spark, d, Scratch(spark, "scores")).join(C.sides(spark, d).select("dialogue_id", F.concat_ws(":", "corpus", "stratum").alias("stratum")), "dialogue_id")
    m = s.groupBy("flow_id", "stratum").agg(F.round(F.avg("score"), 6).alias("mean_score"))
    return m.withColumn("column_min", F.col("mean_score") == F.min("mean_score").over(Window.partitionBy("stratum")))


@query(f"""WITH RECURSIVE {_KERNEL}, m AS (SELECT flow_id, own AS stratum, round(avg(score), 6) AS s FROM sc JOIN (SELECT DISTINCT dialogue_id, own FROM test) USING (dialogue_id) GROUP BY flow_id, own), g AS (SELECT flow_id, max(s) FILTER (stratum = flow_id) AS own, min((s, stratum)) FILTER (stratum <> flow_id) AS m FROM m GROUP BY flow_id)
SELECT flow_id, own, m[2] AS nearest, m[1] AS nearest_score, round(m[1] - own, 6) AS gap, own <= m[1] + 1e-9 AS self_best FROM g WHERE own IS NOT NULL AND m IS NOT NULL""")
def confusion_separation(spark: SparkSession, d: str) -> DataFrame:
    """Own and nearest other stratum of every flow of the confusion matrix."""
    m = Scratch(spark, "confusion").put(confusion_matrix(spark, d))
    return R.separation(m).withColumn("gap", F.round("gap", 6))


@query(f"WITH RECURSIVE {_KERNEL} SELECT flow_id, pool, count(*) AS n, round(avg(score), 6) AS mean, round(coalesce(stddev_samp(score), 0), 6) AS std_samp, round(stddev_pop(score), 6) AS std_pop FROM sc GROUP BY flow_id, pool")
def score_moments(spark: SparkSession, d: str) -> DataFrame:
    m = S.moments(_scored(spark, d, Scratch(spark, "scores")), "flow_id", "pool")
    return m.select("flow_id", "pool", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std_samp", "std_pop")])


@query(f"""WITH RECURSIVE {_KERNEL}, p AS (SELECT dialogue_id, min(score) FILTER (pool = 'positive') AS x, avg(score) FILTER (pool = 'negative') AS y FROM sc GROUP BY dialogue_id), dd AS (SELECT round(x - y, 9) AS d FROM p WHERE x IS NOT NULL AND y IS NOT NULL),
r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS rk FROM dd WHERE d <> 0)
SELECT (SELECT count(*) FROM dd) AS n, (SELECT round(median(d), 6) FROM dd) AS median_diff, coalesce(sum(rk) FILTER (d > 0), 0.0::DOUBLE) AS w_plus, coalesce(sum(rk) FILTER (d < 0), 0.0::DOUBLE) AS w_minus FROM r""")
def wilcoxon_w(spark: SparkSession, d: str) -> DataFrame:
    tmp = Scratch(spark, "scores")
    s = tmp.put(_scored(spark, d, tmp))
    p = tmp.put(s.groupBy("dialogue_id").agg(F.min(F.when(F.col("pool") == "positive", F.col("score"))).alias("x"), F.avg(F.when(F.col("pool") == "negative", F.col("score"))).alias("y")).where("x is not null and y is not null"))
    p = p.select("dialogue_id", F.round(F.col("x") - F.col("y"), 9).alias("score"))
    r = S.paired(p, p.select("dialogue_id", F.lit(0.0).alias("score")), "dialogue_id")
    return r.select("n", F.round("median_diff", 6).alias("median_diff"), "w_plus", "w_minus")


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return S.bootstrap_ratio(_scored(spark, d, Scratch(spark, "scores")), "flow_id")


@query()
def permutation_p(spark: SparkSession, d: str) -> DataFrame:
    return S.permutation_p(_scored(spark, d, Scratch(spark, "scores")).withColumnRenamed("n_turns", "length"), "flow_id", least=2)


def _talk(spark: SparkSession, d: str, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """Test turns with their own flow, and the flows' centroids."""
    t = tmp.put(C.conversations(spark, d, True))
    s = C.sides(spark, d)
    cents = tmp.put(G.centroids(G.training_turns(t, s)))
    own = s.where("side = 'test'").select("dialogue_id", F.concat_ws(":", "corpus", "stratum").alias("flow_id"))
    return tmp.put(t.join(own, "dialogue_id")), cents


_NEAR = f"""{CONV}, {SIDES}, {TRAIN}, {CENTROIDS}, talk AS (SELECT c.*, s.corpus || ':' || s.stratum AS flow_id FROM conv c JOIN sides s USING (dialogue_id) WHERE s.side = 'test'),
nd AS (SELECT t.dialogue_id, t.turn, t.flow_id, b.bucket, b.ord, round(1 - list_dot_product(t.vector, b.centroid) / (sqrt(list_dot_product(t.vector, t.vector)) * sqrt(list_dot_product(b.centroid, b.centroid)) + 1e-9), 9) AS d FROM talk t JOIN cent b USING (flow_id, actor) WHERE t.vector IS NOT NULL),
near AS (SELECT dialogue_id, turn, flow_id, arg_min(bucket, (d, ord)) AS bucket, min(d) AS distance FROM nd GROUP BY ALL)"""


@query(f"WITH {_NEAR} SELECT dialogue_id, turn, flow_id, bucket, round(distance, 6) AS distance FROM near")
def nearest_bucket(spark: SparkSession, d: str) -> DataFrame:
    talk, cents = _talk(spark, d, Scratch(spark, "near"))
    return W.nearest_bucket(talk, cents).select("dialogue_id", "turn", "flow_id", "bucket", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_NEAR}, nb AS (SELECT flow_id, actor, count(*) AS k FROM cent GROUP BY ALL), x AS (SELECT t.flow_id, t.dialogue_id, t.turn, t.actor, CASE WHEN coalesce(nb.k, 0) >= 2 THEN coalesce(n.bucket, '') ELSE t.turn::VARCHAR END AS b FROM talk t LEFT JOIN near n USING (flow_id, dialogue_id, turn) LEFT JOIN nb USING (flow_id, actor)),
f AS (SELECT *, CASE WHEN lag(b) OVER w = b THEN 0 ELSE 1 END AS new FROM x WINDOW w AS (PARTITION BY flow_id, dialogue_id, actor ORDER BY turn)), g AS (SELECT *, sum(new) OVER (PARTITION BY flow_id, dialogue_id, actor ORDER BY turn) AS run FROM f), h AS (SELECT flow_id, dialogue_id, actor, run, min(turn) AS first_turn, count(*) AS n_turns FROM g GROUP BY ALL)
SELECT flow_id, dialogue_id, row_number() OVER (PARTITION BY flow_id, dialogue_id ORDER BY first_turn) - 1 AS segment, first_turn::INT AS first_turn, actor, n_turns::INT AS n_turns FROM h""")
def segment_runs(spark: SparkSession, d: str) -> DataFrame:
    talk, cents = _talk(spark, d, Scratch(spark, "segment"))
    return W.segment(talk, cents).select("flow_id", "dialogue_id", "segment", "first_turn", "actor", "n_turns")


@query()
def segment_smoothed(spark: SparkSession, d: str) -> DataFrame:
    talk, cents = _talk(spark, d, Scratch(spark, "segment"))
    return W.segment(talk, cents, min_run=2).drop("vector")


def _points(spark: SparkSession, d: str, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    """Turns of known dialogues as points per actor, and a taxonomy's anchors: the vector of the first turn with each label."""
    t = tmp.put(C.conversations(spark, d, True).where("vector is not null").select((F.col("dialogue_id") * 1000 + F.col("turn")).alias("id"), F.col("actor").alias("g"), "label", "vector"))
    a = t.where("label <> 'unknown'").groupBy("g", "label").agg(F.min(F.struct("id", "vector")).alias("m"))
    a = a.select("g", F.concat_ws(":", "g", "label").alias("anchor"), F.col("m.id").alias("ord"), "m.vector")
    return t.select("id", "g", "vector"), tmp.put(a)


_ANCHOR = f"""{CONV}, pt AS (SELECT dialogue_id * 1000 + turn AS id, actor AS g, label, vector FROM conv WHERE vector IS NOT NULL), an AS (SELECT g, g || ':' || label AS anchor, min(id) AS ord, arg_min(vector, id) AS a FROM pt WHERE label <> 'unknown' GROUP BY g, label),
dd AS (SELECT id, anchor, ord, pt.g, round(1 - list_dot_product(vector, a) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(a, a)) + 1e-9), 9) AS d FROM pt JOIN an USING (g)), asg AS (SELECT id, any_value(g) AS g, arg_min(anchor, (d, ord)) AS anchor, min(d) AS distance FROM dd GROUP BY id)"""


@query(f"WITH {_ANCHOR} SELECT id, anchor, round(distance, 6) AS distance FROM asg")
def assign_nearest_anchor(spark: SparkSession, d: str) -> DataFrame:
    p, a = _points(spark, d, Scratch(spark, "anchors"))
    return L.assign_anchors(p, a).select("id", "anchor", F.round("distance", 6).alias("distance"))


@query(f"""WITH {_ANCHOR}, m AS (SELECT anchor, i, avg(vector[i]) AS m FROM asg JOIN pt USING (id), range(1, 97) r(i) GROUP BY ALL), v AS (SELECT anchor, list(m ORDER BY i) AS v FROM m GROUP BY anchor),
c2 AS (SELECT an.g, an.anchor, an.ord, coalesce(list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))), a) AS a FROM an LEFT JOIN v USING (anchor)), d2 AS (SELECT id, anchor, ord, round(1 - list_dot_product(vector, a) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(a, a)) + 1e-9), 9) AS d FROM pt JOIN c2 USING (g)) SELECT id, arg_min(anchor, (d, ord)) AS anchor FROM d2 GROUP BY id""")
def recentroid_1pass(spark: SparkSession, d: str) -> DataFrame:
    p, a = _points(spark, d, Scratch(spark, "anchors"))
    return L.align(spark, p, a, passes=1)[0].select("id", "anchor")


@query(f"WITH {_ANCHOR}, n AS (SELECT anchor, count(*) AS n FROM asg GROUP BY anchor) SELECT an.g, an.anchor, coalesce(n, 0)::BIGINT AS n, round(coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY an.g), 6) AS share, n IS NULL AS empty FROM an LEFT JOIN n USING (anchor)")
def coverage_report(spark: SparkSession, d: str) -> DataFrame:
    p, a = _points(spark, d, Scratch(spark, "anchors"))
    return L.coverage(L.assign_anchors(p, a), a).withColumn("share", F.round("share", 6))


@query(f"WITH {_ANCHOR}, n AS (SELECT anchor, count(*) AS n FROM asg GROUP BY anchor) SELECT an.g, count(*) AS n_nodes, count(n) AS n_real, count(*) - count(n) AS n_empty, round(count(n) / count(*), 6) AS coverage_frac FROM an LEFT JOIN n USING (anchor) GROUP BY an.g")
def coverage_totals(spark: SparkSession, d: str) -> DataFrame:
    p, a = _points(spark, d, Scratch(spark, "anchors"))
    return L.coverage_totals(L.coverage(L.assign_anchors(p, a), a), "g").withColumn("coverage_frac", F.round("coverage_frac", 6))


@query(f"WITH {_ANCHOR}, k AS (SELECT anchor, id, text, row_number() OVER (PARTITION BY anchor ORDER BY id) AS k FROM asg JOIN (SELECT dialogue_id * 1000 + turn AS id, text FROM conv) USING (id)) SELECT anchor, string_agg(text, ' | ' ORDER BY id) AS samples FROM k WHERE k <= 3 GROUP BY anchor")
def coverage_samples(spark: SparkSession, d: str) -> DataFrame:
    """The first three texts of every anchor."""
    tmp = Scratch(spark, "anchors")
    p, a = _points(spark, d, tmp)
    text = C.conversations(spark, d).select((F.col("dialogue_id") * 1000 + F.col("turn")).alias("id"), "text")
    return L.coverage_samples(L.assign_anchors(p, a), text).select("anchor", F.array_join("samples", " | ").alias("samples"))


@query(f"WITH {_ANCHOR}, l AS (SELECT id, g AS actor, label, g || ':' || label AS al FROM pt) SELECT l.id, CASE WHEN t.label IS NOT NULL THEN l.al ELSE asg.anchor END AS label, t.label IS NOT NULL AS valid FROM l LEFT JOIN (SELECT DISTINCT actor, label FROM taxonomy) t ON t.actor = l.actor AND t.label = l.label LEFT JOIN asg USING (id)")
def nearest_taxonomy_fallback(spark: SparkSession, d: str) -> DataFrame:
    tmp = Scratch(spark, "fallback")
    p, a = _points(spark, d, tmp)
    t = C.conversations(spark, d, True).where("vector is not null").select((F.col("dialogue_id") * 1000 + F.col("turn")).alias("id"), "actor", F.concat_ws(":", "actor", "label").alias("label"))
    valid = read(spark, d, "taxonomy").select("actor", F.concat_ws(":", "actor", "label").alias("label"))
    return L.fallback_labels(t, valid, L.assign_anchors(p, a))


@query(f"WITH {_ANCHOR}, mm AS (SELECT g, i, avg(vector[i]) AS m FROM pt, range(1, 97) r(i) GROUP BY ALL), v AS (SELECT g, list(m ORDER BY i) AS v FROM mm GROUP BY g), q AS (SELECT pt.g, id, round(1 - list_dot_product(vector, v) / (sqrt(list_dot_product(vector, vector)) * sqrt(list_dot_product(v, v)) + 1e-9), 9) AS d FROM pt JOIN v USING (g)) SELECT g, id, rank::INT AS rank FROM (SELECT g, id, row_number() OVER (PARTITION BY g ORDER BY d, id) AS rank FROM q) WHERE rank <= 5")
def cluster_representatives(spark: SparkSession, d: str) -> DataFrame:
    p, _ = _points(spark, d, Scratch(spark, "representatives"))
    return L.representatives(p, 5)


@query()
def kmeans_silhouette(spark: SparkSession, d: str) -> DataFrame:
    """k from 3 to 20 over the unit vectors of all turns."""
    p, _ = _points(spark, d, Scratch(spark, "kmeans"))
    return L.kmeans_sweep(p.select("id", normalised(F.col("vector")).alias("vector")).where("not exists(vector, x -> x is null)"))


@query()
def agglomerative(spark: SparkSession, d: str) -> DataFrame:
    c = Scratch(spark, "linkage").put(G.centroids(_train(spark, d, True)))
    return L.agglomerative(c.select(F.concat_ws("/", "flow_id", "actor").alias("g"), F.col("bucket").alias("id"), F.col("centroid").alias("vector")))


_DAG = r"""n AS (SELECT dag_id, trim(node_id) AS node_id, min(CASE WHEN lower(trim(actor)) IN ('user', 'client') THEN 'user' WHEN lower(trim(actor)) IN ('agent', 'therapist', 'wizard', 'assistant') THEN 'agent' END) AS actor, max(coalesce(trim(label), '')) AS label FROM dag_nodes WHERE node_id IS NOT NULL GROUP BY ALL),
x AS (SELECT DISTINCT dag_id, trim(src) AS src, trim(dst) AS dst FROM dag_edges WHERE src IS NOT NULL AND dst IS NOT NULL),
e AS (SELECT x.* FROM x WHERE src <> dst AND EXISTS (SELECT 1 FROM n WHERE n.dag_id = x.dag_id AND n.node_id = x.src) AND EXISTS (SELECT 1 FROM n WHERE n.dag_id = x.dag_id AND n.node_id = x.dst))"""


def _dag(spark: SparkSession, d: str, tmp: Scratch) -> tuple[DataFrame, DataFrame]:
    from flowspark.sources.tables import actor_side

    n = read(spark, d, "dag_nodes").where("node_id is not null").groupBy("dag_id", F.trim("node_id").alias("node_id")).agg(F.min(actor_side("actor")).alias("actor"), F.max(F.coalesce(F.trim("label"), F.lit(""))).alias("label"))
    e = read(spark, d, "dag_edges").where("src is not null and dst is not null").select("dag_id", F.trim("src").alias("src"), F.trim("dst").alias("dst")).distinct()
    return tmp.put(n), tmp.put(e)


@query(f"WITH {_DAG} SELECT * FROM e")
def edge_filter(spark: SparkSession, d: str) -> DataFrame:
    n, e = _dag(spark, d, Scratch(spark, "dag"))
    return G.known_edges(e, n)


@query(f"""WITH {_DAG}, a AS (SELECT dag_id, count(*) AS n_nodes, count(*) FILTER (actor = 'user') AS n_user, count(*) FILTER (actor = 'agent') AS n_agent, count(*) FILTER (actor IS NULL) AS n_unknown, count(*) FILTER (label = '') AS n_unlabelled FROM n GROUP BY dag_id),
b AS (SELECT x.dag_id, count(*) AS n_edges, count(*) FILTER (s.actor = t.actor) AS n_same_actor, count(*) FILTER (src = dst) AS n_loops FROM x JOIN n s ON s.dag_id = x.dag_id AND s.node_id = src JOIN n t ON t.dag_id = x.dag_id AND t.node_id = dst GROUP BY x.dag_id)
SELECT a.*, coalesce(n_edges, 0)::BIGINT AS n_edges, coalesce(n_same_actor, 0)::BIGINT AS n_same_actor, coalesce(n_loops, 0)::BIGINT AS n_loops FROM a LEFT JOIN b USING (dag_id)""")
def dag_stats(spark: SparkSession, d: str) -> DataFrame:
    n, e = _dag(spark, d, Scratch(spark, "dag"))
    return G.dag_stats(n, e)


@query(f"""WITH RECURSIVE {_DAG}, k AS (SELECT x.* FROM x WHERE EXISTS (SELECT 1 FROM n WHERE n.dag_id = x.dag_id AND n.node_id = x.src) AND EXISTS (SELECT 1 FROM n WHERE n.dag_id = x.dag_id AND n.node_id = x.dst)), up(dag_id, v, a) AS (SELECT dag_id, dst, src FROM k UNION SELECT up.dag_id, up.v, k.src FROM up JOIN k ON k.dag_id = up.dag_id AND k.dst = up.a),
c AS (SELECT dag_id, count(DISTINCT v) AS n_on FROM up WHERE v = a GROUP BY dag_id), w(dag_id, v, a) AS (SELECT dag_id, node_id, node_id FROM n UNION SELECT w.dag_id, w.v, o.b FROM w JOIN (SELECT dag_id, src AS a, dst AS b FROM k UNION SELECT dag_id, dst, src FROM k) o ON o.dag_id = w.dag_id AND o.a = w.a),
p AS (SELECT dag_id, count(DISTINCT low) AS n_parts FROM (SELECT dag_id, v, min(a) AS low FROM w GROUP BY dag_id, v) GROUP BY dag_id), r AS (SELECT dag_id, count(*) AS n_roots FROM n WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.dag_id = n.dag_id AND k.dst = n.node_id) GROUP BY dag_id),
s AS (SELECT k.dag_id, count(*) FILTER (s.actor = t.actor) AS same FROM k JOIN n s ON s.dag_id = k.dag_id AND s.node_id = src JOIN n t ON t.dag_id = k.dag_id AND t.node_id = dst GROUP BY k.dag_id), g AS (SELECT dag_id, bool_and(actor IS NOT NULL) AS actors_known FROM n GROUP BY dag_id)
SELECT g.dag_id, c.dag_id IS NULL AS acyclic, coalesce(r.n_roots, 0)::BIGINT AS n_roots, coalesce(c.n_on, 0)::BIGINT AS n_on_cycle, p.n_parts AS n_components, coalesce(same, 0) = 0 AS alternates, actors_known, c.dag_id IS NULL AND p.n_parts <= 1 AND coalesce(same, 0) = 0 AND actors_known AS ok FROM g JOIN p USING (dag_id) LEFT JOIN c USING (dag_id) LEFT JOIN r USING (dag_id) LEFT JOIN s USING (dag_id)""")
def dag_validity(spark: SparkSession, d: str) -> DataFrame:
    n, e = _dag(spark, d, Scratch(spark, "dag"))
    return G.dag_validity(hierarchy(spark, n, e, paths=False), n, e)


@query(f"""WITH RECURSIVE {_DAG}, z AS (SELECT dag_id, node_id FROM n WHERE label = ''), p(dag_id, src, dst) AS (SELECT e.dag_id, src, dst FROM e WHERE NOT EXISTS (SELECT 1 FROM z WHERE z.dag_id = e.dag_id AND z.node_id = e.src) UNION SELECT p.dag_id, p.src, e.dst FROM p JOIN z ON z.dag_id = p.dag_id AND z.node_id = p.dst JOIN e ON e.dag_id = p.dag_id AND e.src = p.dst),
k AS (SELECT * FROM p WHERE src <> dst AND NOT EXISTS (SELECT 1 FROM z WHERE z.dag_id = p.dag_id AND z.node_id = p.dst)), l AS (SELECT dag_id, node_id FROM n WHERE label <> '')
SELECT * FROM k UNION ALL SELECT dag_id, '__ROOT__', node_id FROM l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.dag_id = l.dag_id AND k.dst = l.node_id)""")
def excise_empty_nodes(spark: SparkSession, d: str) -> DataFrame:
    n, e = _dag(spark, d, Scratch(spark, "dag"))
    return G.excise(G.known_edges(e, n), n, n.where("label = ''"))


@query()
def cycle_breaking(spark: SparkSession, d: str) -> DataFrame:
    n, e = _dag(spark, d, Scratch(spark, "dag"))
    return acyclic_edges(n, e.join(n.withColumnRenamed("node_id", "src"), ["dag_id", "src"], "left_semi").join(n.withColumnRenamed("node_id", "dst"), ["dag_id", "dst"], "left_semi"))


@query(f"WITH {_DAG} SELECT dag_id AS diagram_id, 'edge' AS kind, src AS a, dst AS b FROM e UNION ALL SELECT dag_id, 'node', node_id, label FROM n WHERE regexp_full_match(node_id, '[A-Za-z_][A-Za-z0-9_]*')")
def mermaid_parse(spark: SparkSession, d: str) -> DataFrame:
    """Every flow graph written as diagram text and read again."""
    n, e = _dag(spark, d, Scratch(spark, "dag"))
    line = n.select("dag_id", F.concat(F.lit("  "), F.col("node_id"), F.lit("["), F.col("label"), F.lit("]")).alias("line")).unionByName(G.known_edges(e, n).select("dag_id", F.concat(F.lit("  "), F.col("src"), F.lit(" --> "), F.col("dst")).alias("line")))
    text = line.groupBy(F.col("dag_id").alias("diagram_id")).agg(F.concat(F.lit("Here it is:\n```mermaid\ngraph TD\n"), F.array_join(F.sort_array(F.collect_list("line")), "\n"), F.lit("\n```\n")).alias("text"))
    return mermaid(text).select("diagram_id", "kind", "a", "b")


@query(f"""WITH {CONV}, {SIDES}, {TRAIN}, p AS (SELECT s.dialogue_id, s.corpus || ':' || s.stratum AS flow_id, list(left(c.actor, 1) || ':' || c.label ORDER BY turn) AS t FROM conv c JOIN sides s USING (dialogue_id) WHERE s.side = 'test' GROUP BY ALL), q AS (SELECT flow_id, dialogue_id AS path_id, list(bucket ORDER BY turn) AS path FROM train GROUP BY ALL)
SELECT p.dialogue_id, p.flow_id, min(list_reduce([list_transform(range(0, len(t) + 1), lambda i: i::DOUBLE)] || list_transform(path, lambda x: [NULL::DOUBLE] || list_transform(t, lambda y: CASE WHEN x = y THEN 0.0::DOUBLE ELSE 2.0::DOUBLE END)), lambda o, s: list_transform(range(0, len(o)), lambda j: list_min(list_transform(range(0, j + 1), lambda k: (CASE WHEN k = 0 THEN o[1] + 1 ELSE least(o[k + 1] + 1, o[k] + s[k + 1]) END) + (j - k))))) [len(t) + 1]) AS distance FROM p JOIN q USING (flow_id) GROUP BY p.dialogue_id, p.flow_id""")
def path_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    """Least edit distance of a test dialogue's intents to any training dialogue's of its stratum."""
    tmp = Scratch(spark, "paths")
    t, s = tmp.put(C.conversations(spark, d)), C.sides(spark, d)
    x = t.join(s, "dialogue_id").select("dialogue_id", F.concat_ws(":", "corpus", "stratum").alias("flow_id"), "side", "turn", G.bucket_name().alias("b"))
    x = tmp.put(x.groupBy("dialogue_id", "flow_id", "side").agg(F.sort_array(F.collect_list(F.struct("turn", "b"))).alias("v")).select("dialogue_id", "flow_id", "side", F.col("v.b").alias("v")))
    x = x.withColumnRenamed("v", "labels")
    return K.path_distances(x.where("side = 'test'"), x.where("side = 'train'")).select("dialogue_id", "flow_id", "distance")
