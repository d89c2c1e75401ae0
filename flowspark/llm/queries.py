"""Queries of this package by name, with their SQL where SQL can express them on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm import clusters, groups, leaks, mixing, overlap, runs, toxicity
from flowspark.sources.tables import read


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    f = overlap.cross_split(spark, d)
    return f.select(F.least("a", "b").alias("dialogue_id_a"), F.greatest("a", "b").alias("dialogue_id_b")).distinct()


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    return overlap.cross_split(spark, d)


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.report(overlap.cross_split(spark, d))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return clusters.found(spark, d)


def p2_clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.described(spark, d)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return groups.tv_groups(spark, d).select("dialogue_id", "group_id")


def p4_split(spark: SparkSession, d: str) -> DataFrame:
    return groups.tv_split(spark, d)


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    return groups.split_report(groups.tv_split(spark, d))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return runs.repeated_turns(spark, d).select("dialogue_id", "first_turn", "last_turn")


def p5_runs(spark: SparkSession, d: str) -> DataFrame:
    return runs.repeated_turns(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(spark, read(spark, d, "documents"), read(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(spark, d)


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spark, d)


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(spark, d)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxic_documents(spark, d)


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for k, v in globals().items() if k[0] == "p" and k[1:2].isdigit()}


_P4 = """
t AS (SELECT DISTINCT dialogue_id, 's' || coalesce(subject, try_cast(nullif(regexp_extract(coalesce(stem, ''), '^\\s*(\\d+)_', 1), '') AS BIGINT), dialogue_id // 100) AS k,
        regexp_replace(lower(client_ref), '[^\\p{L}\\p{N}]+', '', 'g') AS ref FROM dialogues WHERE upper(trim(corpus)) = 'TV' AND dialogue_id IS NOT NULL),
link AS (SELECT dialogue_id AS d, k FROM t UNION SELECT dialogue_id, 'c' || ref FROM t WHERE ref NOT IN ('', 'unknown', 'na', 'cl000000')),
near AS (SELECT DISTINCT a.d AS a, b.d AS b FROM link a JOIN link b USING (k)),
reach(a, b) AS (SELECT a, b FROM near UNION SELECT r.a, n.b FROM reach r JOIN near n ON n.a = r.b)
"""
_P5 = """
u AS (SELECT dialogue_id, turn, actor, label, spoken_at FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY loaded_at DESC, dialogue_id DESC) AS rn FROM utterances WHERE utt_id IS NOT NULL) WHERE rn = 1 AND dialogue_id <> -1 AND turn IS NOT NULL),
raw AS (SELECT DISTINCT label AS raw, regexp_replace(lower(label), '[^\\p{L}\\p{N}]+', '', 'g') AS q FROM utterances WHERE label IS NOT NULL),
tax AS (SELECT DISTINCT label, regexp_replace(lower(label), '[^\\p{L}\\p{N}]+', '', 'g') AS p FROM taxonomy),
canon AS (SELECT raw, arg_min(label, (p <> q, label)) AS label FROM raw JOIN tax ON damerau_levenshtein(q, p) <= 1 WHERE q NOT IN ('', 'unknown') GROUP BY raw),
ev AS (SELECT dialogue_id AS d, turn AS o, spoken_at AS t, CASE WHEN lower(trim(actor)) IN ('user', 'client') THEN 'user' WHEN lower(trim(actor)) IN ('agent', 'therapist', 'wizard', 'assistant') THEN 'agent' END AS side, c.label FROM u LEFT JOIN canon c ON c.raw = u.label),
fl AS (SELECT *, CASE WHEN side = lag(side) OVER w AND label = lag(label) OVER w THEN 0 ELSE 1 END AS new FROM ev WINDOW w AS (PARTITION BY d ORDER BY o)),
isl AS (SELECT *, sum(new) OVER (PARTITION BY d ORDER BY o) AS k FROM fl)
"""


_P2 = """
u AS (SELECT utt_id, embedding::DOUBLE[] AS v FROM (SELECT *, row_number() OVER (PARTITION BY utt_id ORDER BY loaded_at DESC) AS rn FROM utterances WHERE utt_id IS NOT NULL) WHERE rn = 1 AND embedding IS NOT NULL),
n AS (SELECT utt_id, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v)))::DOUBLE[96] AS v FROM u WHERE list_dot_product(v, v) > 0),
ve AS (SELECT a.utt_id AS a, b.utt_id AS b FROM n a JOIN n b ON array_inner_product(a.v, b.v) >= 0.75),
vr(a, b) AS (SELECT a, b FROM ve UNION SELECT r.a, e.b FROM vr r JOIN ve e ON e.a = r.b),
vc AS (SELECT a, min(b) AS c FROM vr GROUP BY a HAVING count(*) >= 3),
t AS (SELECT DISTINCT bucket_id AS id, lower(trim(regexp_replace(x, '^\\s+|\\s+$', '', 'g'))) AS x FROM (SELECT bucket_id, unnest(utterances) AS x FROM intent_buckets) WHERE x IS NOT NULL),
s AS (SELECT id, x FROM t WHERE x <> ''), k AS (SELECT id, count(*) AS n FROM s GROUP BY id),
se AS (SELECT a.id AS a, b.id AS b FROM s a JOIN s b USING (x) JOIN k ka ON ka.id = a.id JOIN k kb ON kb.id = b.id GROUP BY a.id, b.id, ka.n, kb.n HAVING count(*) >= 0.5 * (ka.n + kb.n - count(*))),
sr(a, b) AS (SELECT a, b FROM se UNION SELECT r.a, e.b FROM sr r JOIN se e ON e.a = r.b),
sc AS (SELECT a, min(b) AS c FROM sr GROUP BY a HAVING count(*) >= 2)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": f"WITH RECURSIVE {_P2} SELECT 'utterance' AS record_kind, a::VARCHAR AS record_id, c::VARCHAR AS cluster_id FROM vc UNION ALL SELECT 'bucket', a, c FROM sc",
        "p4_found": f"WITH RECURSIVE {_P4} SELECT a AS dialogue_id, min(b) AS group_id FROM reach GROUP BY a",
        "p5_found": f"WITH {_P5} SELECT d AS dialogue_id, min(o)::INT AS first_turn, max(o)::INT AS last_turn FROM isl GROUP BY d, k HAVING count(*) > 1",
        "p5_runs": f"""WITH {_P5} SELECT d AS dialogue_id, min(o)::INT AS first_turn, max(o)::INT AS last_turn, min(side) AS actor, min(label) AS label, count(*) AS n_turns,
round(epoch_us(max(t) - min(t))::DOUBLE / 1e6, 6) AS duration_s FROM isl GROUP BY d, k HAVING count(*) > 1""",
    }
