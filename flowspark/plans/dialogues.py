"""Queries on turns, texts, metadata and labels."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.functions import text as T
from flowspark.operators import conversations as C
from flowspark.operators import labelling as L
from flowspark.operators import statistics as S
from flowspark.plans.base import CONV, LATEST, SIDES
from flowspark.session import Scratch, small_broadcast
from flowspark.sources.tables import latest, read

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {CONV} SELECT dialogue_id, turn, actor, text, label FROM conv")
def turns(spark: SparkSession, d: str) -> DataFrame:
    return C.conversations(spark, d)


@query(f"""WITH {CONV}, a AS (SELECT *, first_value(CASE WHEN actor = 'agent' AND label <> 'unknown' THEN label END IGNORE NULLS) OVER (PARTITION BY dialogue_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM conv)
SELECT dialogue_id, turn, CASE WHEN actor = 'agent' THEN label ELSE coalesce('user_before_' || nxt, 'unknown') END AS intent FROM a""")
def user_context_label(spark: SparkSession, d: str) -> DataFrame:
    return C.context_labels(C.conversations(spark, d)).select("dialogue_id", "turn", "intent")


_OVERRIDE = """ lab AS (SELECT dialogue_id, turn, upper(label) AS label FROM conv WHERE dialogue_id % 2 = 0)"""


@query(f"WITH {CONV}, {_OVERRIDE} SELECT c.dialogue_id, c.turn, c.actor, c.text, l.label FROM conv c JOIN lab l USING (dialogue_id, turn)")
def label_override(spark: SparkSession, d: str) -> DataFrame:
    t = C.conversations(spark, d)
    given = t.where("dialogue_id % 2 = 0").select("dialogue_id", "turn", F.upper("label").alias("label"))  # a second source that labels some dialogues
    return C.override_labels(t, given)


@query(f"WITH {CONV} SELECT dialogue_id, turn, CASE WHEN actor = 'user' THEN '_user_turn' ELSE label END AS label FROM conv")
def sentinel_labels(spark: SparkSession, d: str) -> DataFrame:
    return C.sentinel_labels(C.conversations(spark, d)).select("dialogue_id", "turn", "label")


@query(f"WITH {CONV} SELECT actor, text, m[1] AS dialogue_id, m[2]::INT AS turn FROM (SELECT actor, text, min([dialogue_id, turn]) AS m FROM conv WHERE text <> '' GROUP BY actor, text)")
def text_dedupe_by_actor(spark: SparkSession, d: str) -> DataFrame:
    return C.first_texts(C.conversations(spark, d))


@query(f"WITH {CONV}, n AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id ORDER BY turn) - 1 AS i FROM conv) SELECT dialogue_id, string_agg('  [' || i || '] (' || actor || ') ' || text, chr(10) ORDER BY turn) AS rendered FROM n GROUP BY dialogue_id")
def dialogue_render(spark: SparkSession, d: str) -> DataFrame:
    return C.packed(C.conversations(spark, d)).select("dialogue_id", T.render_dialogue(F.col("turns")).alias("rendered"))


@query(f"WITH {CONV}, t AS (SELECT dialogue_id, string_agg(CASE WHEN actor = 'agent' THEN 'Therapist: ' ELSE 'Client: ' END || text, chr(10) ORDER BY turn) AS t FROM conv GROUP BY dialogue_id) SELECT dialogue_id, CASE WHEN length(t) > 600 THEN left(t, 600) || chr(10) || '[truncated]' ELSE t END AS transcript FROM t")
def transcript_render(spark: SparkSession, d: str) -> DataFrame:
    return C.packed(C.conversations(spark, d)).select("dialogue_id", T.render_transcript(F.col("turns"), 600).alias("transcript"))


@query(f"""WITH {CONV}, p AS (SELECT dialogue_id, list(turn ORDER BY turn) AS ts, count(*) AS n FROM conv GROUP BY dialogue_id),
e AS (SELECT dialogue_id, ts, n, i, greatest(0, i - 2) AS s FROM p, range(0, n) r(i)), f AS (SELECT *, least(n, s + 5) AS e2 FROM e), g AS (SELECT *, greatest(0, e2 - 5) AS s2 FROM f)
SELECT dialogue_id, ts[i + 1] AS turn, array_to_string(ts[s2 + 1:e2], ',') AS window_turns FROM g""")
def context_window(spark: SparkSession, d: str) -> DataFrame:
    p = C.packed(C.conversations(spark, d)).select("dialogue_id", F.col("turns.turn").alias("ts"))
    x = p.select("dialogue_id", "ts", F.posexplode("ts").alias("i", "turn"))
    return x.select("dialogue_id", "turn", F.array_join(T.context_window(F.col("ts"), F.col("i"), 5), ",").alias("window_turns"))


_STARTS = "CASE WHEN n <= 0 THEN [] WHEN n <= 5 THEN [0] ELSE list_sort(list_distinct(range(0, n - 5 + 1, 4) || [n - 5])) END"


@query(f"WITH {CONV}, p AS (SELECT dialogue_id, count(*) AS n FROM conv GROUP BY dialogue_id) SELECT dialogue_id, array_to_string({_STARTS}, ',') AS starts FROM p")
def chunk_starts(spark: SparkSession, d: str) -> DataFrame:
    n = C.conversations(spark, d).groupBy("dialogue_id").agg(F.count(F.lit(1)).cast("int").alias("n"))
    return n.select("dialogue_id", F.array_join(T.chunk_starts(F.col("n"), 5, 4), ",").alias("starts"))


@query(f"""WITH {CONV}, k AS (SELECT dialogue_id, turn, label, row_number() OVER (PARTITION BY dialogue_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY dialogue_id) AS n FROM conv),
c AS (SELECT *, unnest({_STARTS}) AS start FROM k), o AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id, turn ORDER BY start DESC) AS r FROM c WHERE i >= start AND i < start + 5)
SELECT dialogue_id, turn, label || '@' || start AS label FROM o WHERE r = 1""")
def chunk_last_wins(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("dialogue_id")
    k = C.conversations(spark, d).withColumn("i", F.row_number().over(w.orderBy("turn")) - 1).withColumn("n", F.count(F.lit(1)).over(w).cast("int"))
    c = k.select("dialogue_id", "turn", "label", "i", F.explode(T.chunk_starts(F.col("n"), 5, 4)).alias("start")).where("i >= start and i < start + 5")
    return L.last_chunk_wins(c.withColumn("label", F.concat("label", F.lit("@"), F.col("start").cast("string"))))


@query(f"""WITH {CONV}, ft AS (SELECT actor, text, min([dialogue_id, turn]) AS m FROM conv WHERE text <> '' GROUP BY actor, text), x AS (SELECT actor, text, row_number() OVER (PARTITION BY actor ORDER BY m[1], text) - 1 AS i FROM ft),
t AS (SELECT actor, count(*) AS n, sum(length(text) + 8) AS s FROM x GROUP BY actor), k AS (SELECT *, CASE WHEN s <= 20000 THEN n ELSE least(n, greatest(50, floor(n * 20000 / s))) END AS k FROM t)
SELECT x.actor, text FROM x JOIN k USING (actor) WHERE floor(ceil(i * k / n) * n / k) = i AND ceil(i * k / n) < k""")
def even_sample(spark: SparkSession, d: str) -> DataFrame:
    return T.even_sample(C.first_texts(C.conversations(spark, d)), "actor", "dialogue_id", "text", 20_000).select("actor", "text")


@query(f"WITH {CONV} SELECT dialogue_id, (sum(length(text)) // 4)::BIGINT AS tokens FROM conv GROUP BY dialogue_id")
def token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return C.packed(C.conversations(spark, d)).select("dialogue_id", T.token_estimate(F.col("turns.text")).alias("tokens"))


@query(f"WITH {CONV}, t AS (SELECT dialogue_id, (sum(length(text)) // 4)::BIGINT AS n FROM conv GROUP BY dialogue_id), p(model, price) AS (VALUES ('small', 0.25), ('large', 2.5)) SELECT dialogue_id, model, round(n * price::DOUBLE / 1e6, 9) AS cost FROM t, p")
def cost_estimate(spark: SparkSession, d: str) -> DataFrame:
    prices = spark.createDataFrame([("small", 0.25), ("large", 2.5)], "model string, price double")
    return token_estimate(spark, d).crossJoin(F.broadcast(prices)).select("dialogue_id", "model", F.round(F.col("tokens") * F.col("price") / 1e6, 9).alias("cost"))


@query(f"WITH {CONV}, n AS (SELECT dialogue_id, count(*) AS n FROM conv GROUP BY dialogue_id) SELECT (n // 3)::BIGINT AS bin, count(*) AS n_dialogues FROM n GROUP BY 1")
def length_bins(spark: SparkSession, d: str) -> DataFrame:
    n = C.conversations(spark, d).groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy(F.floor(F.col("n") / 3).alias("bin")).agg(F.count(F.lit(1)).alias("n_dialogues"))


_CUE_SQL = ", ".join(f"round(avg(regexp_matches(t, '{p}')::INT), 6) AS {k}" for k, p in T.CUES.items())
_PHASE = "TRY_CAST(nullif(regexp_extract(coalesce(phase, ''), '(\\d+)', 1), '') AS INT)"


@query(f"""WITH {CONV}, t AS (SELECT dialogue_id, lower(string_agg(text, ' ' ORDER BY turn)) AS t FROM conv GROUP BY dialogue_id), m AS (SELECT dialogue_id, min({_PHASE}) AS phase FROM dialogues GROUP BY dialogue_id)
SELECT phase, count(*) AS n_dialogues, {_CUE_SQL} FROM t JOIN m USING (dialogue_id) WHERE phase IS NOT NULL GROUP BY phase""")
def cue_fraction_by_phase(spark: SparkSession, d: str) -> DataFrame:
    t = C.packed(C.conversations(spark, d)).select("dialogue_id", F.lower(F.array_join("turns.text", " ")).alias("t"))
    x = t.join(_phases(spark, d), "dialogue_id").where("phase is not null")
    return x.groupBy("phase").agg(F.count(F.lit(1)).alias("n_dialogues"), *[F.round(F.avg(F.col("t").rlike(p).cast("int")), 6).alias(k) for k, p in T.CUES.items()])


def _phases(spark: SparkSession, d: str) -> DataFrame:
    p = F.regexp_extract(F.coalesce("phase", F.lit("")), r"(\d+)", 1).try_cast("int")
    return read(spark, d, "dialogues").select("dialogue_id", p.alias("phase")).groupBy("dialogue_id").agg(F.min("phase").alias("phase"))


@query(f"""WITH {CONV}, w AS (SELECT dialogue_id, actor, CASE WHEN text = '' THEN 0 ELSE len(string_split(text, ' ')) END AS n FROM conv), m AS (SELECT dialogue_id, min({_PHASE}) AS phase FROM dialogues GROUP BY dialogue_id)
SELECT phase, actor, count(*) AS n_turns, round(avg(n), 4) AS mean_words, median(n)::DOUBLE AS median_words FROM w JOIN m USING (dialogue_id) GROUP BY phase, actor""")
def word_stats(spark: SparkSession, d: str) -> DataFrame:
    w = C.conversations(spark, d).select("dialogue_id", "actor", T.word_count(F.col("text")).alias("n")).join(_phases(spark, d), "dialogue_id")
    return w.groupBy("phase", "actor").agg(F.count(F.lit(1)).alias("n_turns"), F.round(F.avg("n"), 4).alias("mean_words"), F.median("n").alias("median_words"))


@query(f"WITH s AS (SELECT subject, count(DISTINCT {_PHASE}) AS k FROM dialogues WHERE subject IS NOT NULL GROUP BY subject) SELECT k AS n_phases, count(*) AS n_subjects FROM s GROUP BY k")
def phases_per_subject(spark: SparkSession, d: str) -> DataFrame:
    p = F.regexp_extract(F.coalesce("phase", F.lit("")), r"(\d+)", 1).try_cast("int")
    s = read(spark, d, "dialogues").where("subject is not null").groupBy("subject").agg(F.countDistinct(p).alias("n_phases"))
    return s.groupBy("n_phases").agg(F.count(F.lit(1)).alias("n_subjects"))


@query(f"""WITH {CONV}, m AS (SELECT dialogue_id, min(subject) AS subject, min({_PHASE}) AS phase FROM dialogues GROUP BY dialogue_id), o AS (SELECT * FROM m WHERE phase IS NOT NULL AND subject IS NOT NULL AND dialogue_id IN (SELECT dialogue_id FROM conv)),
f AS (SELECT subject, phase, min(dialogue_id) AS dialogue_id FROM o WHERE subject = (SELECT min(subject) FROM o) GROUP BY subject, phase), k AS (SELECT f.subject, f.phase, c.turn, c.actor, c.text, row_number() OVER (PARTITION BY dialogue_id ORDER BY c.turn) AS k, count(*) OVER (PARTITION BY dialogue_id) AS n FROM f JOIN conv c USING (dialogue_id))
SELECT subject, phase, turn, actor, text, greatest(n - 8, 0) AS more_turns FROM k WHERE k <= 8""")
def transcript_sampler(spark: SparkSession, d: str) -> DataFrame:
    """The first eight turns per phase of the first subject, with the number of further turns."""
    from pyspark.sql import Window

    t = C.conversations(spark, d)
    subject = read(spark, d, "dialogues").groupBy("dialogue_id").agg(F.min("subject").alias("subject"))
    p = Scratch(spark, "sampler").put(_phases(spark, d).join(subject, "dialogue_id").where("phase is not null and subject is not null").join(t.select("dialogue_id").distinct(), "dialogue_id", "left_semi"))
    first = p.join(small_broadcast(p.agg(F.min("subject").alias("subject"))), "subject").groupBy("subject", "phase").agg(F.min("dialogue_id").alias("dialogue_id"))
    w = Window.partitionBy("dialogue_id")
    x = t.join(small_broadcast(first), "dialogue_id").withColumn("k", F.row_number().over(w.orderBy("turn"))).withColumn("n", F.count(F.lit(1)).over(w))
    return x.where("k <= 8").select("subject", "phase", "turn", "actor", "text", F.greatest(F.col("n") - 8, F.lit(0)).alias("more_turns"))


@query(f"WITH {CONV} SELECT dialogue_id, min(actor) AS actor, min(label) AS label, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY dialogue_id ORDER BY turn) AS run FROM (SELECT *, CASE WHEN lag(actor) OVER w = actor AND lag(label) OVER w = label THEN 0 ELSE 1 END AS new FROM conv WINDOW w AS (PARTITION BY dialogue_id ORDER BY turn))) GROUP BY dialogue_id, run")
def rle_runs(spark: SparkSession, d: str) -> DataFrame:
    return C.run_lengths(C.conversations(spark, d)).drop("run")


@query(f"WITH {SIDES} SELECT corpus, stratum, side, count(*) AS n FROM sides GROUP BY ALL")
def split_sizes(spark: SparkSession, d: str) -> DataFrame:
    return C.sides(spark, d).groupBy("corpus", "stratum", "side").agg(F.count(F.lit(1)).alias("n"))


_SPLIT = f"""WITH {SIDES}, i AS (SELECT dialogue_id, corpus || ':' || stratum AS stratum FROM sides), n AS (SELECT *, count(*) OVER (PARTITION BY stratum) AS n, row_number() OVER (PARTITION BY stratum ORDER BY md5('0-' || dialogue_id), dialogue_id) AS k FROM i)
SELECT stratum, dialogue_id, CASE WHEN k <= greatest(1, round_even(n * 0.7::DOUBLE, 0)) THEN 'train' ELSE 'test' END AS side FROM n WHERE n >= 10"""


@query(_SPLIT)
def stratified_split(spark: SparkSession, d: str) -> DataFrame:
    i = C.sides(spark, d).select("dialogue_id", F.concat_ws(":", "corpus", "stratum").alias("stratum"))
    return S.stratified_split(i, "stratum", "dialogue_id", 0.7, 0, least=10).select("stratum", "dialogue_id", "side")


@query(f"""WITH {SIDES}, i AS (SELECT dialogue_id, corpus || ':' || stratum AS stratum FROM sides), h AS (SELECT stratum, count(*) // 2 AS half FROM i GROUP BY stratum), s AS (SELECT i.*, r.split, md5('0-' || r.split || '-' || dialogue_id) AS h FROM i, range(0, 3) r(split)),
p AS (SELECT split, s.stratum, dialogue_id, row_number() OVER (PARTITION BY split, s.stratum ORDER BY s.h, dialogue_id) AS k, half FROM s JOIN h USING (stratum)), g AS (SELECT split, h.stratum, dialogue_id, row_number() OVER (PARTITION BY split, h.stratum ORDER BY s.h, dialogue_id) AS k, half FROM s JOIN h ON s.stratum <> h.stratum)
SELECT split::INT AS split, stratum, dialogue_id, 'positive' AS pool FROM p WHERE k <= half UNION ALL SELECT split::INT, stratum, dialogue_id, 'negative' FROM g WHERE k <= half""")
def multi_split_sample(spark: SparkSession, d: str) -> DataFrame:
    i = C.sides(spark, d).select("dialogue_id", F.concat_ws(":", "corpus", "stratum").alias("stratum"))
    return S.multi_split(i, "stratum", "dialogue_id", 3)


@query("""WITH e AS (SELECT corpus, actor, string_agg('{"description": ' || coalesce(to_json(description)::VARCHAR, 'null') || ', "label": ' || to_json(label)::VARCHAR || '}', ', ' ORDER BY ord) AS t FROM taxonomy GROUP BY corpus, actor)
SELECT corpus, left(sha256('{' || string_agg('"' || actor || '": [' || t || ']', ', ' ORDER BY actor) || '}'), 16) AS version FROM e GROUP BY corpus""")
def taxonomy_hash(spark: SparkSession, d: str) -> DataFrame:
    return L.taxonomy_version(read(spark, d, "taxonomy"))


@query(f"WITH {CONV}, t AS (SELECT dialogue_id, string_agg(text, chr(10) ORDER BY turn) AS payload FROM conv GROUP BY dialogue_id) SELECT dialogue_id, sha256('stub' || chr(10) || 'whole' || chr(10) || payload) AS key FROM t")
def cache_key(spark: SparkSession, d: str) -> DataFrame:
    return _calls(spark, d).select("dialogue_id", "key")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    p = C.packed(C.conversations(spark, d)).select("dialogue_id", F.array_join("turns.text", "\n").alias("payload"))
    return p.withColumn("key", L.cache_key(F.lit("stub"), F.lit("whole"), F.col("payload")))


def _stub(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"key": b["key"], "response": b["payload"].str.len().astype(str)})


@query(f"WITH {CONV}, t AS (SELECT dialogue_id, string_agg(text, chr(10) ORDER BY turn) AS payload FROM conv GROUP BY dialogue_id), k AS (SELECT sha256('stub' || chr(10) || 'whole' || chr(10) || payload) AS key, min(payload) AS payload, bool_or(dialogue_id % 3 = 0) AS hit FROM t GROUP BY 1) SELECT key, CASE WHEN hit THEN 'cached' ELSE length(payload)::VARCHAR END AS response, hit FROM k")
def cached_labelling(spark: SparkSession, d: str) -> DataFrame:
    calls = _calls(spark, d)
    cache = calls.where("dialogue_id % 3 = 0").select("key", F.lit("cached").alias("response")).distinct()  # a cache that holds some calls
    return L.cached_calls(calls, cache, _stub)


@query(r"SELECT corpus, actor, m.ord, m.label, m.description FROM (SELECT corpus, actor, min({'ord': ord, 'label': label, 'description': description}) AS m FROM taxonomy GROUP BY corpus, actor, regexp_replace(lower(label), '[^\p{L}\p{N}]+', '', 'g'))")
def taxonomy_dedupe(spark: SparkSession, d: str) -> DataFrame:
    return L.dedupe_taxonomy(read(spark, d, "taxonomy"))


_LABELS = r"l AS (SELECT row_number() OVER (ORDER BY corpus, actor, ord) AS ord, regexp_replace(label, '^user_before_', '') AS label FROM taxonomy)"


@query(f"""WITH RECURSIVE {_LABELS}, p AS (SELECT a.ord AS a, b.ord AS b FROM l a JOIN l b ON a.label = b.label), r AS (SELECT a, min(b) AS rep FROM p GROUP BY a), n AS (SELECT rep, label, row_number() OVER (PARTITION BY label ORDER BY rep) AS k FROM (SELECT DISTINCT rep FROM r) JOIN l ON l.ord = rep)
SELECT l.ord, l.label, CASE WHEN n.k > 1 THEN n.label || '_' || n.k ELSE n.label END AS merged FROM l JOIN r ON r.a = l.ord JOIN n USING (rep)""")
def taxonomy_merge(spark: SparkSession, d: str) -> DataFrame:
    w = Window.orderBy("corpus", "actor", "ord")  # a vocabulary
    l = read(spark, d, "taxonomy").withColumn("ord", F.row_number().over(w).cast("long")).select("ord", F.regexp_replace("label", "^user_before_", "").alias("label"))
    same = l.withColumnRenamed("ord", "a").join(l.withColumnRenamed("ord", "b"), "label").where("a < b").select("a", "b")
    return L.merge_labels(spark, l, same)


_RULES = "rules AS (SELECT 'R' || ord AS rule_id, CASE WHEN ord % 2 = 0 THEN 'presence' ELSE 'transition' END AS kind FROM taxonomy WHERE corpus = 'TV' AND actor = 'agent')"
_VERDICTS = "v AS (SELECT dialogue_id AS session_id, 'R' || turn AS rule_id, max(CASE WHEN actor = 'agent' THEN 1 ELSE -1 END) AS score FROM conv WHERE turn % 3 > 0 GROUP BY ALL)"


def _verdicts(spark: SparkSession, d: str) -> DataFrame:
    rules = read(spark, d, "taxonomy").where("corpus = 'TV' and actor = 'agent'").select(F.concat(F.lit("R"), F.col("ord").cast("string")).alias("rule_id"), F.when(F.col("ord") % 2 == 0, "presence").otherwise("transition").alias("kind"))
    v = C.conversations(spark, d).where("turn % 3 > 0").select(F.col("dialogue_id").alias("session_id"), F.concat(F.lit("R"), F.col("turn").cast("string")).alias("rule_id"), F.when(F.col("actor") == "agent", 1).otherwise(-1).alias("score"))
    return L.verdict_scores(small_broadcast(rules), v)


@query(f"WITH {CONV}, {_RULES}, {_VERDICTS} SELECT s.session_id, r.rule_id, r.kind, coalesce(v.score, 0)::INT AS score FROM (SELECT DISTINCT session_id FROM v) s, rules r LEFT JOIN v ON v.session_id = s.session_id AND v.rule_id = r.rule_id")
def verdict_alignment(spark: SparkSession, d: str) -> DataFrame:
    return _verdicts(spark, d)


@query(f"""WITH {CONV}, {_RULES}, {_VERDICTS}, a AS (SELECT s.session_id, coalesce(v.score, 0) AS score FROM (SELECT DISTINCT session_id FROM v) s, rules r LEFT JOIN v ON v.session_id = s.session_id AND v.rule_id = r.rule_id)
SELECT session_id, round(avg(CASE WHEN score <> 0 THEN score END), 9) AS score, round((avg(CASE WHEN score <> 0 THEN score END) + 1) / 2, 9) AS adherence, count(*) FILTER (score <> 0) AS n_judged FROM a GROUP BY session_id""")
def session_score(spark: SparkSession, d: str) -> DataFrame:
    s = L.session_scores(_verdicts(spark, d))
    return s.select("session_id", F.round("score", 9).alias("score"), F.round("adherence", 9).alias("adherence"), "n_judged")


@query("""WITH r AS (SELECT doc_id, min(rater) AS ra, max(rater) AS rb FROM doc_labels GROUP BY doc_id HAVING min(rater) <> max(rater)), p AS (SELECT a.quality AS x, b.quality AS y FROM r JOIN doc_labels a ON a.doc_id = r.doc_id AND a.rater = r.ra JOIN doc_labels b ON b.doc_id = r.doc_id AND b.rater = r.rb),
c AS (SELECT x, y, count(*) AS n FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY x, y), t AS (SELECT sum(n)::BIGINT AS n, sum(CASE WHEN x = y THEN n ELSE 0 END) / sum(n) AS a FROM c), e AS (SELECT sum(nx * ny) AS k FROM (SELECT x, sum(n) AS nx FROM c GROUP BY x) JOIN (SELECT y AS x, sum(n) AS ny FROM c GROUP BY y) USING (x))
SELECT n, round(a, 9) AS agreement, round((a - k / (n * n)) / (1 - k / (n * n)), 9) AS kappa FROM t, e""")
def rater_kappa(spark: SparkSession, d: str) -> DataFrame:
    l = read(spark, d, "doc_labels")
    r = l.groupBy("doc_id").agg(F.min("rater").alias("ra"), F.max("rater").alias("rb")).where("ra <> rb")
    p = r.join(l.select("doc_id", F.col("rater").alias("ra"), F.col("quality").alias("x")), ["doc_id", "ra"]).join(l.select("doc_id", F.col("rater").alias("rb"), F.col("quality").alias("y")), ["doc_id", "rb"])
    k = S.kappa(p, "x", "y")
    return k.select("n", F.round("agreement", 9).alias("agreement"), F.round("kappa", 9).alias("kappa"))


@query("SELECT corpus, side, stratum, count(*) AS n FROM (SELECT split_part(version, '_', 1) AS corpus, lower(trim(side)) AS side, trim(stratum) AS stratum FROM split_members WHERE version IN ('TV_v1', 'STAR_v2')) GROUP BY CUBE (corpus, side, stratum)")
def result_cube(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "split_members").where(F.col("version").isin(C.CURRENT_VERSIONS))
    s = s.select(F.split("version", "_")[0].alias("corpus"), F.lower(F.trim("side")).alias("side"), F.trim("stratum").alias("stratum"))
    return s.cube("corpus", "side", "stratum").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LATEST} SELECT corpus, actor_n, n FROM (SELECT coalesce(corpus, 'none') AS corpus, count(DISTINCT lower(trim(actor))) AS actor_n, count(*) AS n FROM u GROUP BY 1)")
def delivery_summary(spark: SparkSession, d: str) -> DataFrame:
    u = latest(read(spark, d, "utterances"), "utt_id", "corpus", "actor")
    return u.groupBy(F.coalesce("corpus", F.lit("none")).alias("corpus")).agg(F.countDistinct(F.lower(F.trim("actor"))).alias("actor_n"), F.count(F.lit(1)).alias("n"))
