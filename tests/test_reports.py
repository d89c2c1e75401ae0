"""Prompts, embeddings, summaries and blockwise minima on small cases; every registered query has a unique name and SQL a query."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowspark.functions import prompts as P
from flowspark.operators import embedding as E
from flowspark.operators import reports as R
from flowspark.operators import segments as W
from flowspark.plans import registry


def test_prompts(spark):
    df = spark.createDataFrame([([("a", "first"), ("b", None)], [("agent", "hi"), ("user", None)])], "t array<struct<label:string,description:string>>, u array<struct<actor:string,text:string>>")
    r = df.select(P.taxonomy_block("user", F.col("t")).alias("b"), P.taxonomy_block("agent", F.lit(None).cast("array<struct<label:string,description:string>>")).alias("e"), P.window_prompt(F.lit("x"), F.col("u"), F.lit(1)).alias("w"), P.numbered(F.col("u.text")).alias("n")).first()
    assert r.b == "user:\n- a: first\n- b" and r.e == "agent: (empty)" and r.n == "1. hi\n2. "
    assert "  (agent) hi\n> (user) " in r.w


def test_schemas():
    s = P.whole_schema(["b"], ["a", "b"], 3)["properties"]["labels"]
    assert (s["minItems"], s["maxItems"], s["items"]["enum"]) == (3, 3, ["a", "b"])
    assert P.window_schema([])["properties"]["label"]["enum"] == [P.NO_LABEL]
    assert P.agent_schema(["a"], [1, 3])["properties"]["labels"]["minItems"] == 2


def test_embedders(spark):
    df = spark.createDataFrame([("good day",), ("Day good",), ("",), (None,)], "text string")
    v = {r.text: r.vector for r in E.with_vectors(df, "text", E.hashed_words(16)).collect()}
    assert v["good day"] == v["Day good"] and math.isclose(sum(x * x for x in v["good day"]), 1) and sum(v[""]) == 0 and v[None] is None

    def encode(batches):
        for b in batches:
            yield pd.Series([[float(len(t))] for t in b])

    assert {r.text: r.vector for r in E.with_vectors(df, "text", E.arrow(encode)).collect()}["good day"] == [8.0]
    t = spark.createDataFrame([("good day", [1.0])], "text string, vector array<double>")
    assert {r.text: r.vector for r in E.with_vectors(df, "text", E.lookup(t)).collect()}[""] is None


def test_similar_pairs_and_gate(spark):
    p = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "id long, vector array<double>")
    assert {(r.a, r.b) for r in E.similar_pairs(p, 0.7).collect()} == {(1, 2)}
    l = spark.createDataFrame([("x", [1.0, 0.0])], "label string, vector array<double>")
    g = E.embedding_gate(l, l, spark.createDataFrame([("x", [0.0, 1.0])], "label string, vector array<double>")).first()
    assert (g.pos, g.neg, g.gap, g.passed) == (0.0, 1.0, 1.0, True)


def test_summaries(spark):
    t = spark.createDataFrame([(0.001, 0.2), (0.004, 0.1)], "p double, gap double")
    r = R.pass_count(t).first()
    assert (r.n_tests, r.n_passed, r.threshold, r.passed) == (2, 2, 0.005, True)
    assert R.pass_count(t.limit(0)).first().passed is False
    v = spark.createDataFrame([("a", "p", 1.0), ("a", "q", 3.0), ("b", "p", 2.0), ("b", "q", None)], "variant string, phase string, ratio double")
    assert {(x.variant, x.n_phases, x.best) for x in R.common_phase_summary(v).collect()} == {("a", 1, False), ("b", 1, True)}
    b = spark.createDataFrame([("k", 1.0, True), ("k", 1.5, False)], "k string, ratio double, converged boolean")
    assert tuple(R.budget_stability(b, "k").first()) == ("k", 2, 0.5, False)
    s = spark.createDataFrame([("k", 1.0), ("k", None), ("k", 3.0)], "k string, ratio double")
    assert tuple(R.split_summary(s, "k").first()) == ("k", 2, 2.0, pytest.approx(math.sqrt(2)), 1.0, 3.0)
    c = spark.createDataFrame([("m", True, 10, 10), ("m", False, 1_000_000, 0), ("z", False, 5, 5)], "model string, hit boolean, tokens_in long, tokens_out long")
    p = spark.createDataFrame([("m", 2.0, 1.0)], "model string, price_in double, price_out double")
    assert {(x.model, x.n_hits, x.cost) for x in R.usage_totals(c, p).collect()} == {("m", 1, 2.0), ("z", 0, 0.0)}
    assert R.markdown(s.limit(1)).splitlines()[0] == "| k | ratio |"
    assert R.result_spec("a=x/y.json") == ("a", "x/y.json") and R.result_spec("x/y.json") == ("y", "x/y.json")


@pytest.mark.parametrize("block", [4096, 3])
def test_nearest_member_blocks(spark, block):
    rng = np.random.default_rng(1)
    talk = [("f", "user", i, 0, rng.standard_normal(3).tolist()) for i in range(9)] + [("f", "user", 50, 0, None)]
    train = [("f", "user", 100 + i, 0, f"b{i % 3}", rng.standard_normal(3).tolist()) for i in range(14)]
    a = spark.createDataFrame(talk, "flow_id string, actor string, dialogue_id long, turn int, vector array<double>")
    b = spark.createDataFrame(train, "flow_id string, actor string, dialogue_id long, turn int, bucket string, vector array<double>")
    got = {(r.dialogue_id, r.bucket): r.distance for r in W.nearest_member(a, b, block).collect()}
    cos = lambda x, y: 1 - np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y) + 1e-9)
    want = {(t[2], k): min(cos(t[4], x[5]) for x in train if x[4] == k) for t in talk[:-1] for k in ("b0", "b1", "b2")}
    assert got == pytest.approx(want)


def test_registry():
    q, s = registry.queries(), registry.oracle_sql()
    assert registry.FLAGSHIP in q and set(s) <= set(q)


def test_separation(spark):
    m = spark.createDataFrame([("a", "a", 0.2), ("a", "b", 0.5), ("a", "c", 0.5), ("b", "a", 0.1), ("b", "b", 0.4), ("c", "a", 0.3)], "flow_id string, stratum string, mean_score double")
    got = {r.flow_id: (r.own, r.nearest, r.self_best) for r in R.separation(m).collect()}
    assert got == {"a": (0.2, "b", True), "b": (0.4, "a", False)}


def test_results_keep_nulls(spark, tmp_path):
    from flowspark.sources.corpora import write_results

    write_results(spark.createDataFrame([("x", None)], "k string, v double"), str(tmp_path / "r"))
    assert '"v":null' in "".join(p.read_text() for p in (tmp_path / "r").glob("*.json"))


def test_canonical_labels(spark):
    from flowspark.operators.labelling import canonical_by_cluster

    rows = [("get name", 3, [1.0, 0.0]), ("take name", 5, [0.99, 0.1]), ("ask name", 1, [0.98, -0.1]), ("bye", 2, [0.0, 1.0]), ("farewell", 1, [0.1, 0.99]), ("odd", 1, None)]
    got = {r.label: r.canonical for r in canonical_by_cluster(spark.createDataFrame(rows, "label string, n long, vector array<double>")).collect()}
    assert got == {"get name": "take name", "take name": "take name", "ask name": "take name", "bye": "bye", "farewell": "bye", "odd": "odd"}
