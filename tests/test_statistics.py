"""Exact distributions, paired tests, intervals, components and deliveries against plain forms."""

import itertools
import random

import numpy as np
import pytest

from flowspark.functions.vectors import mean_vectors
from flowspark.operators import flows as G
from flowspark.operators import statistics as S
from flowspark.session import Scratch, shared_dir
from flowspark.sources.tables import latest


def test_exact_counts():
    for n1, n2 in [(1, 1), (2, 3), (4, 4), (3, 6)]:
        c = np.zeros(n1 * n2 + 1)
        for s in itertools.combinations(range(n1 + n2), n1):
            c[sum(s) - n1 * (n1 - 1) // 2] += 1
        assert (S.u_counts(n1, n2) == c).all()
    c = np.zeros(22)
    for s in itertools.product((0, 1), repeat=6):
        c[sum(i + 1 for i in range(6) if s[i])] += 1
    assert (S.signed_rank_counts(6) == c).all()


def test_mann_whitney_p_is_exact_for_small_pools(spark):
    rows = [("k", "positive", x) for x in (1.0, 2.0, 4.0)] + [("k", "negative", x) for x in (3.0, 5.0, 6.0)]
    rows += [("e", "positive", 1.0)] + [("t", p, x) for p in ("positive", "negative") for x in (1.0, 1.0, 2.0)]
    got = {r.k: r.p_less for r in S.mann_whitney_p(S.mann_whitney(spark.createDataFrame(rows, "k string, pool string, score double"), "k")).collect()}
    assert got["k"] == pytest.approx(2 / 20) and got["e"] is None and 0.4 < got["t"] < 0.8


def test_paired_p(spark):
    d = [1.0, -2.0, 3.5, 4.5, -0.5, 6.0]
    a, b = (spark.createDataFrame([(i, x if k == 0 else 0.0) for i, x in enumerate(d)], "id long, score double") for k in (0, 1))
    r = S.paired_p(S.paired(a, b, "id")).first()
    ranks = {x: i + 1 for i, x in enumerate(sorted(d, key=abs))}
    up = sum(ranks[x] for x in d if x > 0)
    sums = [sum(i + 1 for i in range(6) if s[i]) for s in itertools.product((0, 1), repeat=6)]
    less, greater = sum(x <= up for x in sums) / 64, sum(x >= up for x in sums) / 64
    assert (r.w_plus, r.n_ranked) == (up, 6)
    assert r.p_less == pytest.approx(less) and r.p_greater == pytest.approx(greater) and r.p_two_sided == pytest.approx(2 * min(less, greater))
    same = S.paired_p(S.paired(a, a, "id")).first()
    assert (same.p_less, same.p_greater, same.p_two_sided) == (1.0, 1.0, 1.0)
    rng = np.random.default_rng(2)
    many = spark.createDataFrame([(i, float(x)) for i, x in enumerate(rng.integers(-3, 6, 200))], "id long, score double")
    assert S.paired_p(S.paired(many, many.selectExpr("id", "0.0D AS score"), "id")).first().p_greater < 1e-4


def test_length_matched_interval_holds_the_ratio(spark):
    rng = np.random.default_rng(4)
    rows = [("k", p, float(m + rng.normal(0, 0.05)), int(n)) for p, m in (("positive", 0.2), ("negative", 0.5)) for n in rng.integers(3, 12, 200)] + [("none", "positive", 1.0, 3)]
    df = spark.createDataFrame(rows, "k string, pool string, score double, length int")
    got = {r.k: r for r in S.length_matched_ci(df, "k", draws=200).collect()}
    ratio = {r.k: r.lm_ratio for r in S.length_matched(df, "k").collect()}
    assert got["k"].lm_ci_lo < ratio["k"] < got["k"].lm_ci_hi < 2.8 and got["none"].lm_ci_lo is None


def test_weak_components(spark):
    r = random.Random(3)
    nodes = [(g, f"n{i}") for g in (1, 2) for i in range(60)]
    edges = [(1, f"n{i}", f"n{i + 1}") for i in range(0, 49)] + [(2, f"n{r.randrange(60)}", f"n{r.randrange(60)}") for _ in range(30)]
    comp = {v: v for v in nodes}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for g, a, b in edges:
        x, y = sorted((find((g, a)), find((g, b))))
        comp[y] = x
    n = spark.createDataFrame(nodes + nodes[:3], "dag_id long, node_id string")
    got = G.weak_components(n, spark.createDataFrame(edges, "dag_id long, src string, dst string")).collect()
    assert {(x.dag_id, x.node_id): (x.dag_id, x.component) for x in got} == {v: find(v) for v in nodes}


def test_latest_delivery(spark):
    rows = [(1, "a", 1), (1, "b", 2), (2, "c", 1), (3, "d", 1), (3, "e", 1), (None, "f", 9), (4, None, None)]
    got = latest(spark.createDataFrame(rows, "id long, x string, loaded_at int"), "id", "x").collect()
    assert sorted((r.id, r.x or "") for r in got) == [(1, "b"), (2, "c"), (3, "e"), (4, "")]


def test_mean_vectors(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, 6.0]), ("a", None), ("a", []), ("a", [9.0]), ("b", [None, 1.0]), ("c", [0.5, 0.5])]
    got = {r.k: r.vector for r in mean_vectors(spark.createDataFrame(rows, "k string, v array<double>"), ["k"], "v").collect()}
    assert got == {"a": [2.0, 4.0], "c": [0.5, 0.5]}


def test_scratch(spark):
    tmp = Scratch(spark, "test")
    a, b = tmp.put(spark.range(3)), tmp.put(spark.range(4))
    tmp.only(b)
    assert b.count() == 4 and tmp.paths == {b._flowspark_path} and a._flowspark_path not in tmp.paths


def test_shared_folder_is_wanted_on_a_cluster():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master, applicationId = "spark://host:7077", "x"

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError):
        shared_dir(Session())


def test_zero_mean_centroid_stays_zero(spark):
    rows = [(1, 0, "user", "a", [0.0, 0.0]), (1, 1, "agent", "b", [3.0, 4.0])]
    train = spark.createDataFrame(rows, "dialogue_id long, turn int, actor string, label string, vector array<double>").selectExpr("'f' AS flow_id", "*")
    assert {r.label: r.centroid for r in G.centroids(train).collect()} == {"a": [0.0, 0.0], "b": [0.6, 0.8]}


def test_paired_by_stratum(spark):
    """Strata compared at once give the rows of each by itself; ranks do not cross strata, equal scores leave no ranks, few keys no row."""
    rows = [("a", i, float(i % 5), float((i * 7) % 4)) for i in range(20)] + [("b", i, float(i), float(i * i % 11)) for i in range(9)] + [("same", i, 1.0, 1.0) for i in range(6)] + [("few", i, 1.0, 2.0) for i in range(4)]
    a, b = (spark.createDataFrame([(r[0], r[1], r[k]) for r in rows], "stratum string, id long, score double") for k in (2, 3))
    got = {r.stratum: r for r in S.paired(a, b, "id", by=("stratum",)).collect()}
    assert set(got) == {"a", "b", "same"}
    for s in got:
        assert {k: v for k, v in got[s].asDict().items() if k != "stratum"} == S.paired(a.where(a.stratum == s), b.where(b.stratum == s), "id").first().asDict()
    assert (got["same"].n, got["same"].w_plus, got["same"].n_ranked, got["same"].tie_term) == (6, 0.0, 0, 0)
