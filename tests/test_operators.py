"""Small cases with known results for turns, texts, flows, labels, statistics and diagrams."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.functions import text as T
from flowspark.functions import vectors as V
from flowspark.operators import conversations as C
from flowspark.operators import diagrams as D
from flowspark.operators import flows as G
from flowspark.operators import labelling as L
from flowspark.operators import segments as W
from flowspark.operators import statistics as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(column.alias("x")).first().x


def test_cosine(spark):
    a, b, z = (F.array(*map(F.lit, v)) for v in ([1.0, 2.0, 2.0], [2.0, -1.0, 0.0], [0.0, 0.0, 0.0]))
    assert one(spark, V.cosine_distance(a, a)) == pytest.approx(0, abs=1e-6)
    assert one(spark, V.cosine_distance(a, b)) == pytest.approx(1, abs=1e-6)
    assert one(spark, V.cosine_distance(a, z)) == 1
    assert one(spark, V.normalised(z)) == [None] * 3


@pytest.mark.parametrize(("n", "want"), [(5, [0]), (3, [0]), (12, [0, 4, 7]), (6, [0, 1]), (0, [])])
def test_chunk_starts(spark, n, want):
    assert one(spark, T.chunk_starts(F.lit(n), 5, 4)) == want


@pytest.mark.parametrize(("labels", "want"), [([0, 0, 0], [[0, 1, 2]]), ([0, 0, 1, 0], [[0, 1, 2, 3]]), ([0, 1, 2], [[0], [1], [2]]), ([], [])])
def test_smoothed_runs(labels, want):
    assert W.smoothed_runs(labels, 2) == want


def test_window_is_kept_full(spark):
    t = F.array(*[F.lit(i) for i in range(7)])
    assert [one(spark, T.context_window(t, F.lit(i), 3)) for i in (0, 3, 6)] == [[0, 1, 2], [2, 3, 4], [4, 5, 6]]


def test_rendering(spark):
    t = F.array(F.struct(F.lit("agent").alias("actor"), F.lit("hi").alias("text")), F.struct(F.lit("user").alias("actor"), F.lit(None).cast("string").alias("text")))
    assert one(spark, T.render_dialogue(t)) == "  [0] (agent) hi\n  [1] (user) "
    assert one(spark, T.fill_slots(F.lit("a {{x}}"), {"x": F.lit("b")})) == "a b"
    with pytest.raises(Exception, match="unfilled"):
        one(spark, T.fill_slots(F.lit("a {{x}} {{y}}"), {"x": F.lit("b")}))


def test_context_labels(spark):
    t = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "agent", "unknown"), (1, 2, "user", "y"), (1, 3, "agent", "ask"), (1, 4, "user", "z")], "dialogue_id long, turn int, actor string, label string")
    assert [r.intent for r in C.context_labels(t).orderBy("turn").collect()] == ["user_before_ask", "unknown", "user_before_ask", "ask", "unknown"]


def test_override(spark):
    t = spark.createDataFrame([(1, 0, "user", "x"), (1, 1, "agent", "y"), (2, 0, "user", "z")], "dialogue_id long, turn int, actor string, label string")
    new = spark.createDataFrame([(1, 0, "A"), (1, 1, "B")], "dialogue_id long, turn int, label string")
    assert sorted((r.turn, r.label) for r in C.override_labels(t, new).collect()) == [(0, "A"), (1, "B")]
    with pytest.raises(Exception, match="differ"):
        C.override_labels(t, new.limit(1)).collect()


def test_trie(spark):
    t = spark.createDataFrame([("f", d, i, "user", x) for d, s in ((1, "ab"), (2, "ab"), (3, "ac"), (4, "a")) for i, x in enumerate(s)], "flow_id string, dialogue_id long, turn int, actor string, label string")
    n = G.trie(t)
    assert {(r.node, r.parent, r.n_dialogues) for r in n.collect()} == {("u:a", G.ROOT, 4), ("u:a|u:b", "u:a", 2), ("u:a|u:c", "u:a", 1)}
    assert sorted(r.path for r in G.trie_paths(n).collect()) == [["u:a", "u:b"], ["u:a", "u:c"]]


def test_excise_chain_and_roots(spark):
    n = spark.createDataFrame([(1, v) for v in "abcd"], "dag_id long, node_id string")
    e = spark.createDataFrame([(1, "a", "b"), (1, "b", "c"), (1, "c", "d")], "dag_id long, src string, dst string")
    z = n.where("node_id in ('b', 'c')")
    assert {(r.src, r.dst) for r in G.excise(e, n, z).collect()} == {("a", "d"), (G.ROOT, "a")}


def test_task_flow(spark):
    r = spark.createDataFrame([("t", {"a": "b", "b": "c"}), ("loop", {"x": "y", "y": "x"})], "task string, next map<string,string>")
    assert {(x.task, x.src, x.dst) for x in G.task_flow(r).collect()} == {("t", "a", "b"), ("t", "b", "c"), ("t", G.ROOT, "a"), ("loop", "x", "y"), ("loop", "y", "x"), ("loop", G.ROOT, "x")}


def test_diagram():
    nodes, edges = D.parse("graph TD\n  B1[Greet] --> U1(Answer)\n U1 -->|yes| B2 & B3\nstyle B1 fill:red\n B2 --> B2\n%% note\nB1[\"Hello\"]")
    assert dict(nodes) == {"B1": "Hello", "U1": "Answer", "B2": "", "B3": ""}
    assert edges == [("B1", "U1"), ("U1", "B2"), ("U1", "B3"), ("B2", "B2")]
    assert D.parse(None) == ([], [])


def test_fence(spark):
    assert one(spark, T.fenced_diagram(F.lit("a\n```mermaid\ngraph TD\nA-->B\n```\nb\n```\nx\n```"))) == "graph TD\nA-->B"
    assert one(spark, T.fenced_diagram(F.lit("see flowchart LR\nA-->B"))) == "flowchart LR\nA-->B"
    assert one(spark, T.fenced_diagram(F.lit("nothing"))) == ""
    assert [one(spark, T.actor_of_node(F.lit(x))) for x in ("B1", "u2", "node_B3", "x")] == ["agent", "user", "agent", "unknown"]


def test_cycle_breaking():
    kept, gone = D.break_cycles(["a", "b", "c"], [("a", "b"), ("b", "c"), ("c", "a"), ("c", "c")])
    assert gone == [("c", "a"), ("c", "c")] and kept == [("a", "b"), ("b", "c")]


def test_chunks_and_replies(spark):
    c = spark.createDataFrame([(1, 0, 2, "old"), (1, 4, 2, "new"), (1, 0, 1, "x")], "dialogue_id long, start int, turn int, label string")
    assert {(r.turn, r.label) for r in L.last_chunk_wins(c).collect()} == {(2, "new"), (1, "x")}
    t = spark.createDataFrame([(1, 0), (1, 1)], "dialogue_id long, turn int")
    r = spark.createDataFrame([(1, 0, 0, "a"), (1, 1, 0, "b"), (1, 2, 9, "c")], "dialogue_id long, pos int, turn int, label string")
    n = spark.createDataFrame([(1, 0, "n0"), (1, 1, "n1")], "dialogue_id long, turn int, anchor string")
    assert {(x.turn, x.label, x.answered) for x in L.resolve_replies(r, t, n).collect()} == {(0, "b", True), (1, "n1", False)}


def test_alignment_keeps_empty_anchors(spark):
    p = spark.createDataFrame([(1, "u", [1.0, 0.0]), (2, "u", [0.9, 0.1]), (3, "u", [0.0, 1.0])], "id long, g string, vector array<double>")
    a = spark.createDataFrame([("u", "x", 0, [1.0, 0.0]), ("u", "y", 1, [0.0, 1.0]), ("u", "z", 2, [-1.0, 0.0])], "g string, anchor string, ord int, vector array<double>")
    got, state = L.align(spark, p, a, 3)
    assert {r.id: r.anchor for r in got.collect()} == {1: "x", 2: "x", 3: "y"}
    assert state.first().converged
    assert {r.anchor: r.empty for r in L.coverage(got, a).collect()} == {"x": False, "y": False, "z": True}
    assert not L.align(spark, p, a, 0)[1].first().converged


def test_verdicts(spark):
    rules = spark.createDataFrame([("a", "presence"), ("b", "transition"), ("c", "presence"), ("d", "presence")], "rule_id string, kind string")
    v = spark.createDataFrame([(1, "a", 1), (1, "b", 0), (1, "c", -1), (1, "d", 1), (1, "zz", 1)], "session_id long, rule_id string, score int")
    assert L.session_scores(L.verdict_scores(rules, v)).first().score == pytest.approx(1 / 3)
    with pytest.raises(Exception, match="two verdicts"):
        L.verdict_scores(rules, v.union(v.limit(1))).collect()
    with pytest.raises(ValueError):
        L.independent_judge("j", {"g": "m"}, {"j": "m"})


def test_cache_calls_each_key_once(spark):
    calls = spark.createDataFrame([("k1", "p1"), ("k2", "p2"), ("k2", "p2")], "key string, payload string")
    cache = spark.createDataFrame([("k1", "known")], "key string, response string")

    def labeler(batches):
        for b in batches:
            yield b.assign(response="made:" + b["payload"])[["key", "response"]]

    assert {(r.key, r.response, r.hit) for r in L.cached_calls(calls, cache, labeler).collect()} == {("k1", "known", True), ("k2", "made:p2", False)}


def test_merge_labels(spark):
    l = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, "c")], "ord long, label string")
    s = spark.createDataFrame([(1, 2), (2, 4)], "a long, b long")
    assert {(r.ord, r.merged) for r in L.merge_labels(spark, l, s).collect()} == {(1, "a"), (2, "a"), (3, "a_2"), (4, "a")}


def test_average_linkage():
    x = np.array([[1, 0], [0.99, 0.14], [0, 1.0], [0.14, 0.99]])
    assert L.average_linkage(x, 0.45).tolist() == [0, 0, 1, 1]
    assert L.average_linkage(x, 2).tolist() == [0, 0, 0, 0]


def scores(spark, rows):
    return spark.createDataFrame(rows, "k string, pool string, score double, length int")


def test_rank_tests(spark):
    s = scores(spark, [("f", "positive", 1.0, 3), ("f", "positive", 2.0, 3), ("f", "negative", 2.0, 3), ("f", "negative", 4.0, 9)])
    u = S.mann_whitney(s, "k").first()
    assert (u.u, u.rbc) == (0.5, pytest.approx(0.75))
    p = S.mann_whitney_p(S.mann_whitney(s, "k")).first().p_less
    z = (0.5 - 2 + 0.5) / math.sqrt(4 / 12 * (5 - 6 / 12))
    assert p == pytest.approx(0.5 * math.erfc(-z / math.sqrt(2)))
    a = spark.createDataFrame([(i, float(x)) for i, x in enumerate([1, 5, 3, 4, 2, 7])], "id long, score double")
    b = spark.createDataFrame([(i, float(x)) for i, x in enumerate([2, 3, 3, 1, 4, 1])], "id long, score double")
    w = S.paired(a, b, "id").first()
    assert (w.n, w.w_plus, w.w_minus) == (6, 2.5 + 4 + 5, 1 + 2.5)
    assert S.paired(a.limit(3), b, "id").count() == 0


def test_length_matching(spark):
    rows = [("f", "positive", 1.0, 3)] * 5 + [("f", "negative", 2.0, 4)] * 5 + [("f", "negative", 100.0, 30)] * 5
    r = S.length_matched(scores(spark, rows), "k").first()
    assert (r.lm_ratio, r.coverage, r.out_coverage, r.n_bins) == (2.0, 1.0, 0.5, 1)
    r = S.length_matched(scores(spark, rows[:3]), "k").first()
    assert (r.lm_ratio, r.coverage, r.n_bins) == (None, 0.0, 0)
    assert 0 < S.permutation_p(scores(spark, rows), "k", draws=50).first().p_perm <= 0.1
    b = S.bootstrap_ratio(scores(spark, rows), "k", draws=50).first()
    assert b.ratio_lo <= b.ratio <= b.ratio_hi


def test_spearman(spark):
    s = scores(spark, [("f", "positive", float(i), i) for i in range(6)] + [("g", "positive", 1.0, i) for i in range(4)])
    r = {x.k: x.rho for x in S.spearman(s, "score", "length", "k").collect()}
    assert r["f"] == pytest.approx(1.0) and r["g"] is None


def test_split_rounds_half_to_even(spark):
    i = spark.createDataFrame([("s", n) for n in range(5)] + [("t", 9)], "s string, i long")
    n = {(r.s, r.side): r["count"] for r in S.stratified_split(i, "s", "i", 0.5).groupBy("s", "side").count().collect()}
    assert n == {("s", "train"): 2, ("s", "test"): 3, ("t", "train"): 1}
