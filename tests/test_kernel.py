"""The distance kernel on six flow shapes and five conversations: all forms agree, and closed forms hold."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowspark.operators import kernel as K
from flowspark.streaming.scoring import next_column

BUCKETS = ["greet_user", "greet_agent", "ask_hotel", "ask_food", "confirm", "ask_details", "provide_dates", "goodbye_user", "goodbye_agent"]
ACTOR = dict(zip(BUCKETS, "uauuaauua"))
SHAPES = {
    "linear": ["R>greet_user", "greet_user>greet_agent", "greet_agent>ask_hotel", "ask_hotel>confirm"],
    "branching": ["R>greet_user", "greet_user>greet_agent", "greet_agent>ask_hotel", "greet_agent>ask_food", "ask_hotel>confirm", "ask_food>confirm"],
    "diamond": ["R>greet_user", "R>ask_hotel", "greet_user>confirm", "ask_hotel>confirm"],
    "deep": ["R>greet_user", "greet_user>greet_agent", "greet_agent>ask_hotel", "ask_hotel>ask_details", "ask_details>provide_dates", "provide_dates>confirm", "confirm>goodbye_agent"],
    "nested": ["R>greet_user", "greet_user>greet_agent", "greet_user>ask_details", "greet_agent>ask_hotel", "ask_details>ask_hotel", "ask_hotel>confirm", "ask_hotel>goodbye_agent", "confirm>goodbye_user", "goodbye_agent>goodbye_user"],
    "wide": ["R>greet_user", "greet_user>greet_agent", "greet_user>ask_details", "greet_agent>ask_hotel", "greet_agent>ask_food", "ask_hotel>confirm", "ask_food>confirm", "ask_details>provide_dates"],
}
TALKS = {"hotel": "uaua", "food": "uaua", "long": "uauauaa", "one": "u", "none": ""}
NAME = {"u": "user", "a": "agent"}


def build(shape):
    rng = np.random.default_rng(1)
    edges = [tuple(e.replace("R", K.ROOT, 1).split(">")) if e.startswith("R>") else tuple(e.split(">")) for e in SHAPES[shape]]
    nodes = sorted({b for e in edges for b in e} - {K.ROOT})
    vec = {b: rng.standard_normal(3) for b in BUCKETS}
    return K.Flow([(n, n) for n in nodes], edges, [(b, NAME[ACTOR[b]], vec[b]) for b in BUCKETS]), nodes, edges


def talk(name, seed=3):
    rng = np.random.default_rng(seed)
    actors = np.array([NAME[c] for c in TALKS[name]], dtype=object)
    return actors, rng.standard_normal((len(actors), 3))


def paths(nodes, edges):
    down = {}
    for a, b in edges:
        down.setdefault(a, []).append(b)

    def go(v):
        return [[v]] if v not in down else [[v, *p] for w in down[v] for p in go(w)]

    return [p[1:] for p in go(K.ROOT)]


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("name", TALKS)
def test_forms_agree(shape, name):
    flow, nodes, edges = build(shape)
    actors, x = talk(name)
    x = x.reshape(len(actors), 3)
    want = K.paths_distance([[BUCKETS.index(b) for b in p] for p in paths(nodes, edges)], flow.substitution(actors, x), len(actors))
    got = flow.score(actors, x)
    assert got == pytest.approx(want, abs=1e-6)
    assert flow.score(actors, x, dwell=np.inf) == pytest.approx(got, abs=1e-9)
    assert flow.score(actors, x, dwell=0.0) <= got + 1e-9
    column = next_column(flow, None, None)
    for j in range(len(actors)):
        column = next_column(flow, column, flow.substitution(actors[j : j + 1], x[j : j + 1])[:, 0])
    assert column[flow.leaves].min() == pytest.approx(got, abs=1e-6)
    assert got <= len(actors) + min(map(len, paths(nodes, edges))) + 1e-9


@pytest.mark.parametrize("seed", range(25))
def test_random_graphs(seed):
    r = random.Random(seed)
    n = r.randint(2, 9)
    edges = [(K.ROOT, "n0")] + [(f"n{r.randrange(i)}", f"n{i}") for i in range(1, n)] + [(f"n{a}", f"n{b}") for a in range(n) for b in range(a + 1, n) if r.random() < 0.15]
    rng = np.random.default_rng(seed)
    buckets = [(f"b{i}", r.choice(["user", "agent"]), rng.standard_normal(4)) for i in range(5)]
    nodes = [(f"n{i}", f"b{r.randrange(5)}") for i in range(n)]
    flow = K.Flow(nodes, edges, buckets)
    actors = np.array([r.choice(["user", "agent"]) for _ in range(r.randint(0, 7))], dtype=object)
    x = rng.standard_normal((len(actors), 4))
    at = dict(nodes)
    want = K.paths_distance([[int(at[v][1:]) for v in p] for p in paths([v for v, _ in nodes], sorted(set(edges)))], flow.substitution(actors, x), len(actors))
    assert flow.score(actors, x) == pytest.approx(want, abs=1e-6)


@pytest.mark.parametrize("shape", SHAPES)
@pytest.mark.parametrize("dwell", [None, 0.25])
def test_conversations_together(shape, dwell):
    """Conversations of any lengths, scored in one pass over the flow, have the distances of one at a time."""
    flow, nodes, edges = build(shape)
    subs = [flow.substitution(*talk(name, seed)) for seed in range(3) for name in TALKS if TALKS[name]] + [np.zeros((len(BUCKETS), 0))]
    got = flow.scores(subs, dwell)
    assert got == pytest.approx([flow.scores([s], dwell)[0] for s in subs], abs=1e-12)
    if dwell is None:
        assert got == pytest.approx([K.paths_distance([[BUCKETS.index(b) for b in p] for p in paths(nodes, edges)], s, s.shape[1]) for s in subs], abs=1e-9)


@pytest.mark.parametrize("shape", SHAPES)
def test_packed_flow(shape):
    """A flow that was made ready once and sent on gives the same distances; a node of an unknown bucket is never matched."""
    flow, nodes, edges = build(shape)
    gap = K.Flow([(n, n if k else "?") for k, n in enumerate(nodes)], edges, list(zip(BUCKETS, flow.actor, flow.c)))
    for f in (flow, gap):
        subs = [f.substitution(*talk(name)) for name in TALKS if TALKS[name]]
        sent = K.Flow.unpacked(f.packed())
        assert sent.scores(subs).tolist() == f.scores(subs).tolist()
    unknown = [[-1 if p == nodes[0] else BUCKETS.index(p) for p in path] for path in paths(nodes, edges)]
    assert gap.scores(subs) == pytest.approx([K.paths_distance(unknown, s, s.shape[1]) for s in subs], abs=1e-9)


def test_closed_forms():
    empty = K.Flow([], [], [])
    assert empty.score(np.array(["user", "agent"], dtype=object), np.zeros((2, 1))) == 2.0
    flow, _, _ = build("linear")
    assert flow.score(np.array([], dtype=object), np.zeros((0, 3))) == 4.0
    assert (flow.substitution(np.array(["agent"], dtype=object), np.ones((1, 3)))[[0, 2, 3], 0] >= 1e8).all()
    with pytest.raises(ValueError):
        K.Flow([("a", "b"), ("c", "b")], [(K.ROOT, "a"), ("a", "c"), ("c", "a")], [])


def test_expression_form(spark):
    r = random.Random(5)
    rows = [([r.choice("abc") for _ in range(r.randint(0, 5))], [r.choice("abc") for _ in range(r.randint(0, 5))]) for _ in range(40)]
    df = spark.createDataFrame(rows, "p array<string>, t array<string>")
    got = [x.v for x in df.select(K.edit_distance(F.col("p"), F.col("t"), lambda a, b: F.when(a == b, 0.0).otherwise(2.0)).alias("v")).collect()]

    def plain(p, t):
        old = list(range(len(t) + 1))
        for a in p:
            new = [old[0] + 1]
            for j, b in enumerate(t):
                new.append(min(old[j + 1] + 1, new[j] + 1, old[j] + (0 if a == b else 2)))
            old = new
        return float(old[-1])

    assert got == [plain(p, t) for p, t in rows]


def test_distributed_form(spark):
    flow, nodes, edges = build("nested")
    n = spark.createDataFrame([("f", b, a, b) for a, b in edges], "flow_id string, node string, parent string, bucket string")
    c = spark.createDataFrame([("f", b, str(flow.actor[i]), i, flow.c[i].tolist()) for i, b in enumerate(BUCKETS)], "flow_id string, bucket string, actor string, ord long, centroid array<double>")
    rows, want = [], {}
    for k, name in enumerate(t for t in TALKS if TALKS[t]):
        actors, x = talk(name, seed=k)
        rows += [(k, j, str(a), v.tolist()) for j, (a, v) in enumerate(zip(actors, x))]
        want[k] = flow.score(actors, x)
    t = spark.createDataFrame(rows, "dialogue_id long, turn int, actor string, vector array<double>")
    p = spark.createDataFrame([(k, "f") for k in want], "dialogue_id long, flow_id string")
    got = {r.dialogue_id: r.distance for r in K.flow_distances(t, n, c, p, block=2).collect()}
    assert got == pytest.approx(want, abs=1e-6)


def test_bundles_and_regimes(spark):
    """Several flows of a bundle in a task, of which a conversation needs some, and two costs of staying in one pass."""
    flows = {name: build(name) for name in ("nested", "diamond", "wide")}
    n = spark.createDataFrame([(k, b, a, b) for k, (_, _, edges) in flows.items() for a, b in edges], "flow_id string, node string, parent string, bucket string")
    c = spark.createDataFrame([(k, b, str(f.actor[i]), i, f.c[i].tolist()) for k, (f, _, _) in flows.items() for i, b in enumerate(BUCKETS)], "flow_id string, bucket string, actor string, ord long, centroid array<double>")
    rows, want, pairs = [], {}, []
    for k, name in enumerate([t for t in TALKS if TALKS[t]] * 3):
        actors, x = talk(name, seed=k)
        rows += [(k, j, str(a), v.tolist()) for j, (a, v) in enumerate(zip(actors, x))]
        for flow in sorted(flows)[k % 2 :]:
            pairs.append((k, flow, "all"))
            want |= {(flow, k, r): flows[flow][0].score(actors, x, w) for r, w in enumerate((None, 0.25))}
    t = spark.createDataFrame(rows, "dialogue_id long, turn int, actor string, vector array<double>")
    p = spark.createDataFrame(pairs, "dialogue_id long, flow_id string, bundle string")
    for x in (p, p.drop("bundle")):
        got = {(r.flow_id, r.dialogue_id, r.regime): r.distance for r in K.regime_distances(t, n, c, x, (None, 0.25), block=4).collect()}
        assert got == pytest.approx(want, abs=1e-9)


def test_path_distances(spark):
    r = random.Random(4)
    word = lambda: [r.choice("abc") for _ in range(r.randrange(0, 6))]

    def plain(p, y):
        old = list(range(len(y) + 1))
        for x in p:
            new = [old[0] + 1]
            for k, z in enumerate(y):
                new.append(min(old[k + 1] + 1, new[k] + 1, old[k] + (0 if x == z else 2)))
            old = new
        return old[-1]

    paths = [(f, word()) for f in ("f", "g") for _ in range(12)]
    seqs = [(f, i, word()) for f in ("f", "g") for i in range(15)] + [("none", 1, ["a"])]
    got = K.path_distances(spark.createDataFrame(seqs, "flow_id string, dialogue_id long, labels array<string>"), spark.createDataFrame(paths, "flow_id string, labels array<string>"), block=4).collect()
    assert {(r.flow_id, r.dialogue_id): r.distance for r in got} == {(f, i): min(plain(p, y) for g, p in paths if g == f) for f, i, y in seqs if f != "none"}
