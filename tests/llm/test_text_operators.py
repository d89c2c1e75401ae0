"""Overlaps, clusters, leaks, mixes and scores on small fixtures, against plain forms."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowspark.llm import clusters as K
from flowspark.llm import leaks as L
from flowspark.llm import mixing as M
from flowspark.llm import overlap as O
from flowspark.llm import toxicity as T
from flowspark.llm.boost import Boosted, Isotonic

VOCAB = [f"{a}{b}" for a in "bcdfghklm" for b in ("ana", "elo", "iru", "ost", "umi", "ydd")]


def sentence(r, n):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def light(r, text):
    w = text.split()
    i = r.randrange(len(w))
    w[i : i + 1] = r.choice([[], [w[i], "extra"], ["other"], [w[i] + "x"]])
    return " ".join(w)


def conversation(r, turns, words=12):
    return [("user" if i % 2 else "agent", sentence(r, words)) for i in range(turns)]


def packed(turns):
    return "\n".join(f"{a}\t{x}" for a, x in turns)


def test_overlaps(spark):
    r = random.Random(2)
    base = [conversation(r, 10) for _ in range(12)]
    rows = [(i, True, packed(c), "other") for i, c in enumerate(base)]
    rows += [(100, False, packed(base[0]), "x"), (101, False, packed([(a, light(r, x)) for a, x in base[1]]), "x"), (102, False, packed(base[2][:5] + conversation(r, 5)), "x"), (103, False, packed(base[3][1:9]), "x")]
    rows += [(104, False, packed(base[0]), "x"), (105, False, None, "x"), (None, False, packed(base[4]), "x"), (106, False, "", "x"), (107, False, packed(conversation(r, 400)), "x")]
    rows += [(200 + i, bool(i % 2), packed([(a, "how can i help you today with this little request of yours please") if a == "agent" else (a, x) for a, x in conversation(r, 10)]), "x") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, train boolean, turns string, a string")
    pairs, members = O.overlaps(spark, df)
    got = {(x.a, x.b) for x in O.copied(pairs).collect()}
    assert got == {(0, 100), (1, 101), (3, 103)}
    assert {x.id for x in members.where("class = 100").collect()} == {100, 104}


def test_overlaps_of_nothing(spark):
    pairs, members = O.overlaps(spark, spark.createDataFrame([], "id long, train boolean, turns string"))
    assert pairs.count() == 0 and members.count() == 0


def test_hot_phrases_do_not_hide_copies(spark):
    r = random.Random(8)
    stock = sentence(r, 30)
    rows = [(i, i % 2 == 0, packed([("agent", stock), ("user", sentence(r, 25)), ("agent", stock), ("user", sentence(r, 25))])) for i in range(120)]
    rows.append((500, False, rows[10][2]))
    pairs, _ = O.overlaps(spark, spark.createDataFrame(rows, "id long, train boolean, turns string"))
    assert {(x.a, x.b) for x in O.copied(pairs).collect()} == {(10, 500)}


def replaced(r, turns):
    """One word of every turn replaced."""
    out = []
    for a, x in turns:
        w = x.split()
        w[r.randrange(len(w))] = "other" + str(r.randrange(9))
        out.append((a, " ".join(w)))
    return out


def test_many_changed_copies_on_both_sides(spark):
    r = random.Random(9)
    base = conversation(r, 14, 16)
    rows = [(i, i < 60, packed(replaced(r, base))) for i in range(90)]
    pairs, _ = O.overlaps(spark, spark.createDataFrame(rows, "id long, train boolean, turns string"))
    assert O.copied(pairs).count() == 60 * 30


@pytest.mark.parametrize("words", [6, 8, 10, 12, 16])
def test_copies_changed_in_every_turn_are_proposed(words):
    """One word of every turn of the held-out copy replaced: pairs with chains in common from enough places."""
    r = random.Random(words)
    found = 0
    for _ in range(300):
        base = conversation(r, 14, words)
        held = replaced(r, base)
        n, seeds = np.array([14]), lambda c: O.turn_seeds([x.split() for _, x in c])
        _, ka, _ = O.chains(seeds(base), n)
        _, kb, at = O.chains(seeds(held), n)
        places = int(np.bitwise_or.reduce(at[np.isin(kb, ka)])) if np.isin(kb, ka).any() else 0
        found += bin(places).count("1") >= 3
    assert found / 300 >= 0.95, found


def test_hot_chains_lose_no_pair(spark):
    r = random.Random(12)
    base = [conversation(r, 9, 10) for _ in range(6)]
    rows = [(i, i % 5 > 0, packed(replaced(r, base[i % 6]) if i % 4 else base[i % 6])) for i in range(72)]
    rows += [(100 + i, i % 2 == 0, packed(base[0][:4] + conversation(r, 5, 10))) for i in range(8)]
    df = spark.createDataFrame(rows, "id long, train boolean, turns string")
    free, limited = ({(x.a, x.b) for x in O.copied(O.overlaps(spark, df, limit)[0]).collect()} for limit in (1 << 40, 1))
    assert len(free) > 100 and free <= limited


@pytest.mark.parametrize("turns", [1, 2, 4, 7])
def test_short_records_share_chains_with_many(spark, turns):
    """Records of which a chain from one place is asked for, all of whose chains others have as well: no limit takes them away."""
    r = random.Random(turns)
    base = conversation(r, turns, 12)
    rows = [(i, i < 6, packed([(a, f"{x} {'abcdefghi'[i]}{i}") if k == turns - 1 else (a, x) for k, (a, x) in enumerate(base)])) for i in range(9)]
    df = spark.createDataFrame(rows, "id long, train boolean, turns string")
    for limit in (1 << 20, 20, 1):
        assert {(x.a, x.b) for x in O.copied(O.overlaps(spark, df, limit)[0]).collect()} == {(i, j) for i in range(6) for j in range(6, 9)}


def test_pairs_by_chance_are_not_written(spark, monkeypatch):
    """Records that share a stock opening, and so chains from three places, do not become rows by pairs or by chains."""
    r = random.Random(14)
    stock = conversation(r, 5)
    rows = [(i, i < 120, packed(stock + conversation(r, 7))) for i in range(180)]
    rows.append((500, False, packed([(a, light(r, x)) for a, _, x in (y.partition("\t") for y in rows[3][2].split("\n"))])))
    written, put = [], O.Scratch.put

    def counted(self, df, path=None):
        out = put(self, df, path)
        written.append(out.count())
        return out

    monkeypatch.setattr(O.Scratch, "put", counted)
    pairs, _ = O.overlaps(spark, spark.createDataFrame(rows, "id long, train boolean, turns string"))
    assert {(x.a, x.b) for x in O.copied(pairs).collect()} == {(3, 500)}
    assert max(written) <= len(rows)


@pytest.mark.parametrize("words", [6, 8, 10, 12, 16])
def test_copies_changed_in_every_turn_align_by_their_seeds(words):
    r = random.Random(words)
    base = [conversation(r, 14, words) for _ in range(300)]
    rows = [(i, True, packed(c)) for i, c in enumerate(base)] + [(i, False, packed(replaced(r, c))) for i, c in enumerate(base)]
    s = pd.concat(O._sketched(iter([pd.DataFrame(rows, columns=["id", "train", "turns"])])))
    a, b = O.Block(s[s["train"]], 0), O.Block(s[~s["train"]], 1)
    met = [(i, j, O.seeds_align(a, b, i, j)) for i, j in O.common_places(a, b, 1 << 20)]
    assert sum(((i == j) & keep).sum() for i, j, keep in met) / 300 >= 0.95
    assert not any(((i != j) & keep).any() for i, j, keep in met)


def gapped(r, c, *gaps):
    """The turns of c with two others put in before each of the given places."""
    out = []
    for i, x in enumerate(c):
        out += [*(conversation(r, 2) if i in gaps else ()), x]
    return out


def slipped(text):
    return " ".join(w + "x" for w in text.split())


def test_copies_that_share_no_chain(spark):
    """Gaps that leave no three of four neighbours, turns that share no word pair, and word-by-word slips: what chains miss is sought by words."""
    r = random.Random(15)
    six, nine, short, typed, half = conversation(r, 6), conversation(r, 9), conversation(r, 6, 2), conversation(r, 8, 9), conversation(r, 7, 13)
    rows = [(1, True, packed(six)), (2, False, packed(six[:2] + conversation(r, 2) + six[4:]))]
    rows += [(3, True, packed(gapped(r, nine, 2, 4))), (4, False, packed(gapped(r, nine, 6, 8)))]
    rows += [(5, True, packed(short)), (6, False, packed([(a, x.replace(" ", " so ")) for a, x in short]))]
    rows += [(7, True, packed([("", x) for _, x in typed])), (8, False, packed([(a, slipped(x)) for a, x in typed]))]
    rows += [(9, True, packed(half)), (10, False, packed([(a, " ".join("other" if i % 4 == 1 else w for i, w in enumerate(x.split()))) for a, x in half]))]
    pairs, _ = O.overlaps(spark, spark.createDataFrame(rows, "id long, train boolean, turns string"))
    assert {(x.a, x.b) for x in O.copied(pairs).collect()} == {(1, 2), (3, 4), (5, 6), (7, 8), (9, 10)}


@pytest.mark.parametrize(("seed", "kept"), [(1, 1 << 25), (2, 1 << 25), (3, 1)])
def test_copies_match_all_pairs(seed, kept, monkeypatch):
    """Records of few words and turns, changed at random, against the alignment of all pairs; keeping nothing for the next record changes nothing."""
    monkeypatch.setattr(O, "KEPT", kept)
    r = random.Random(seed)

    def turn():
        return r.choice(["user", "agent", "agent", "user", ""]), " ".join(r.choice(["yes", "yea", "yeah", "no", "not", "note", "tone", "so"] + VOCAB[:12]) for _ in range(r.randint(1, 7)))

    def changed(c):
        c = [(a, r.choice([x, x, x, light(r, x) or x, slipped(x), turn()[1]])) for a, x in c]
        for _ in range(r.randrange(3)):
            i = r.randrange(len(c) + 1)
            c[i : i + r.randrange(2)] = [] if r.random() < 0.5 and len(c) > 1 else [turn()]
        return c or [turn()]

    base = [[turn() for _ in range(r.randint(1, 11))] for _ in range(40)]
    rows = [(i, i % 2 == 0, packed(changed(base[i // 8]))) for i in range(320)]
    s = pd.concat(O._sketched(iter([pd.DataFrame(rows, columns=["id", "train", "turns"])])))
    met = pd.concat(O._met(1 << 20)(iter([s])))
    got, want = set(zip(met["a"], met["b"])), set()
    for i, x in ((i, O.lines(t)) for i, train, t in rows if train):
        for j, y in ((j, O.lines(t)) for j, train, t in rows if not train):
            matched, _ = O.align(x, y)
            if matched >= max(len(x), len(y)) * O.TURNS - 1e-9:
                want.add((i, j))
    assert len(got) == len(met) and len(want) > 100 and want <= got
    texts = {i: t for i, _, t in rows}
    assert all(O.may_align(O.Record(texts[i]), O.Record(texts[j]), O.same_turns()) for i, j in want)


def test_short_records_overlap(spark):
    r = random.Random(13)
    c = conversation(r, 4, 7)
    rows = [(1, True, packed(c[:1])), (2, False, packed(c[:1] + [("user", "hm")])), (3, False, packed(replaced(r, c[:1]))), (4, True, packed(c[1:3])), (5, False, packed(c[1:4])), (6, True, packed(c)), (7, False, packed([c[0], c[1], c[3]]))]
    pairs, _ = O.overlaps(spark, spark.createDataFrame(rows, "id long, train boolean, turns string"))
    assert {(x.a, x.b) for x in O.copied(pairs).collect()} == {(1, 3), (4, 5), (6, 5), (6, 7)}


@pytest.mark.parametrize(("a", "b", "same"), [("one two three four", "one two three four", True), ("one two three four five", "one too three four five", True), ("one two three four", "five six seven eight", False), ("", "", False), ("seventeen", "seventen", True)])
def test_same_turn(a, b, same):
    assert O.same_turn(a.split(), b.split()) is same


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def test_vector_clusters(spark):
    rng = np.random.default_rng(3)
    centres = unit(rng.standard_normal((8, 48)))
    rows, i = [], 0
    for c, n in zip(centres, [60, 25, 12, 8, 5, 5, 4, 3]):
        noise = unit(rng.standard_normal((n, 48)))
        for v in unit(c + 0.35 * noise):
            rows.append((i, (v * rng.uniform(0.2, 4)).astype(np.float32).tolist(), "x"))
            i += 1
    starts = np.cumsum([0, 60, 25, 12, 8, 5, 5, 4])
    want = {k: int(starts[np.searchsorted(starts, k, side="right") - 1]) for k in range(i)}
    for v in unit(rng.standard_normal((30, 48))):
        rows.append((i, v.astype(np.float32).tolist(), "x"))
        want[i] = i
        i += 1
    rows += [(i, [0.0] * 48, "x"), (i + 1, None, "x"), (i + 2, [float("nan")] * 48, "x"), (None, rows[0][1], "x"), (i + 3, [], "x"), rows[0]]
    df = spark.createDataFrame(rows, "id long, vector array<float>, cluster string")
    got = {x.id: x.cluster for x in K.vector_clusters(spark, df).collect()}
    assert got == want


def components(x, least=K.COSINE):
    comp, near = np.arange(len(x)), x @ x.T >= least
    while True:
        new = np.where(near, comp[None, :], len(x)).min(1)
        if (new == comp).all():
            return comp
        comp = new


def test_hot_vector_cluster_is_cut(spark):
    rng = np.random.default_rng(4)
    c = unit(rng.standard_normal(32))
    x = unit(c + 0.3 * unit(rng.standard_normal((400, 32)))).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    assert {(r.cluster, r.size) for r in K.vector_clusters(spark, df, bucket=50).collect()} == {(0, 400)}


def hot_place(rng):
    hot = unit(rng.standard_normal(48))
    x = [unit(hot + 0.5 * unit(rng.standard_normal(48))) for _ in range(200)]
    for _ in range(60):  # small clusters at the edge of the hot one
        c = unit(hot + 1.2 * unit(rng.standard_normal(48)))
        x += [unit(c + rng.uniform(0.45, 0.6) * unit(rng.standard_normal(48))) for _ in range(3)]
    return np.array(x, np.float32)


@pytest.mark.parametrize("bucket", [None, 60])
def test_vectors_match_all_pairs_in_a_hot_place(spark, bucket):
    """Of one bucket, also if it is cut into parts, all pairs are compared: rows outside the core visit the other parts."""
    x = hot_place(np.random.default_rng(6))
    v = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    tmp = K.Scratch(spark, "test")
    coded = tmp.put(v.mapInArrow(K._encode(48, 1, 0, 0), K.CODED)).selectExpr("explode(keys) as key", "id", "code")
    if bucket:
        hot = tmp.put(coded.groupBy("key").agg(K.F.count("*").alias("n")))
        links = K._hot_links(coded, hot, 48, K.COSINE, tmp, bucket)
    else:
        links = coded.repartition("key").sortWithinPartitions("key", "id").mapInPandas(K._compare(48, K.COSINE, ["key"]), K.LINKS)
    links = [(r.a, r.b) for r in links.collect() if r.sure or x[r.a] @ x[r.b] >= K.COSINE]
    assert all(x[a] @ x[b] >= K.COSINE or components(x)[a] == components(x)[b] for a, b in links)
    comp = K._contract(np.arange(len(x)), np.array([a for a, _ in links]), np.array([b for _, b in links]))
    assert (comp == components(x)).all()


@pytest.mark.parametrize("cosine", [0.75, 0.78, 0.82])
@pytest.mark.parametrize(("rows", "bucket"), [(40, None), (40, 30)])
def test_pairs_meet_with_the_stated_recall(spark, monkeypatch, cosine, rows, bucket):
    """Pairs that nothing but their own link holds together, in many buckets of a band and with large buckets cut."""
    monkeypatch.setattr(K, "WHOLE", rows)
    monkeypatch.setattr(K, "SPREAD", 10**9)
    rng = np.random.default_rng(int(cosine * 100))
    a, b = unit(rng.standard_normal((2, 1000, 96)))
    b = unit(b - (a * b).sum(1)[:, None] * a)
    b = (cosine + 1e-6) * a + np.sqrt(1 - (cosine + 1e-6) ** 2) * b
    rows = [(2 * i + k, v.tolist()) for i, p in enumerate(zip(a, b)) for k, v in enumerate(p)]
    assert K.plan(2000, 96, 40)[1] >= 1
    got = K.vector_clusters(spark, spark.createDataFrame(rows, "id long, vector array<float>"), split_loose=False, medoids=False, bucket=bucket)
    assert got.where("size = 2 and cluster % 2 = 0 and (id = cluster or id = cluster + 1)").count() / 2000 >= 0.93


def test_buckets_leave_room_below_the_limit(spark, monkeypatch):
    """Vectors without hot places have no bucket that is too large for a task."""
    x = unit(np.random.default_rng(15).standard_normal((6000, 24)))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vector array<float>")
    hot, cut = [], K._hot_links

    def seen(rows, keys, *rest):
        hot.append(keys.count())
        return cut(rows, keys, *rest)

    monkeypatch.setattr(K, "_hot_links", seen)
    K.vector_roots(spark, df, 24, K.COSINE, K.Scratch(spark, "test"), 500)
    assert not hot


@pytest.mark.parametrize("axes", [20, 96, 250])
def test_bands_of_more_axes_than_dimensions_keep_the_recall(axes):
    rng = np.random.default_rng(axes)
    a, b = unit(rng.standard_normal((2, 4000, 96)))
    b = unit(b - (a * b).sum(1)[:, None] * a)
    b = K.COSINE * a + np.sqrt(1 - K.COSINE**2) * b
    bands, values, got = K.plan(2 * axes, 96, 1)
    assert (values, got) == (1, axes)
    met = np.any([K.strongest_axis(a.astype(np.float32), k, axes) == K.strongest_axis(b.astype(np.float32), k, axes) for k in range(bands)], 0)
    assert met.mean() >= K.RECALL - 0.01


def test_components_of_a_bucket_match_all_pairs(monkeypatch):
    monkeypatch.setattr(K, "SMALL", 130)
    rng = np.random.default_rng(8)
    x = np.concatenate([hot_place(rng), hot_place(rng), unit(rng.standard_normal((150, 48))).astype(np.float32)])
    assert (K.local_clusters(x) == components(x)).all()
    x = unit(np.repeat(rng.standard_normal((1, 48)), 700, 0) + 0.02 * rng.standard_normal((700, 48))).astype(np.float32)
    assert (K.local_clusters(x) == 0).all()


def test_large_buckets_are_taken_apart(monkeypatch):
    monkeypatch.setattr(K, "WHOLE", 300)
    monkeypatch.setattr(K, "SMALL", 130)
    rng = np.random.default_rng(9)
    a = unit(rng.standard_normal((2000, 96)))
    b = unit(rng.standard_normal((2000, 96)))
    b = unit(b - (a * b).sum(1)[:, None] * a)
    x = np.concatenate([a, 0.76 * a + np.sqrt(1 - 0.76**2) * b]).astype(np.float32)
    comp = K.local_clusters(x)
    assert (comp[2000:] == np.arange(2000)).mean() >= 0.95


def test_vectors_of_nothing(spark):
    assert K.vector_clusters(spark, spark.createDataFrame([], "id long, vector array<float>")).count() == 0
    assert K.vector_clusters(spark, spark.createDataFrame([(1, [0.0])], "id long, vector array<float>")).count() == 0


@pytest.mark.parametrize("full", [64, 2])
def test_set_clusters(spark, monkeypatch, full):
    monkeypatch.setattr(K, "FULL_BUCKET", full)
    r = random.Random(5)
    rows, items = [], {}
    for g in range(12):
        base = [f"text {g} {k}" for k in range(8)]
        for k in range(r.choice([1, 2, 4, 9])):
            x = r.sample(base, 7) + [f"own {g} {k}"]
            name = f"b{g:02d}{k:02d}"
            items[name] = set(x)
            rows.append((name, [*x, None, x[0]]))
    rows += [("empty", []), ("null", None), (None, ["a"]), rows[0]]
    got = {x.id: x.cluster for x in K.set_clusters(spark, spark.createDataFrame(rows, "id string, items array<string>")).collect()}
    up = {k: k for k in items}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in items:
        for b in items:
            if a < b and len(items[a] & items[b]) / len(items[a] | items[b]) >= 0.5:
                up[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {k: find(k) for k in items}


def test_loose_component_is_split(spark):
    s = [("a", list("abcdefgh")), ("b", list("abcdefij")), ("c", list("cdefijkl")), ("d", list("efijklmn"))]
    df = spark.createDataFrame(s, "id string, items array<string>")
    assert len({x.cluster for x in K.set_clusters(spark, df).collect()}) == 1
    assert len({x.cluster for x in K.set_clusters(spark, df, split_loose=True).collect()}) > 1


def edit(a, b):
    """Least edit distance of a to any stretch of b."""
    old = [0] * (len(b) + 1)
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(old[j + 1] + 1, new[j] + 1, old[j] + (x != y)))
        old = new
    return min(old)


@pytest.mark.parametrize("seed", range(20))
def test_myers(seed):
    r = random.Random(seed)
    a, b = [r.randrange(4) for _ in range(r.randint(1, 40))], [r.randrange(4) for _ in range(r.randint(0, 60))]
    assert L.myers(a, b) == edit(a, b)


def test_leaks(spark):
    r = random.Random(6)
    line = "Read the excerpt and answer with one label only please now."
    items = [(i, (line + " " if i % 2 else "") + sentence(r, 90) + ".") for i in range(6)] + [(9, None), (None, "x"), (10, ""), (2, None)]
    w = [L.words(t.replace(line, "")) if t else [] for _, t in items[:6]]
    noise = lambda n: sentence(random.Random(n), n)
    fuzzy = w[3][20:62]
    for k in range(4, 42, 7):
        fuzzy[k] = "changed"
    heavy = w[4][20:62]
    for k in range(1, 42, 3):
        heavy[k] = "changed"
    docs = [
        (1, noise(40) + " " + " ".join(w[0][10:25]) + " " + noise(41)), (2, noise(42) + " " + " ".join(w[1][10:24]) + " zzz"), (3, "“" + ",\n".join(x.upper() for x in w[2]) + "”"),
        (4, noise(43) + " " + " ".join(fuzzy) + " " + noise(44)), (5, " ".join(heavy)), (6, line + " " + noise(50)), (7, None), (8, ""), (None, " ".join(w[0])), (9, (" ".join(w[5][:15]) + " ") + noise(20_000)), (10, "&amp; " + " ".join(w[0][:20]).replace(" ", " ")),
    ]
    d = spark.createDataFrame([(*x, "z") for x in docs], "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in L.leaks(spark, d, i).collect()}
    assert got == {(1, 0), (3, 2), (4, 3), (9, 5), (10, 0)}
    assert {(x.doc_id, x.item_id) for x in L.leaks(spark, d, i, most=1).collect()} == got
    assert L.leaks(spark, d.limit(0), i, most=1).count() == 0
    assert L.leaks(spark, d, i.limit(0)).count() == 0 and L.leaks(spark, d.limit(0), i).count() == 0


@pytest.mark.parametrize("most", [2, 5000])
def test_any_number_of_items(spark, most):
    r = random.Random(7)
    items = [(i, sentence(r, 40)) for i in range(5)]
    d = spark.createDataFrame([(i, t) for i, t in items], "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in L.leaks(spark, d, spark.createDataFrame(items, "item_id long, text string"), most).collect()} == {(i, i) for i in range(5)}


def test_raking():
    rng = np.random.default_rng(1)
    tokens = rng.integers(10, 1000, 60).astype(float)
    source, lang = np.arange(60) % 4, np.arange(60) // 4 % 3
    want = np.array([3000.0, 1000.0, 2000.0, 1500.0])
    cap = tokens * 3
    w = M.rake(tokens, cap, source, want, [(lang, np.array([0.5, 0.3, 0.2]))])
    assert (w <= cap + 1e-6).all() and (w > 0).all()
    assert np.bincount(source, w, 4) == pytest.approx(want, rel=1e-6)
    shares = np.bincount(lang, w, 3) / w.sum()
    assert shares == pytest.approx([0.5, 0.3, 0.2], abs=0.02)


def test_raking_of_an_exhausted_source():
    tokens = np.full(24, 100.0)
    source, lang = np.arange(24) % 4, np.arange(24) // 4 % 3
    want = np.array([300.0, 100.0, 200.0, 1e9])
    w = M.rake(tokens, tokens * 3, source, want, [(lang, np.array([0.9, 0.1, 0.0]))])
    assert np.bincount(source, w, 4) == pytest.approx([300, 100, 200, 1800], rel=1e-6)
    assert (w > 0).all() and (w <= 300 + 1e-6).all()


def test_mix(spark):
    r = random.Random(9)
    docs = [(i, ["big", "small", "Big ", "other"][min(i % 40, 3) if i % 40 < 3 else (0 if i % 2 else 3)], r.choice(["en", "de", None]), r.choice(["t1", "t2"]), r.randint(5, 60)) for i in range(2000)]
    d = spark.createDataFrame([(i, s.strip().lower(), g or "unknown", t, n) for i, s, g, t, n in docs], "doc_id long, source string, lang string, topic string, tokens long")
    t = spark.createDataFrame([("m", "big", 0.5, 2.0, 0.5), ("m", "small", 0.3, 3.0, 0.5), ("m", "other", 0.2, 1.0, 0.5), ("m", "none", 0.0, 1.0, 0.5), (None, "big", 1.0, 1.0, 1.0)], "mix_name string, source string, target_share double, max_repeats double, size_factor double")
    got = M.draw(d, t).groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("n"), F.max("copies").alias("c")).collect()
    have = {x.source: x.n for x in d.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    total = sum(have.values()) * 0.5
    for x in got:
        share, most = {"big": (0.5, 2), "small": (0.3, 3), "other": (0.2, 1)}[x.source]
        assert x.n <= most * have[x.source] and x.c <= most
        assert x.n == pytest.approx(min(share * total, most * have[x.source]), rel=0.02)
    assert M.draw(d.limit(0), t).count() == 0 and M.draw(d, t.limit(0)).count() == 0


def test_token_counts(spark):
    d = spark.createDataFrame([("hello world",), (None,), ("",), ("a " * 120_000,)], "text string")
    n = [x.tokens for x in M.token_counts(d).collect()]
    assert n[:3] == [2, 0, 0] and n[3] >= 120_000


def test_boosting_and_calibration():
    rng = np.random.default_rng(0)
    x = rng.standard_normal((3000, 5))
    y = ((x[:, 0] * x[:, 1] > 0) & (x[:, 2] > -0.5)).astype(float)
    m = Boosted().fit(x[:2000], y[:2000]).margin(x[2000:])
    assert ((m > 0) == (y[2000:] > 0)).mean() > 0.93
    p = Isotonic().fit(m, y[2000:]).predict(np.sort(m))
    assert (np.diff(p) >= 0).all() and abs(p.mean() - y[2000:].mean()) < 1e-9


@pytest.mark.parametrize(("raw", "word"), [("a$$h0l3", "asshole"), ("cr33p", "creep"), ("cooooward", "coward"), ("f***k", "freak"), ("n@k3d", "naked"), ("ho.rny", "horny"), ("hello", "hello"), ("2025", "2025"), ("don't", "don't")])
def test_disguises(raw, word):
    assert T.undisguised(raw)[0] == word
    assert T.tokens("you c r e e p there")[0] == ["you", "creep", "there"]


def labelled(r, n):
    bad = ["You {a} {i}, get out.", "Shut your mouth, {i}.", "All {g} are vermin and should be driven out.", "I will break your legs."]
    good = ["My brother used to call me a {a} {i}.", "I felt like a {i} that day.", "Rule: never call anybody {a}.", "The {g} in the group asked for a room.", "We walked to the park and sat down.", "The number came down on its own.", "It was a long week and I slept badly."]
    fill = lambda s: s.format(a=r.choice(["stupid", "filthy", "useless"]), i=r.choice(["idiot", "coward", "pig"]), g=r.choice(["migrants", "women"]))
    rows = []
    for _ in range(n):
        y = r.random() < 0.2
        s = [fill(r.choice(good)) for _ in range(r.randint(2, 6))]
        if y:
            s.insert(r.randrange(len(s)), fill(r.choice(bad)))
        rows.append((" ".join(s), float(y)))
    return rows


def test_toxicity_on_held_out_documents():
    r = random.Random(11)
    train, test = labelled(r, 1500), labelled(r, 400)
    noisy = [(t, 1 - y if r.random() < 0.04 else y) for t, y in train]
    m = T.fit(pd.DataFrame(noisy, columns=["text", "toxic"]))
    p, _ = m.documents([t for t, _ in test])
    y = np.array([y for _, y in test])
    assert ((p >= T.FOUND) == (y == 1)).mean() > 0.95


def test_scores_of_odd_input(spark):
    r = random.Random(12)
    rows = [(i, t) for i, (t, _) in enumerate(labelled(r, 60))] + [(100, None), (101, ""), (102, "word " * 50_000), (None, "x")]
    d = spark.createDataFrame([(*x, "z") for x in rows], "doc_id long, text string, toxic string")
    l = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(60)] + [(3, 1), (4, None), (None, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x.probability for x in T.scores(d, l).collect()}
    assert len(got) == 63 and got[100] == got[101] == 0.0
    assert T.scores(d, l.limit(0)).count() == 63 and T.scores(d.limit(0), l).count() == 0


def test_near_copies_of_an_item_keep_their_opening(spark):
    r = random.Random(21)
    opening = sentence(r, 16) + "."
    body = sentence(r, 60)
    items = [(1, f"{opening} {body}"), (2, f"{opening} {light(r, body)}"), (3, "Read the passage and answer. " + sentence(r, 50)), (4, "Read the passage and answer. " + sentence(r, 50))]
    i = spark.createDataFrame(items, "item_id long, text string")
    assert L._lines(i) == [["read", "the", "passage", "and", "answer"]]
    d = spark.createDataFrame([(7, f"{sentence(r, 9)} {opening} {sentence(r, 9)}")], "doc_id long, text string")
    assert {(x.doc_id, x.item_id) for x in L.leaks(spark, d, i).collect()} == {(7, 1), (7, 2)}
