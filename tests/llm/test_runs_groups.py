"""Runs of events and grouped splits against plain forms, with nulls, ties, repeats, empty tables and clashing columns."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from flowspark.llm import groups as G
from flowspark.llm import runs as R

EVENTS = "e long, o int, sym string, t timestamp, n string, first string"


def plain_runs(rows):
    out, by = set(), {}
    for e, o, s, *_ in rows:
        if e is not None and o is not None:
            k = by.setdefault(e, {})
            k[o] = min(k.get(o, s), s)
    for e, k in by.items():
        o = sorted(k)
        i = 0
        while i < len(o):
            j = i
            while j + 1 < len(o) and k[o[j + 1]] == k[o[i]] and k[o[i]] != R.NOTHING:
                j += 1
            if j > i:
                out.add((e, o[i], o[j], j - i + 1))
            i = j + 1
    return out


@pytest.mark.parametrize("stretch", [3, 7, 4096])
def test_runs_match_plain_form(spark, stretch):
    r = random.Random(stretch)
    t0 = datetime(2025, 1, 1)
    rows = [(r.choice([1, 1, 1, 2, None]), o, r.choice(["一", "丁", R.NOTHING]), None if r.random() < 0.2 else t0 + timedelta(seconds=o), "x", "y") for o in r.choices(range(60), k=150)]
    got = R.collapse_runs(spark.createDataFrame(rows, EVENTS), "e", "o", "t", stretch).collect()
    assert {(x.e, x["first"], x["last"], x.n) for x in got} == plain_runs(rows)


def test_run_duration_and_empty(spark):
    t0 = datetime(2025, 1, 1)
    rows = [(1, 0, "一", t0, "", ""), (1, 5, "一", None, "", ""), (1, 9, "一", t0 + timedelta(seconds=90), "", ""), (2, 0, "一", None, "", ""), (2, 1, "一", None, "", "")]
    df = spark.createDataFrame(rows, EVENTS)
    assert {x.e: x.duration_s for x in R.collapse_runs(df, "e", "o", "t").collect()} == {1: 90.0, 2: None}
    assert R.collapse_runs(df.limit(0), "e", "o", "t").count() == 0


def test_label_spellings(spark):
    valid = spark.createDataFrame([("ask_hotel",), ("ask_food",), (None,)], "label string")
    raw = [("Ask Hotel", "ask_hotel"), ("AskHotel", "ask_hotel"), ("ask-hotle", "ask_hotel"), ("akshotel", "ask_hotel"), ("ask_hotell", "ask_hotel"), ("sk_food", "ask_food"), ("ask_fxxd", None), ("unknown", None), ("", None), (None, None)]
    got = {x.raw: x.label for x in R.canonical_labels(spark.createDataFrame([(a,) for a, _ in raw], "raw string"), valid).collect()}
    assert got == {a: b for a, b in raw if b}


def plain_groups(edges):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            up[find(a)] = find(b)
    parts = {}
    for x in up:
        parts.setdefault(find(x), set()).add(x)
    return {frozenset(p) for p in parts.values()}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(f"s{r.randrange(40)}", f"c{r.randrange(40)}") for _ in range(45)] + [("hub", f"s{i}") for i in range(0, 40, 3)] + [(None, "x"), ("x", None), ("loop", "loop"), ("s1", "c1"), ("s1", "c1")]
    label, forest = G.spanning_forest(spark, spark.createDataFrame(edges, "a string, b string"))
    parts = {}
    for x in label.collect():
        parts.setdefault(x.root, set()).add(x.v)
    want = plain_groups(edges)
    assert {frozenset(p) for p in parts.values()} == want
    assert forest.count() == sum(len(p) - 1 for p in want)


def test_long_chain_and_empty(spark):
    n = 200
    label, forest = G.spanning_forest(spark, spark.createDataFrame([(i, i + 1) for i in range(n)], "a long, b long"))
    assert label.select("root").distinct().count() == 1 and forest.count() == n
    label, forest = G.spanning_forest(spark, spark.createDataFrame([], "a long, b long"))
    assert label.count() == 0 and forest.count() == 0


def test_deal_keeps_groups_and_shares(spark):
    r = random.Random(1)
    rows = [(g, str(g % 3) if g % 7 else None) for g in range(600) for _ in range(r.choice([1, 1, 2, 5]))] + [(None, "0")]
    m = spark.createDataFrame(rows, "g long, s string")
    side = G.deal(m, "g", "s", [("train", 0.7), ("validation", 0.1), ("test", 0.2)])
    assert side.count() == 600 and side.select("g").distinct().count() == 600
    n = {x.side: x["count"] for x in m.join(side, "g").groupBy("side").count().collect()}
    total = sum(n.values())
    assert abs(n["train"] / total - 0.7) < 0.03 and abs(n["validation"] / total - 0.1) < 0.03


def test_deal_of_nothing(spark):
    assert G.deal(spark.createDataFrame([], "g long, s string"), "g", "s", [("a", 1.0)]).count() == 0


def test_tv_groups(spark, tmp_path):
    cols = "dialogue_id long, corpus string, stem string, subject long, phase string, client_ref string, root string"
    rows = [(105, "TV", None, 1, "P5", "CL-AB1", "z"), (205, "TV", "2_P5", None, "5", "cl ab1", "z"), (206, " tv", None, None, None, None, "z"), (305, "TV", None, 3, "Phase 5", "N/A", "z"), (405, "TV", None, 4, "p5", "n/a", "z"), (405, "TV", None, 4, "p5", "n/a", "z"), (9, "STAR", None, None, None, "CL-AB1", "z")]
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "dialogues.parquet"))
    got = {x.dialogue_id: (x.group_id, x.phase) for x in G.tv_groups(spark, str(tmp_path)).collect()}
    assert got == {105: (105, 5), 205: (105, 5), 206: (105, 6), 305: (305, 5), 405: (405, 5)}
    s = G.tv_split(spark, str(tmp_path))
    assert s.count() == 5 and s.groupBy("group_id").agg(F.countDistinct("side").alias("n")).where("n > 1").count() == 0
