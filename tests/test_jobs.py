"""Entry points over small tables written here."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from flowspark.plans import jobs as J


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(0)
    centre = {x: rng.standard_normal(8) for x in ("greet", "ask", "offer", "bye", "pay", "thank")}
    script = {"hotel": ["greet", "ask", "offer", "bye"], "bank": ["greet", "pay", "thank", "bye"]}
    utt, split, k = [], [], 0
    for i in range(40):
        task = "hotel" if i % 2 else "bank"
        for j, x in enumerate(script[task]):
            k += 1
            v = (centre[x] + 0.1 * rng.standard_normal(8)).astype(np.float32)
            utt.append((k, i, j, "agent" if j % 2 else "user", f"{x} {i}", x, v.tolist(), "STAR", datetime(2025, 1, 1), datetime(2025, 1, 2)))
        split.append(("STAR_v2", task, i, "train" if i < 24 else "test"))
    spark.createDataFrame(utt, "utt_id long, dialogue_id long, turn int, actor string, text string, label string, embedding array<float>, corpus string, spoken_at timestamp_ntz, loaded_at timestamp_ntz").write.parquet(f"{d}/utterances.parquet")
    spark.createDataFrame(split, "version string, stratum string, dialogue_id long, side string").write.parquet(f"{d}/split_members.parquet")
    spark.createDataFrame([("STAR", a, i, x, None) for i, x in enumerate(centre) for a in ("user", "agent")], "corpus string, actor string, ord int, label string, description string").write.parquet(f"{d}/taxonomy.parquet")
    return str(d)


def test_in_task_is_nearer(spark, tables):
    r = {x.flow_id: x for x in J.validate_discrimination(spark, tables).collect()}
    assert set(r) == {"STAR:hotel", "STAR:bank"} and all(x.gap > 0 and x.n_pos == x.n_neg == 8 for x in r.values())


def test_tests_and_variants(spark, tables):
    assert all(x.rbc == 1 for x in J.star_validation(spark, tables).collect())
    assert J.star_validation(spark, tables).where("passed").count() == 2
    assert J.tv_prefix_trees(spark, tables).count() == 0
    v = {x.variant: x.n_phases for x in J.graph_discrimination(spark, tables, corpus="STAR").collect()}
    assert v == {"plain": 2, "segmented": 2, "dwell": 2}
    assert J.significance(spark, tables).count() == 2 and J.length_matched(spark, tables, "STAR").count() == 2
    assert set(J.phase_confusion(spark, tables, "STAR").columns) == {"flow_id", "STAR:hotel", "STAR:bank"}


def test_labelling_falls_back(spark, tables):
    def labeler(batches):
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "response": ["greet\nnonsense"] * len(b)})

    got = J.label_dialogues(spark, tables, labeler)
    n = {(x.turn, x.answered): x["count"] for x in got.groupBy("turn", "answered").count().collect()}
    assert n == {(0, True): 40, (1, False): 40, (2, False): 40, (3, False): 40}
    truth = got.where("not answered and turn = 3 and label = 'bye'").count()
    assert truth == 40
    assert J.align_graphs(spark, tables).agg(F.sum("n")).first()[0] == 160


@pytest.mark.parametrize("mode", ["whole", "agent", "window", "chunk"])
def test_label_modes(spark, tables, mode):
    """The labeler answers every line it is shown with the line's own label."""

    def labeler(batches):
        for b in batches:
            out = []
            for p in b["payload"]:
                lines = p.split("\n")
                own = [x.split(") ")[1].split()[0] for x in lines if x.startswith("  [")]
                if mode == "agent":
                    own = [x.split(") ")[1].split()[0] for x in lines if "(agent)" in x]
                if mode == "window":  # four turns, all in every window
                    own = [own[int(lines[-1].split()[1])]]
                out.append("\n".join(own))
            yield pd.DataFrame({"key": b["key"], "response": out})

    got = J.label_dialogues(spark, tables, labeler, mode=mode, width=4 if mode == "window" else 3, stride=2)
    first = [(r.turn, r.label, r.answered) for r in got.where("dialogue_id = 1").orderBy("turn").collect()]
    if mode == "agent":
        assert first == [(0, "user_before_ask", False), (1, "ask", True), (2, "user_before_bye", False), (3, "bye", True)]
    else:
        assert first == [(0, "greet", True), (1, "ask", True), (2, "offer", True), (3, "bye", True)]


@pytest.mark.parametrize("mode", ["cluster", "single", "hybrid"])
def test_taxonomy_bootstraps(spark, tables, mode):
    def labeler(batches):
        for b in batches:
            own = [dict.fromkeys(x.split(". ")[1].split()[0] for x in p.split("\n")[1:]) for p in b["payload"]]
            yield pd.DataFrame({"key": b["key"], "response": ["\n".join(f"{x}: says {x}" for x in w) for w in own]})

    got = J.bootstrap_taxonomy(spark, tables, labeler, mode, most=4)
    labels = {(r.actor, r.label, r.description) for r in got.collect()}
    assert labels == {(a, x, f"says {x}") for a, w in (("user", ("greet", "offer", "thank")), ("agent", ("ask", "pay", "bye"))) for x in w}


def test_scores_are_made_once(spark):
    """Ranks read the scores several times; the plan of a rank correlation holds no scoring, the scores being written."""
    from flowspark.plans import registry

    for name in ("block_rho", "bonferroni_pass"):
        plan = registry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "FlatMapCoGroupsInPandas" not in plan
