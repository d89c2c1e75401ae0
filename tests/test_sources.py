"""Readers of the corpora's files, over files written here."""

import json

import pytest

from flowspark.sources import corpora as R
from flowspark.streaming.scoring import activity


def put(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(value))


def event(agent, action, text="", label=None, api=None):
    return {"Agent": agent, "Action": action, "Text": text, "ActionLabel": label, "APIName": api}


def test_star(spark, tmp_path):
    put(tmp_path / "1.json", {"DialogueID": 1, "Events": [event("User", "utter", "hi"), event("Wizard", "query", api="hotel"), event("Wizard", "pick_suggestion", "hello", "greet"), event("Wizard", "request_suggestions")]})
    put(tmp_path / "2.json", {"DialogueID": 2, "Events": [event("User", "utter", "hi", api="bank"), event("Wizard", "utter", "free text")]})
    put(tmp_path / "3.json", {"DialogueID": 3, "Events": [event("User", "utter", "no task")]})
    rows = [(r.dialogue_id, r.task, r.turn, r.actor, r.text, r.label) for r in R.read_star(spark, str(tmp_path)).orderBy("turn").collect()]
    assert rows == [(1, "hotel", 0, "user", "hi", None), (1, "hotel", 1, "agent", "hello", "greet")]
    assert R.read_star(spark, str(tmp_path), unlabelled=True).select("dialogue_id").distinct().count() == 2


def test_tv(spark, tmp_path):
    put(tmp_path / "talk/1_P10_conversation.json", {"full_conversation": ["Therapist: Good: morning", "Client: Hello", "Narrator: x", "no colon", "Therapist: Bye"]})
    put(tmp_path / "talk/1_P5_conversation.json", {"full_conversation": ["Client: Early"]})
    put(tmp_path / "talk/2_P5_conversation.json", {"full_conversation": ["Client: No metadata"]})
    for s in ("1_P10", "1_P5"):
        put(tmp_path / f"meta/{s}_metadata.json", {"trauma_info": {"type": "flood", "session_topic": "sleep"}})
    rows = R.read_tv(spark, str(tmp_path / "talk"), str(tmp_path / "meta")).orderBy("dialogue_id", "turn").collect()
    assert [(r.dialogue_id, r.turn, r.actor, r.text) for r in rows] == [(105, 0, "user", "Early"), (110, 0, "agent", "Good: morning"), (110, 1, "user", "Hello"), (110, 2, "agent", "Bye")]
    assert {r.task for r in rows} == {"flood"}
    assert {r.phase for r in R.read_tv(spark, str(tmp_path / "talk"), str(tmp_path / "meta"), phases=[10]).collect()} == {10}


def test_labels(spark, tmp_path):
    put(tmp_path / "7.json", {"utterance_labels": ["a", "b"], "taxonomy_version": "v1"})
    put(tmp_path / "taxonomy.json", {"user": [{"label": "a", "description": "d"}], "agent": [{"label": "b", "description": "e"}]})
    assert [(r.dialogue_id, r.turn, r.label) for r in R.read_labels(spark, str(tmp_path), "v1").collect()] == [(7, 0, "a"), (7, 1, "b")]
    with pytest.raises(Exception, match="another taxonomy version"):
        R.read_labels(spark, str(tmp_path), "v2").collect()
    assert {(r.actor, r.ord, r.label) for r in R.read_taxonomy(spark, str(tmp_path / "taxonomy.json")).collect()} == {("user", 0, "a"), ("agent", 0, "b")}


def test_round_trips(spark, tmp_path):
    s = spark.createDataFrame([("v1", "P5", 1, "train"), ("v2", "P5", 2, "test")], "version string, stratum string, dialogue_id long, side string")
    R.write_split(s, str(tmp_path / "split"))
    assert [r.dialogue_id for r in R.read_split(spark, str(tmp_path / "split"), "v2").collect()] == [2]
    n = spark.createDataFrame([("f", 0, "a", "user", "x", ["t1", "t2"]), ("f", 1, "b", "agent", "y", [])], "flow_id string, ord int, id string, actor string, label string, utterances array<string>")
    e = spark.createDataFrame([("f", "__ROOT__", "a"), ("f", "a", "b")], "flow_id string, src string, dst string")
    R.write_flows(n, e, str(tmp_path / "flows"))
    n2, e2 = R.read_flows(spark, str(tmp_path / "flows"))
    assert sorted(map(tuple, n2.collect())) == sorted(map(tuple, n.collect())) and sorted(map(tuple, e2.collect())) == sorted(map(tuple, e.collect()))


def test_stream_agrees_with_batch(spark, tmp_path):
    rows = spark.sql("select timestamp'2025-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int), 0, 0) as ts, cast(id % 3 as string) as k from range(100)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = activity(stream, "k", "ts").writeStream.outputMode("complete").format("memory").queryName("act").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("act").collect())) == sorted(map(tuple, activity(rows, "k", "ts").collect()))
