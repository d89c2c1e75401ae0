"""Readers of the two dialogue corpora's JSON files, label files, splits and stored flows, all with explicit schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Schemas of the files.
STAR_SCHEMA = "DialogueID long, Events array<struct<Agent:string, Action:string, Text:string, ActionLabel:string, APIName:string>>"
TV_TALK, TV_META = "full_conversation array<string>", "client_profile map<string,string>, therapist_profile map<string,string>, trauma_info map<string,string>"
LABEL_SCHEMA = "utterance_labels array<string>, taxonomy_version string"
TAXONOMY_SCHEMA = "user array<struct<label:string, description:string>>, agent array<struct<label:string, description:string>>"
FLOW_SCHEMA = "nodes array<struct<id:string, actor:string, label:string, utterances:array<string>>>, edges array<array<string>>"


def _stem(suffix: str):
    return F.regexp_extract(F.col("_metadata.file_name"), rf"^(.*?){suffix}\.json$", 1)


def read_star(spark: SparkSession, folder: str, unlabelled: bool = False) -> DataFrame:
    """Turns of STAR dialogues: (dialogue_id, task, turn, actor, text, label).

    User 'utter' events are user turns, Wizard 'pick_suggestion' events agent turns with their label; a dialogue with a
    non-empty Wizard 'utter' event is dropped unless unlabelled is set. The task is the first API name of any event;
    dialogues without task or turn are dropped.
    """
    raw = spark.read.schema(STAR_SCHEMA).option("multiLine", True).json(f"{folder}/*.json").select("DialogueID", "Events", _stem("").alias("stem"))
    raw = raw.withColumn("dialogue_id", F.coalesce("DialogueID", F.col("stem").try_cast("long")))
    named = F.filter("Events", lambda e: F.coalesce(e["APIName"], F.lit("")) != "")
    free = F.exists("Events", lambda e: (e["Agent"] == "Wizard") & (e["Action"] == "utter") & (F.trim(F.coalesce(e["Text"], F.lit(""))) != ""))
    raw = raw.withColumn("task", F.try_element_at(named, F.lit(1))["APIName"]).where("task is not null")
    if not unlabelled:
        raw = raw.where(~F.coalesce(free, F.lit(False)))
    e = raw.select("dialogue_id", "task", F.posexplode("Events").alias("pos", "e"))
    actor = F.when((F.col("e.Agent") == "User") & (F.col("e.Action") == "utter"), "user").when((F.col("e.Agent") == "Wizard") & (F.col("e.Action") == "pick_suggestion"), "agent")
    e = e.select("dialogue_id", "task", "pos", actor.alias("actor"), F.coalesce("e.Text", F.lit("")).alias("text"), F.when(actor == "agent", F.col("e.ActionLabel")).alias("label")).where("actor is not null")
    return e.withColumn("turn", F.row_number().over(Window.partitionBy("dialogue_id").orderBy("pos")) - 1).select("dialogue_id", "task", "turn", "actor", "text", "label")


def dialogue_number(stem):
    """subject * 100 + phase of a stem such as 12_P7; null for other stems."""
    c = F.col(stem) if isinstance(stem, str) else stem
    s, p = F.regexp_extract(c, r"^(\d+)_P(\d+)$", 1), F.regexp_extract(c, r"^(\d+)_P(\d+)$", 2)
    return s.try_cast("long") * 100 + p.try_cast("long")


def read_tv(spark: SparkSession, talks: str, metadata: str, task_field: str = "type", phases: list[int] | None = None) -> DataFrame:
    """Turns of TV sessions: (dialogue_id, stem, phase, task, session_topic, turn, actor, text).

    Lines 'Speaker: text' are cut at the first colon; Therapist is the agent, Client the user, other lines are skipped.
    Conversations without metadata are dropped. phases prunes by file name before any file is opened.
    """
    names = "*_P*_conversation.json" if phases is None else "*_P{" + ",".join(map(str, phases)) + "}_conversation.json"
    t = spark.read.schema(TV_TALK).option("multiLine", True).json(f"{talks}/{names}").select(_stem("_conversation").alias("stem"), F.posexplode("full_conversation").alias("pos", "line"))
    m = spark.read.schema(TV_META).option("multiLine", True).json(f"{metadata}/*.json").select(_stem("(?:_metadata)?").alias("stem"), F.col("trauma_info")[task_field].alias("task"), F.col("trauma_info")["session_topic"].alias("session_topic"))
    part = F.split("line", ":", 2)
    who = F.trim(part[0])
    t = t.where(F.contains("line", F.lit(":"))).select("stem", "pos", F.when(who == "Therapist", "agent").when(who == "Client", "user").alias("actor"), F.trim(part[1]).alias("text")).where("actor is not null and text <> ''")
    t = t.withColumn("turn", F.row_number().over(Window.partitionBy("stem").orderBy("pos")) - 1).join(m, "stem")
    return t.select(dialogue_number("stem").alias("dialogue_id"), "stem", F.regexp_extract("stem", r"_P(\d+)$", 1).cast("int").alias("phase"), "task", "session_topic", "turn", "actor", "text")


def read_labels(spark: SparkSession, folder: str, version: str | None = None) -> DataFrame:
    """(dialogue_id, turn, label) of label files named by dialogue; with version, a file of another taxonomy version is an error."""
    r = spark.read.schema(LABEL_SCHEMA).option("multiLine", True).json(f"{folder}/[0-9]*.json").select(_stem("").try_cast("long").alias("dialogue_id"), "utterance_labels", "taxonomy_version").where("dialogue_id is not null")
    labels = F.col("utterance_labels")
    if version is not None:
        stale = F.raise_error(F.concat(F.lit("labels of another taxonomy version: dialogue "), F.col("dialogue_id").cast("string"))).cast("array<string>")
        labels = F.when(F.col("taxonomy_version").eqNullSafe(version), labels).otherwise(stale)
    return r.select("dialogue_id", F.posexplode(labels).alias("turn", "label"))


def read_taxonomy(spark: SparkSession, path: str) -> DataFrame:
    """(actor, ord, label, description) of a taxonomy file."""
    t = spark.read.schema(TAXONOMY_SCHEMA).option("multiLine", True).json(path)
    one = lambda a: t.select(F.lit(a).alias("actor"), F.posexplode(a).alias("ord", "e")).select("actor", "ord", "e.label", "e.description")
    return one("user").unionByName(one("agent"))


def write_split(split: DataFrame, path: str) -> None:
    """Stores (version, stratum, dialogue_id, side), partitioned by version so that a version is read alone."""
    split.select("version", "stratum", "dialogue_id", "side").write.mode("overwrite").partitionBy("version").parquet(path)


def read_split(spark: SparkSession, path: str, version: str) -> DataFrame:
    return spark.read.parquet(path).where(F.col("version") == version).select("version", "stratum", "dialogue_id", "side")


def write_flows(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Flows as JSON documents, one per flow: nodes (flow_id, ord, id, actor, label, utterances) in order and edges (flow_id, src, dst)."""
    n = nodes.groupBy("flow_id").agg(F.sort_array(F.collect_list(F.struct("ord", F.struct("id", "actor", "label", "utterances").alias("n")))).alias("n"))
    e = edges.groupBy("flow_id").agg(F.sort_array(F.collect_list(F.array("src", "dst"))).alias("edges"))
    n.join(e, "flow_id", "left").select("flow_id", F.col("n.n").alias("nodes"), F.coalesce("edges", F.array().cast("array<array<string>>")).alias("edges")).write.mode("overwrite").json(path)


def read_flows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """nodes and edges as given to write_flows()."""
    f = spark.read.schema("flow_id string, " + FLOW_SCHEMA).json(path)
    n = f.select("flow_id", F.posexplode("nodes").alias("ord", "n")).select("flow_id", "ord", "n.id", "n.actor", "n.label", "n.utterances")
    e = f.select("flow_id", F.explode("edges").alias("e")).select("flow_id", F.col("e")[0].alias("src"), F.col("e")[1].alias("dst"))
    return n, e


def write_results(rows: DataFrame, path: str) -> None:
    """Result rows as JSON lines, replacing an earlier run's; nulls are written, so every row has every field."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Appends call records as JSON lines."""
    rows.write.mode("append").json(path)
