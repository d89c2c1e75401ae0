"""Conversations from the stored utterances, and operators on their turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.session import small_broadcast
from flowspark.sources.tables import NO_DIALOGUE, actor_side, canonical_name, latest, read, squashed

#: The split versions in force.
CURRENT_VERSIONS = ["TV_v1", "STAR_v2"]
UNKNOWN = "unknown"


def taxonomy(spark: SparkSession, d: str) -> DataFrame:
    """(label, key): distinct valid labels and their squashed spelling. A vocabulary: small by nature, checked before it is broadcast."""
    return read(spark, d, "taxonomy").where("label is not null").select("label", squashed("label").alias("key")).distinct()


def conversations(spark: SparkSession, d: str, vectors: bool = False) -> DataFrame:
    """One row per turn of a known dialogue: (dialogue_id, turn, actor, text, label[, vector]).

    Latest deliveries; actor is user or agent (rows of other speakers are dropped), text is trimmed ('' for null), label is
    the taxonomy's spelling or 'unknown'; vector is an array<double> or null.
    """
    t = latest(read(spark, d, "utterances"), "utt_id", "dialogue_id", "turn", "actor", "text", "label", *["embedding"] * vectors)
    t = t.where(f"dialogue_id <> {NO_DIALOGUE} and turn is not null").withColumn("actor", actor_side("actor")).where("actor is not null")
    t = t.withColumn("key", squashed("label")).join(small_broadcast(taxonomy(spark, d).withColumnRenamed("label", "valid")), "key", "left")
    v = [F.col("embedding").cast("array<double>").alias("vector")] if vectors else []
    return t.select("dialogue_id", "turn", "actor", F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")).alias("text"), F.coalesce("valid", F.lit(UNKNOWN)).alias("label"), *v)


def sides(spark: SparkSession, d: str) -> DataFrame:
    """(corpus, stratum, dialogue_id, side) of the current split files, one row per dialogue."""
    s = read(spark, d, "split_members").where(F.col("version").isin(CURRENT_VERSIONS) & F.col("dialogue_id").isNotNull())
    s = s.select(F.split("version", "_")[0].alias("corpus"), F.trim("stratum").alias("stratum"), "dialogue_id", canonical_name("side").alias("side"))
    return s.groupBy("dialogue_id").agg(F.min(F.struct("corpus", "stratum", "side")).alias("m")).select("m.corpus", "m.stratum", "dialogue_id", "m.side")


def context_labels(turns: DataFrame) -> DataFrame:
    """turns with intent: agent turns keep their label, a user turn is named after the next labelled agent turn, else 'unknown'."""
    w = Window.partitionBy("dialogue_id").orderBy("turn").rowsBetween(1, Window.unboundedFollowing)
    nxt = F.first_value(F.when((F.col("actor") == "agent") & (F.col("label") != UNKNOWN), F.col("label")), ignoreNulls=True).over(w) if hasattr(F, "first_value") else F.first(F.when((F.col("actor") == "agent") & (F.col("label") != UNKNOWN), F.col("label")), ignorenulls=True).over(w)
    return turns.withColumn("intent", F.when(F.col("actor") == "agent", F.col("label")).otherwise(F.coalesce(F.concat(F.lit("user_before_"), nxt), F.lit(UNKNOWN))))


def override_labels(turns: DataFrame, labels: DataFrame) -> DataFrame:
    """turns with the labels of another source (dialogue_id, turn, label).

    Dialogues without labels are left out; a dialogue whose number of labels differs from its number of turns is an error.
    """
    n = turns.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("_n")).join(labels.groupBy("dialogue_id").agg(F.count(F.lit(1)).alias("_m")), "dialogue_id")
    bad = F.raise_error(F.concat(F.lit("labels and turns differ in dialogue "), F.col("dialogue_id").cast("string"))).cast("boolean")
    n = n.where(F.when(F.col("_n") == F.col("_m"), F.lit(True)).otherwise(bad)).select("dialogue_id")
    return turns.drop("label").join(n, "dialogue_id", "left_semi").join(labels.select("dialogue_id", "turn", "label"), ["dialogue_id", "turn"])


def sentinel_labels(turns: DataFrame) -> DataFrame:
    """turns with user turns labelled '_user_turn'."""
    return turns.withColumn("label", F.when(F.col("actor") == "user", "_user_turn").otherwise(F.col("label")))


def first_texts(turns: DataFrame) -> DataFrame:
    """(actor, text, dialogue_id, turn): every distinct text of an actor with the place it is first seen at."""
    g = turns.where("text <> ''").groupBy("actor", "text").agg(F.min(F.struct("dialogue_id", "turn")).alias("m"))
    return g.select("actor", "text", "m.dialogue_id", "m.turn")


def packed(turns: DataFrame) -> DataFrame:
    """(dialogue_id, turns): one row per dialogue with its turns (turn, actor, text, label) in order."""
    return turns.groupBy("dialogue_id").agg(F.sort_array(F.collect_list(F.struct("turn", "actor", "text", "label"))).alias("turns"))


def run_lengths(turns: DataFrame) -> DataFrame:
    """(dialogue_id, run, actor, label, first_turn, last_turn, n): maximal stretches of equal actor and label, by gaps and islands."""
    w = Window.partitionBy("dialogue_id").orderBy("turn")
    same = (F.lag("actor").over(w) == F.col("actor")) & (F.lag("label").over(w) == F.col("label"))
    x = turns.withColumn("_new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("_new").over(w))
    return x.groupBy("dialogue_id", "run", "actor", "label").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("n"))
