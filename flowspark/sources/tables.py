"""Adapters from the stored tables to the engine's tables, with the repairs that dirty deliveries need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.session import Scratch, small_broadcast

#: Speaker spellings of either side, lower case.
USER_NAMES = ["user", "client"]
AGENT_NAMES = ["agent", "therapist", "wizard", "assistant"]
#: Fixed value: the dialogue_id of utterances that belong to no conversation.
NO_DIALOGUE = -1


def read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def latest(df: DataFrame, key: str, *columns: str, by: str = "loaded_at") -> DataFrame:
    """One row per key with the values of its latest delivery (ties: the greatest row). Null keys are dropped.

    The keys delivered more than once are counted first; if they are few, rows of other keys stay where they are.
    """
    rest = [c for c in columns if c != key]
    df = df.where(F.col(key).isNotNull()).select(key, by, *rest)
    twice = Scratch(df.sparkSession, "deliveries").put(df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(key))
    once = df.join(small_broadcast(twice), key, "left_anti").select(key, *rest)
    return once.unionByName(_greatest(df.join(small_broadcast(twice), key, "left_semi"), key, rest, by))


def _greatest(df: DataFrame, key: str, rest: list[str], by: str) -> DataFrame:
    return (
        df.groupBy(key)
        .agg(F.max(F.struct(F.col(by).alias("_by"), *[F.col(c) for c in rest])).alias("_r"))
        .select(key, *[F.col("_r")[c].alias(c) for c in rest])
    )


def actor_side(c: Column | str) -> Column:
    """'user', 'agent' or null for a speaker name in any spelling."""
    name = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(name.isin(USER_NAMES), "user").when(name.isin(AGENT_NAMES), "agent")


def canonical_name(c: Column | str) -> Column:
    """Lower case, blanks trimmed, separators as one underscore: one spelling for sources, strata and sides."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(F.trim(c)), r"[\s\-_]+", "_")


def squashed(c: Column | str) -> Column:
    """Lower-case letters and digits only; null stays null."""
    c = F.col(c) if isinstance(c, str) else c
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
