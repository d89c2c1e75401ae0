"""The views of the stored tables that several operators of this package share."""

from __future__ import annotations

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.sources.tables import NO_DIALOGUE, canonical_name, latest, read

#: The split versions in force.
CURRENT_VERSIONS = ["TV_v1", "STAR_v2"]


class Hashed(dict):
    """64-bit hashes of words, kept while there is room."""

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[w] = xxhash.xxh64_intdigest(w)
        return h


def turns(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Latest deliveries of the turns of known dialogues: (dialogue_id, turn, *columns)."""
    t = latest(read(spark, d, "utterances"), "utt_id", "dialogue_id", "turn", *columns)
    return t.where(f"dialogue_id <> {NO_DIALOGUE} and turn is not null").drop("utt_id")


def current_sides(spark: SparkSession, d: str, versions: list[str] = CURRENT_VERSIONS) -> DataFrame:
    """One row per dialogue of the current split files: (dialogue_id, side, stratum); contradicting rows: the smallest side."""
    s = read(spark, d, "split_members").where(F.upper(F.trim("version")).isin([v.upper() for v in versions]))
    s = s.select("dialogue_id", canonical_name("side").alias("side"), F.trim("stratum").alias("stratum"))
    return s.where("dialogue_id is not null and side in ('train', 'validation', 'test')").groupBy("dialogue_id").agg(F.min(F.struct("side", "stratum")).alias("m")).select("dialogue_id", "m.side", "m.stratum")


def plain_text(c: Column | str) -> Column:
    """Lower-case words separated by single blanks; quote marks vanish, other signs separate; null gives ''."""
    c = F.col(c) if isinstance(c, str) else c
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "['‘’`´\"“”„«»]+", "")
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))
