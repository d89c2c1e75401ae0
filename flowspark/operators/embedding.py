"""Vectors for texts: a table lookup, a hashed bag of words, or a user's Arrow function; each distinct text is embedded once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.functions.vectors import mean_vectors, unit_distance


class Embedder(Protocol):
    def __call__(self, texts: DataFrame) -> DataFrame:
        """(text, vector) of distinct texts (column text)."""


def lookup(table: DataFrame) -> Embedder:
    """Vectors of a table (text, vector); texts it does not hold have none."""
    return lambda texts: texts.join(table.select("text", "vector"), "text")


def hashed_words(dim: int = 64) -> Embedder:
    """Counts of word hashes over dim places, to unit length; in the JVM. Texts without words have a zero vector."""

    def embed(texts: DataFrame) -> DataFrame:
        place = F.transform(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.pmod(F.xxhash64(w), F.lit(dim)))
        count = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.size(F.filter("_p", lambda p: p == i)).cast("double"))
        t = texts.withColumn("_p", place).select("text", count.alias("v"))
        n = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
        return t.select("text", F.when(n > 0, F.transform("v", lambda x: x / n)).otherwise(F.col("v")).alias("vector"))

    return embed


def arrow(encode: Callable[[Iterator[pd.Series]], Iterator[pd.Series]]) -> Embedder:
    """A model of the user's: called with batches of texts, gives batches of arrays; loaded once per task by the generator."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from encode(batches)

    return lambda texts: texts.withColumn("vector", F.pandas_udf(run, "array<double>")("text"))


def with_vectors(df: DataFrame, text: str, embedder: Embedder) -> DataFrame:
    """df with vector: distinct texts are embedded, then joined back."""
    v = embedder(df.where(F.col(text).isNotNull()).select(F.col(text).alias("text")).distinct())
    return df.join(v.select(F.col("text").alias(text), "vector"), text, "left")


def similar_pairs(points: DataFrame, least: float) -> DataFrame:
    """(a, b) of points (id, vector of unit length) with a < b and a dot product of at least `least`. Meant for label lists: all pairs are compared."""
    x, y = points.select(F.col("id").alias("a"), F.col("vector").alias("x")), points.select(F.col("id").alias("b"), F.col("vector").alias("y"))
    return x.join(y, F.col("a") < F.col("b")).where(F.lit(1.0) - unit_distance(F.col("x"), F.col("y")) >= least).select("a", "b")


def embedding_gate(labels: DataFrame, positives: DataFrame, negatives: DataFrame, least: float = 0.2) -> DataFrame:
    """(label, pos, neg, gap, passed): mean distances of a label's vector to texts that have the label and that do not.

    labels (label, vector), positives and negatives (label, vector), all of unit length.
    """
    def mean(df: DataFrame, name: str) -> DataFrame:
        x = df.select("label", F.col("vector").alias("_t")).join(labels.select("label", F.col("vector").alias("_l")), "label")
        return x.groupBy("label").agg(F.avg(unit_distance(F.col("_l"), F.col("_t"))).alias(name))

    g = mean(positives, "pos").join(mean(negatives, "neg"), "label")
    return g.withColumn("gap", F.col("neg") - F.col("pos")).withColumn("passed", F.col("gap") >= least)


def label_centres(turns: DataFrame, *keys: str) -> DataFrame:
    """Mean vector per keys and label."""
    return mean_vectors(turns, [*keys, "label"], "vector")
