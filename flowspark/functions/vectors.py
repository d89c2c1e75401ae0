"""Column functions on arrays of numbers, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: keeps the cosine of a zero vector finite.
EPSILON = 1e-9


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - a.b / (|a||b| + EPSILON): 1 for a zero vector, null for a null one."""
    return F.lit(1.0) - dot(a, b) / (norm(a) * norm(b) + EPSILON)


def unit_distance(a: Column, b: Column) -> Column:
    """1 - a.b of vectors known to be of unit length."""
    return F.lit(1.0) - dot(a, b)


def normalised(a: Column) -> Column:
    """a over its length; a zero vector gives null elements."""
    return F.transform(a, lambda x: x / F.nullif(norm(a), F.lit(0.0)))


def mean_vectors(df: DataFrame, keys: list[str], vector: str, out: str = "vector") -> DataFrame:
    """Element-wise mean of the vectors of each group, partially aggregated as whole vectors.

    Null and empty vectors and those with a null element do not count; of a group's vectors those of its most frequent length do
    (ties: the longer). Groups without a vector have no row.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = F.col(vector)
    p = df.where(v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull())).select(*keys, F.size(v).alias("_d"), array_to_vector(v.cast("array<double>")).alias("_v"))
    m = p.groupBy(*keys, "_d").agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("_n"))
    m = m.select(*keys, F.struct("_n", "_d", vector_to_array("_m").alias("_m")).alias("_r"))
    return m.groupBy(*keys).agg(F.max("_r").alias("_r")).select(*keys, F.col("_r._m").alias(out))


def average_rank(df: DataFrame, value: str, *partition: str, out: str = "rank") -> DataFrame:
    """df with the rank of value inside each partition, ties sharing the mean of their ranks.

    The values' counts are summed first, so a window row is a distinct value, not a row of the data.
    """
    n = df.groupBy(*partition, value).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*partition).orderBy(value)
    r = n.withColumn(out, F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - (F.col("_n") - 1) / 2.0).drop("_n")
    return df.join(r, [*partition, value])
