"""Splits that keep related records together: Boruvka components, then a systematic deal of whole groups.

Records that share a key (subject, person) are linked. Each round of Boruvka's algorithm lets every component take its
smallest edge to another one; the chosen edges are added to a persisted spanning forest and the components they join are
contracted by pointer jumping. Rounds are at most the logarithm of the number of components. A key with many records is
one vertex with many edges: its smallest edge is a partially aggregated minimum, so a hot key costs no task more than others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.session import Scratch
from flowspark.sources.tables import read, squashed

#: Spellings (squashed) of client references that name nobody.
PLACEHOLDERS = ["", "unknown", "na", "cl000000"]


def spanning_forest(spark: SparkSession, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components and spanning forest of edges (a, b).

    Returns (v, root) for every end of an edge, and the forest as (a, b) of the given edges. Null ends are dropped, loops
    and repeated edges count once or not at all; no edges give two empty tables. The root is an arbitrary member.
    """
    tmp = Scratch(spark, "forest")
    e = edges.where("a is not null and b is not null")
    labels = tmp.put(e.select(F.col("a").alias("v")).unionByName(e.select(F.col("b").alias("v"))).distinct().withColumn("root", F.col("v")))
    live = tmp.put(e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().select("a", "b", F.col("a").alias("x"), F.col("b").alias("y")))
    forest = None
    while not live.isEmpty():
        # x, y: the components of the ends a, b of an original edge; edges are ordered by (a, b)
        both = live.select("x", "y", "a", "b").unionByName(live.select(F.col("y").alias("x"), F.col("x").alias("y"), "a", "b"))
        pick = tmp.put(both.groupBy("x").agg(F.min(F.struct("a", "b", "y")).alias("m")).select("x", "m.y", "m.a", "m.b"))
        took = pick.select("a", "b").distinct()
        forest = took if forest is None else forest.unionByName(took)
        # two components that took the same edge: the smaller one is the root of their tree
        other = pick.select(F.col("x").alias("y"), F.col("y").alias("back"))
        up = tmp.put(pick.join(other, "y").select("x", F.when((F.col("back") == F.col("x")) & (F.col("x") < F.col("y")), F.col("x")).otherwise(F.col("y")).alias("p")))
        while True:
            jump = tmp.put(up.join(up.select(F.col("x").alias("p"), F.col("p").alias("q")), "p").select("x", F.col("q").alias("p"), (F.col("p") != F.col("q")).alias("moved")))
            still = not jump.where("moved").isEmpty()
            tmp.drop(up)
            up = tmp.put(jump.select("x", "p")) if still else jump.select("x", "p")
            if not still:
                break
        to = up.select(F.col("x").alias("root"), F.col("p").alias("new"))
        old, labels = labels, tmp.put(labels.join(to, "root", "left").select("v", F.coalesce("new", "root").alias("root")))
        tmp.drop(old)
        old, live = live, tmp.put(live.join(to.withColumnRenamed("root", "x"), "x").withColumn("x", F.col("new")).drop("new").join(to.withColumnRenamed("root", "y"), "y").withColumn("y", F.col("new")).drop("new").where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min(F.struct("a", "b")).alias("m")).select("m.a", "m.b", "x", "y"))
        tmp.drop(old)
    forest = tmp.put(forest if forest is not None else live.select("a", "b"))
    tmp.only(labels, forest)
    return labels, forest


def tv_groups(spark: SparkSession, d: str) -> DataFrame:
    """(dialogue_id, phase, group_id) of every TV dialogue; group_id is the smallest dialogue that must stay on its side.

    The subject is read from the column, else from the stem, else from the number (subject * 100 + phase). Persons are
    compared by the letters and digits of client_ref; placeholders link nothing.
    """
    t = read(spark, d, "dialogues").where((F.upper(F.trim("corpus")) == "TV") & F.col("dialogue_id").isNotNull())
    subject = F.coalesce(F.col("subject"), F.regexp_extract(F.coalesce("stem", F.lit("")), r"^\s*(\d+)_", 1).try_cast("long"), F.floor(F.col("dialogue_id") / 100))
    ref = squashed("client_ref")
    phase = F.regexp_extract(F.coalesce("phase", F.lit("")), r"(\d+)", 1).try_cast("int")
    t = t.select("dialogue_id", F.concat(F.lit("s"), subject.cast("string")).alias("subject"), F.when(~ref.isin(PLACEHOLDERS), F.concat(F.lit("c"), ref)).alias("person"), F.coalesce(phase, F.col("dialogue_id") % 100).cast("int").alias("phase"))
    t = Scratch(spark, "tv").put(t.distinct())
    label, _ = spanning_forest(spark, t.select(F.col("subject").alias("a"), F.col("person").alias("b")))
    g = t.select("dialogue_id", "subject", "phase").join(label.withColumnRenamed("v", "subject"), "subject", "left").withColumn("root", F.coalesce("root", "subject"))
    # a dialogue delivered with different subjects ties them together as well
    twice = g.groupBy("dialogue_id").agg(F.min("root").alias("a"), F.max("root").alias("b")).where("a <> b").select("a", "b")
    if not twice.isEmpty():
        more, _ = spanning_forest(spark, twice)
        g = g.join(more.withColumnRenamed("root", "top").withColumnRenamed("v", "root"), "root", "left").withColumn("root", F.coalesce("top", "root")).drop("top")
    least = g.groupBy("root").agg(F.min("dialogue_id").alias("group_id"))
    return g.join(least, "root").groupBy("dialogue_id").agg(F.min("phase").alias("phase"), F.min("group_id").alias("group_id"))


def deal(members: DataFrame, group: str, stratum: str, shares: list[tuple[str, float]], seed: int = 11, slices: int = 256) -> DataFrame:
    """(group, side): whole groups dealt to sides in proportion to their records.

    members: one row per record. Groups are stratified by size band (powers of two) and by the stratum of most of their
    records, ordered by hash, and dealt systematically: a group goes to the side in whose share of the stratum's records
    its middle falls, the start being shifted from stratum to stratum. Positions come from sums over hash slices, so no
    stratum has to fit into one task. Null groups are dropped; null strata form one.
    """
    per = members.where(F.col(group).isNotNull()).groupBy(F.col(group).alias("g"), F.col(stratum).cast("string").alias("s")).agg(F.count(F.lit(1)).alias("k"))
    g = per.groupBy("g").agg(F.sum("k").alias("k"), F.max(F.struct("k", F.coalesce("s", F.lit("")).alias("s"))).alias("m"))
    g = g.select("g", "k", F.floor(F.log2("k")).cast("int").alias("band"), F.col("m.s").alias("s"), F.xxhash64(F.lit(seed), "g").alias("h")).withColumn("slice", F.pmod(F.shiftright("h", 32), F.lit(slices)))
    sums = g.groupBy("band", "s", "slice").agg(F.sum("k").alias("part"))  # at most `slices` rows a stratum
    w = Window.partitionBy("band", "s")
    sums = sums.withColumn("before", F.sum("part").over(w.orderBy("slice")) - F.col("part")).withColumn("total", F.sum("part").over(w)).drop("part")
    g = g.join(sums, ["band", "s", "slice"])
    mid = F.sum("k").over(Window.partitionBy("band", "s", "slice").orderBy("h", "g")) - F.col("k") / 2
    # bands of a few groups cannot be cut in proportion; their starts spread evenly over [0, 1) instead
    shift = F.pmod(F.xxhash64(F.lit(seed), "s", "band"), F.lit(1000)) / 1000
    x = F.pmod((F.col("before") + mid) / F.col("total") + F.when(F.col("total") < F.col("k") * 10, shift).otherwise(0.0), F.lit(1.0))
    g = g.withColumn("x", x)
    side, edge = None, 0.0
    for name, share in shares[:-1]:
        edge += share
        side = F.when(F.col("x") < edge, name) if side is None else side.when(F.col("x") < edge, name)
    side = F.lit(shares[-1][0]) if side is None else side.otherwise(shares[-1][0])
    return g.select(F.col("g").alias(group), side.alias("side"))


#: The wanted shares of the TV split.
TV_SHARES = [("train", 0.7), ("validation", 0.1), ("test", 0.2)]


def tv_split(spark: SparkSession, d: str) -> DataFrame:
    """(dialogue_id, group_id, phase, side) for every TV dialogue."""
    g = Scratch(spark, "tvsplit").put(tv_groups(spark, d))
    return g.join(deal(g, "group_id", "phase", TV_SHARES), "group_id").select("dialogue_id", "group_id", "phase", "side")


def split_report(split: DataFrame) -> DataFrame:
    """Counts and shares of the sides, overall (phase null) and per phase."""
    n = split.groupBy("phase", "side").agg(F.count(F.lit(1)).alias("n"))
    n = n.unionByName(n.groupBy("side").agg(F.sum("n").alias("n")).withColumn("phase", F.lit(None).cast("int")))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("phase")), 6))
