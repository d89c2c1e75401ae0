"""Repeated consecutive events in sequences, found by regular expression over symbol strings.

Events are canonicalised to symbols (Unicode code points), concatenated in order into one string per entity, and a
backreference expression cuts the string where the symbol changes; pieces of at least two equal symbols are the runs.
Events without a meaning of their own take a symbol that matches nothing, so they end runs but form none.

Strings are built per stretch of an entity (`stretch` ordinals), so no entity has to fit into one task; the pieces at the
ends of stretches are joined by gaps and islands over two rows a stretch. Everything runs in the JVM.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.llm.tables import turns
from flowspark.session import Scratch, small_broadcast
from flowspark.sources.tables import actor_side, read, squashed

#: Symbols are code points from here on, all in one plane; NOTHING is the symbol of meaningless events.
FIRST_SYMBOL, LAST_SYMBOL, NOTHING = 0x4E00, 0xD7FF, "\u0001"
#: Labels that mean nothing, squashed.
EMPTY_LABELS = ["", "unknown"]


def one_slip(a, b):
    """Whether two strings differ by at most one insertion, deletion, replacement or swap of neighbours."""
    n = F.least(F.length(a), F.length(b))
    same = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda k, i: F.when((k == i - 1) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), i).otherwise(k))
    cut = lambda x, at, ln: F.substring(x, at, ln)
    swapped = F.concat(cut(b, F.lit(1), same), cut(b, same + 2, F.lit(1)), cut(b, same + 1, F.lit(1)), cut(b, same + 3, F.length(b)))
    return (F.levenshtein(a, b) <= 1) | ((F.length(a) == F.length(b)) & (swapped == a))


def canonical_labels(raw: DataFrame, valid: DataFrame) -> DataFrame:
    """(raw, label): for each spelling in raw (column raw) the valid label (column label) it is a spelling of.

    Case, separators and punctuation do not count; one slip is forgiven (exact spellings first, then the smallest label).
    Candidates come from an equality join on strings with one character deleted, not from all pairs. Null, empty and
    unknown spellings, and those of no valid label, have no row.
    """
    near = lambda c: F.array_distinct(F.concat(F.array(c), F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))))
    r = raw.select("raw", squashed("raw").alias("q")).where(F.col("q").isNotNull() & ~F.col("q").isin(EMPTY_LABELS)).distinct()
    v = valid.select("label", squashed("label").alias("p")).where("p is not null and p <> ''").distinct()
    hit = r.select("raw", "q", F.explode(near(F.col("q"))).alias("k")).join(small_broadcast(v.select("label", "p", F.explode(near(F.col("p"))).alias("k"))), "k")
    hit = hit.where(one_slip(F.col("q"), F.col("p")))
    return hit.groupBy("raw").agg(F.min(F.struct((F.col("p") != F.col("q")).alias("o"), "label")).alias("m")).select("raw", "m.label")


def symbols(vocabulary: DataFrame) -> DataFrame:
    """vocabulary (distinct rows, no nulls) with sym: one code point each, in the order of its columns.

    A vocabulary is a list of labels; more rows than code points are an error rather than a collision.
    """
    n = vocabulary.withColumn("_n", F.row_number().over(Window.orderBy(*vocabulary.columns)))
    bad = F.raise_error(F.lit("more kinds of events than symbols"))
    return n.withColumn("sym", F.when(F.col("_n") <= LAST_SYMBOL - FIRST_SYMBOL, F.decode(F.unhex(F.lpad(F.hex(F.col("_n") + (FIRST_SYMBOL - 1)), 4, "0")), "UTF-16BE")).otherwise(bad.cast("string"))).drop("_n")


def collapse_runs(events: DataFrame, entity: str, ordinal: str, at: str | None = None, stretch: int = 4096) -> DataFrame:
    """Longest runs of at least two consecutive events with equal symbols.

    events: (entity, ordinal, sym[, at timestamp]); other columns are ignored. Result: (entity, first, last, sym, n,
    duration_s). Consecutive means no other existing ordinal lies between; repeated ordinals count once (smallest symbol);
    null entities and ordinals are dropped. duration_s is the time between the earliest and the latest known `at` of the
    run, null if none is known. Empty input gives an empty result.
    """
    when = F.col(at).cast("timestamp") if at else F.lit(None).cast("timestamp")
    e = events.where(F.col(entity).isNotNull() & F.col(ordinal).isNotNull())
    e = e.select(F.col(entity).alias("e"), F.col(ordinal).cast("long").alias("o"), F.col("sym").alias("s"), when.alias("t")).withColumn("part", F.floor(F.col("o") / stretch))
    rows = e.groupBy("e", "part").agg(F.sort_array(F.collect_list(F.struct("o", "s", "t"))).alias("x"))
    rows = rows.withColumn("x", F.filter("x", lambda x, i: (i == 0) | (x["o"] != F.element_at("x", F.greatest(i, F.lit(1)).cast("int"))["o"])))
    rows = rows.withColumn("z", F.array_join(F.transform("x", lambda x: x["s"]), ""))
    cut = F.split("z", r"(?<=(.))(?!\1)")
    rows = rows.withColumn("runs", F.filter(cut, lambda r: r != ""))
    ends = F.aggregate("runs", F.array().cast("array<int>"), lambda acc, r: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + F.length(r))))
    rows = rows.select("e", "part", "x", "runs", F.when(F.size("runs") > 0, ends).alias("ends"))
    k = rows.select("e", "part", "x", F.size("runs").alias("m"), F.posexplode(F.arrays_zip("runs", "ends")).alias("i", "r"))
    n = F.length("r.runs")
    seg = F.slice("x", F.col("r.ends") - n + 1, n)
    runs = k.where((F.col("i") == 0) | (F.col("i") == F.col("m") - 1) | ((n > 1) & (F.substring("r.runs", 1, 1) != NOTHING))).select(
        "e", "part", (F.col("i") == 0).alias("head"), (F.col("i") == F.col("m") - 1).alias("tail"), F.substring("r.runs", 1, 1).alias("sym"), n.cast("long").alias("n"),
        F.element_at(seg, 1)["o"].alias("first"), F.element_at(seg, -1)["o"].alias("last"),
        F.array_min(F.transform(seg, lambda x: x["t"])).alias("t0"), F.array_max(F.transform(seg, lambda x: x["t"])).alias("t1"),
    )
    # pieces that touch an end of their stretch, two of thousands of events, continue the piece before them if the symbols agree
    inside = runs.where("not head and not tail").select("e", "first", "last", "sym", "n", "t0", "t1")
    runs = runs.where("head or tail")
    w = Window.partitionBy("e").orderBy("first")
    joins = F.col("head") & F.lag("tail").over(w) & (F.lag("sym").over(w) == F.col("sym")) & (F.col("sym") != NOTHING)
    runs = runs.withColumn("new", F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).withColumn("island", F.sum("new").over(w))
    done = runs.groupBy("e", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.first("sym").alias("sym"), F.sum("n").alias("n"), F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    done = done.drop("island").unionByName(inside).where((F.col("n") > 1) & (F.col("sym") != NOTHING))
    return done.select(F.col("e").alias(entity), "first", "last", "sym", "n", (F.col("t1").cast("double") - F.col("t0").cast("double")).alias("duration_s"))


def repeated_turns(spark: SparkSession, d: str) -> DataFrame:
    """Runs of turns of one conversation with the same actor side and intent: (dialogue_id, first_turn, last_turn, actor, label, n_turns, duration_s)."""
    tmp = Scratch(spark, "runs")
    t = turns(spark, d, "actor", "label", "spoken_at").select("dialogue_id", "turn", actor_side("actor").alias("side"), F.col("label").alias("raw"), "spoken_at")
    valid = read(spark, d, "taxonomy").select("label")
    known = canonical_labels(read(spark, d, "utterances").select(F.col("label").alias("raw")).distinct(), valid)
    sides = spark.createDataFrame([("user",), ("agent",)], "side string")
    code = tmp.put(known.crossJoin(F.broadcast(sides)).join(symbols(known.select("label").distinct().crossJoin(sides)), ["label", "side"]))
    t = t.join(small_broadcast(code.select("raw", "side", "sym")), ["raw", "side"], "left").withColumn("sym", F.coalesce("sym", F.lit(NOTHING)))
    r = collapse_runs(t, "dialogue_id", "turn", "spoken_at")
    names = small_broadcast(code.select("sym", F.col("side").alias("actor"), "label").distinct())
    return r.join(names, "sym").select("dialogue_id", F.col("first").cast("int").alias("first_turn"), F.col("last").cast("int").alias("last_turn"), "actor", "label", F.col("n").alias("n_turns"), F.round("duration_s", 6).alias("duration_s"))
