"""Column functions on texts and turn arrays: rendering, windows, chunks, sampling, estimates, diagram text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cue patterns by name, matched against lower-case text.
CUES = {
    "rating": r"\bsuds\b|distress level|0 to 100|scale of|rate (your|the)",
    "present_tense": r"close your eyes|present tense|as if it.?s happening|bring yourself back",
    "grounding": r"feel your feet|look around|name .{0,12}things|grounding|five senses|present moment",
    "breathing": r"\bbreath|inhale|exhale",
    "narrative": r"what happens next|keep going|go on|continue (with|the)",
    "beliefs": r"what (were|was) you thinking|going through your mind|what does that (say|mean)|belief",
    "wrap_up": r"next session|wrap up|for today|end (of|our) (the )?session|see you",
}


def word_count(text: Column) -> Column:
    """Number of blank-separated words; 0 for null and blank texts."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def token_estimate(texts: Column) -> Column:
    """Total characters of an array of texts over four, rounded down."""
    return F.floor(F.aggregate(texts, F.lit(0).cast("long"), lambda n, t: n + F.coalesce(F.length(t), F.lit(0))) / 4)


def render_dialogue(turns: Column) -> Column:
    """Lines '  [i] (actor) text' of an array of (actor, text), i from 0."""
    return F.array_join(F.transform(turns, lambda u, i: F.concat(F.lit("  ["), i.cast("string"), F.lit("] ("), u["actor"], F.lit(") "), F.coalesce(u["text"], F.lit("")))), "\n")


def render_transcript(turns: Column, limit: int = 1500) -> Column:
    """Therapist/Client lines cut at limit characters with a marker."""
    name = lambda u: F.when(u["actor"] == "agent", "Therapist: ").otherwise("Client: ")
    t = F.array_join(F.transform(turns, lambda u: F.concat(name(u), F.coalesce(u["text"], F.lit("")))), "\n")
    return F.when(F.length(t) > limit, F.concat(F.substring(t, 1, limit), F.lit("\n[truncated]"))).otherwise(t)


def fill_slots(template: Column, slots: dict[str, Column]) -> Column:
    """template with every {{name}} replaced; a name left unfilled is an error for that row."""
    for name, value in slots.items():
        template = F.replace(template, F.lit("{{" + name + "}}"), value)
    return F.when(F.contains(template, F.lit("{{")), F.raise_error(F.concat(F.lit("unfilled slot in: "), F.substring(template, 1, 80))).cast("string")).otherwise(template)


def context_window(turns: Column, at: Column, width: int) -> Column:
    """width turns around index `at` (from 0), shifted at the ends so that the window stays full."""
    n = F.size(turns)
    start = F.greatest(F.lit(0), at - width // 2)
    end = F.least(n, start + width)
    start = F.greatest(F.lit(0), end - width)
    return F.slice(turns, start + 1, end - start)


def chunk_starts(n: Column, size: int, stride: int) -> Column:
    """Starts of chunks of `size` turns every `stride`, the last one moved so that it covers the end; [0] if one chunk holds all."""
    regular = F.sequence(F.lit(0), n - size, F.lit(stride))
    return F.when(n <= 0, F.array().cast("array<int>")).when(n <= size, F.array(F.lit(0))).otherwise(F.array_sort(F.array_union(regular, F.array(n - size)))).cast("array<int>")


def even_sample(df: DataFrame, group: str, order: str, text: str, limit: int, least: int = 50, extra: int = 8) -> DataFrame:
    """Rows of each group kept so that about `limit` characters remain, evenly spaced; at least `least` rows.

    A text costs its length plus `extra`. Groups within the limit stay whole. Order ties are broken by the text.
    """
    n = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length(text) + extra).alias("_t"))
    keep = F.when(F.col("_t") <= limit, F.col("_n")).otherwise(F.least(F.col("_n"), F.greatest(F.lit(least).cast("long"), F.floor(F.col("_n") * limit / F.col("_t")))))
    n = n.select(group, "_n", keep.alias("_k"))
    x = df.withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(order, text)) - 1).join(n, group)
    # index i is kept if some j gives floor(j * n / k) = i
    j = F.ceil(F.col("_i") * F.col("_k") / F.col("_n"))
    return x.where((F.floor(j * F.col("_n") / F.col("_k")) == F.col("_i")) & (j < F.col("_k"))).drop("_i", "_n", "_k")


def fenced_diagram(text: Column) -> Column:
    """The last fenced block that mentions graph or flowchart, else the last fence, else from the keyword on, else ''."""
    fences = F.regexp_extract_all(text, F.lit(r"(?s)```[a-zA-Z]*\s*\n(.*?)```"), F.lit(1))
    named = F.filter(fences, lambda f: f.rlike(r"(?i)\b(graph|flowchart)\b"))
    bare = F.regexp_extract(text, r"(?is)((?:graph|flowchart)\s.*)$", 1)
    return F.regexp_replace(F.when(F.size(named) > 0, F.try_element_at(named, F.lit(-1))).when(F.size(fences) > 0, F.try_element_at(fences, F.lit(-1))).otherwise(bare), r"^\s+|\s+$", "")


def actor_of_node(node: Column) -> Column:
    """agent or user from a node id: B... or U... at the head, else the first B or U before a digit, else unknown."""
    head = F.upper(F.substring(node, 1, 1))
    inner = F.upper(F.regexp_extract(node, r"([BbUu])\d", 1))
    pick = F.when(head.isin("B", "U"), head).otherwise(inner)
    return F.when(pick == "B", "agent").when(pick == "U", "user").otherwise("unknown")
