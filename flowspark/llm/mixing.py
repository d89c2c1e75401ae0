"""Mixes of sources by target weights: iterative proportional fitting, then sampling by calibrated rates.

The token totals of all documents by (source, language, topic) are the cells of a table. Per mix, the cells are raked in
turn to the language, topic and source marginals: sources to their target shares, languages and topics to those of the
whole corpus. A cell may never exceed max_repeats times its tokens, and the source step comes last, so sources meet their
targets wherever their text suffices. A cell's rate is its fitted weight over its tokens: every document of it is taken
floor(rate) times, and once more with the remaining probability, by systematic sampling along the documents of a source from
the longest to the shortest, which keeps a source's tokens within about one document of the fitted total. A source at its
limit starts at 0, so that of every stretch the last and shortest document is taken and the limit is never passed.

A source whose repeats are exhausted gives all it may; the others keep their own targets, and the report shows the shares
that result.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.session import Scratch, small_broadcast
from flowspark.sources.tables import canonical_name, read

#: Folder of the public tokenizer files and the file used, both parameters; the split pattern of that vocabulary.
TOKENIZERS = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Characters encoded at once: longer texts are cut at blanks, which tokens rarely cross.
PIECE = 100_000
#: Raking rounds, the greatest factor by which raking may change a cell's share of its source, documents of a slice for running totals.
ROUNDS, TRIM, SLICE = 60, 5.0, 50_000


def _counts(folder: str, vocabulary: str):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import tiktoken

        with open(os.path.join(folder, vocabulary), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        enc = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

        def count(t: str | None) -> int:
            if not t:
                return 0
            n, i = 0, 0
            while i < len(t):
                j = len(t) if len(t) - i <= PIECE else max(t.rfind(" ", i + 1, i + PIECE), i + PIECE // 2)
                n += len(enc.encode_ordinary(t[i:j]))
                i = j
            return n

        for s in batches:
            yield s.map(count).astype(np.int64)

    return run


def token_counts(documents: DataFrame, folder: str = TOKENIZERS, vocabulary: str = VOCABULARY) -> DataFrame:
    """documents with tokens: the length of text in tokens of a public vocabulary; null and empty texts have 0."""
    return documents.withColumn("tokens", F.pandas_udf(_counts(folder, vocabulary), "long")("text"))


def rake(tokens: np.ndarray, cap: np.ndarray, source: np.ndarray, want: np.ndarray, others: list[tuple[np.ndarray, np.ndarray]], rounds: int = ROUNDS) -> np.ndarray:
    """Cell weights w <= cap with source sums want (or the sum of the caps, if less), as near to the other marginals as that allows.

    source and the codes in others number the categories of the cells; others are (codes, wanted shares).
    """
    n = len(want)
    want = np.minimum(want, np.bincount(source, cap, n))
    sums = np.bincount(source, tokens, n)
    w = np.minimum(tokens * np.where(sums > 0, want / np.where(sums > 0, sums, 1), 0)[source], cap)

    def to_sources(w: np.ndarray) -> np.ndarray:
        for _ in range(40):  # what the caps cut off goes to the cells of the source that still have room
            lack = want - np.bincount(source, w, n)
            if (lack <= 1e-9 * np.maximum(want, 1)).all():
                break
            open_ = np.where(w < cap, w, 0)
            have = np.bincount(source, open_, n)
            room = np.where(w < cap, cap - w, 0)
            spare = np.bincount(source, room, n)
            add = np.where(have[source] > 0, open_ * (lack / np.where(have > 0, have, 1))[source], room * (lack / np.where(spare > 0, spare, 1))[source])
            w = np.minimum(w + np.maximum(add, 0), cap)
        over = np.bincount(source, w, n)
        return w * np.where(over > want, want / np.where(over > 0, over, 1), 1)[source]

    total = want.sum()
    low, high = w / TRIM, np.minimum(w * TRIM, cap)  # marginals that cannot be met must not empty or flood a cell
    for _ in range(rounds):
        old = w
        for code, share in others:
            have = np.bincount(code, w, len(share))
            w = np.minimum(w * np.where(have > 0, share * total / np.where(have > 0, have, 1), 1)[code], cap)
        w = np.clip(w, low, high)
        over = np.bincount(source, w, n)
        w = to_sources(np.minimum(w * np.where(over > 0, want / np.where(over > 0, over, 1), 1)[source], cap))
        if np.abs(w - old).max(initial=0) <= 1e-6 * max(total, 1) / max(len(w), 1):
            break
    return w


def _fit(b: pd.DataFrame) -> pd.DataFrame:
    """The rate of every cell of one mix."""
    tokens = b["tokens"].to_numpy(np.float64)
    source, names = pd.factorize(b["source"])
    first = b.groupby("source", sort=False)[["share", "max_repeats", "wanted"]].first().reindex(names)
    want = (first["share"] * first["wanted"]).to_numpy(np.float64)
    cap = tokens * np.maximum(first["max_repeats"].to_numpy(np.float64), 0)[source]
    others = []
    for c in ("lang", "topic"):
        code, _ = pd.factorize(b[c])
        own = pd.Series(b[f"{c}_share"].to_numpy(np.float64)).groupby(code).first().to_numpy()
        others.append((code, own / own.sum() if own.sum() > 0 else own))
    w = rake(tokens, cap, source, want, others)
    return pd.DataFrame({"mix_name": b["mix_name"], "source": b["source"], "lang": b["lang"], "topic": b["topic"], "rate": np.where(tokens > 0, w / np.where(tokens > 0, tokens, 1), 0.0), "full": (want >= np.bincount(source, cap, len(want)) * (1 - 1e-9))[source]})


def targets(mix_targets: DataFrame) -> DataFrame:
    """One row per mix and source (spellings taken together): shares added up, the smallest repeats, the size of the mix."""
    t = mix_targets.where("mix_name is not null and source is not null").withColumn("source", canonical_name("source"))
    size = t.groupBy("mix_name").agg(F.max("size_factor").alias("size_factor"))
    t = t.groupBy("mix_name", "source").agg(F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.min("max_repeats").alias("max_repeats"))
    return t.join(size, "mix_name").withColumn("max_repeats", F.coalesce("max_repeats", F.lit(1.0))).withColumn("size_factor", F.coalesce("size_factor", F.lit(1.0)))


def prepared(documents: DataFrame) -> DataFrame:
    """(doc_id, source, lang, topic, tokens) with one spelling each; missing values are 'unknown'."""
    name = lambda c: F.when(canonical_name(c) == "", None).otherwise(canonical_name(c))
    d = token_counts(documents.where("doc_id is not null").select("doc_id", "text", "source", "lang", "task"))
    return d.select("doc_id", *[F.coalesce(name(c), F.lit("unknown")).alias(a) for c, a in (("source", "source"), ("lang", "lang"), ("task", "topic"))], "tokens")


def draw(docs: DataFrame, mix_targets: DataFrame, seed: int = 5) -> DataFrame:
    """(mix_name, doc_id, source, tokens, copies) of the documents taken at least once.

    docs: as from prepared(), stored (it is read several times). Sources without a target row are in no mix; targets
    without documents draw nothing. Documents of no tokens are never taken. Empty tables give an empty result.
    """
    spark = docs.sparkSession
    docs = docs.where("tokens > 0")
    cells = docs.groupBy("source", "lang", "topic").agg(F.sum("tokens").alias("tokens"))
    everything = Window.partitionBy(F.lit(1))
    cells = cells.withColumn("total", F.sum("tokens").over(everything))
    for c in ("lang", "topic"):
        cells = cells.withColumn(f"{c}_share", F.sum("tokens").over(Window.partitionBy(c)) / F.col("total"))
    t = targets(mix_targets)
    fit = cells.join(t, "source").withColumn("wanted", F.col("size_factor") * F.col("total"))
    tmp = Scratch(spark, "mix")
    rates = tmp.put(fit.groupBy("mix_name").applyInPandas(_fit, "mix_name string, source string, lang string, topic string, rate double, full boolean").where("rate > 0"))
    x = docs.join(small_broadcast(rates), ["source", "lang", "topic"]).join(small_broadcast(t.select("mix_name", "source", "max_repeats")), ["mix_name", "source"])
    whole = F.floor(F.col("rate") + 1e-6)  # a rate at its limit is a whole number but for rounding
    # a fractional maximum of repeats holds for the source as a whole; a document is taken a whole number of times
    x = x.select("mix_name", "source", "doc_id", "tokens", whole.alias("whole"), F.greatest(F.col("rate") - whole, F.lit(0.0)).alias("p"), "full", F.xxhash64(F.lit(seed), "mix_name", "doc_id").alias("h"))
    # documents of one length are a slice, or several if they are many: no running total is taken over more in one task
    many = small_broadcast(tmp.put(x.groupBy("mix_name", "source", "tokens").agg(F.floor(F.count(F.lit(1)) / SLICE + 1).alias("cuts"))))
    x = x.join(many, ["mix_name", "source", "tokens"]).withColumn("slice", F.struct((-F.col("tokens")).alias("t"), F.pmod("h", "cuts").alias("k"))).drop("cuts")
    sums = x.groupBy("mix_name", "source", "slice").agg(F.sum("p").alias("part"))
    sums = sums.select("mix_name", "source", "slice", (F.sum("part").over(Window.partitionBy("mix_name", "source").orderBy("slice")) - F.col("part")).alias("before"))
    start = F.when(F.col("full"), 0.0).otherwise(F.pmod(F.xxhash64(F.lit(seed), "mix_name", "source"), F.lit(9973)) / 9973)
    x = x.join(sums, ["mix_name", "source", "slice"])
    upto = F.col("before") + start + F.sum("p").over(Window.partitionBy("mix_name", "source", "slice").orderBy("h", "doc_id"))
    x = x.withColumn("upto", upto)
    x = x.withColumn("copies", (F.col("whole") + F.floor(F.col("upto")) - F.floor(F.col("upto") - F.col("p"))).cast("long"))
    return x.where("copies > 0").select("mix_name", "doc_id", "source", "tokens", "copies")


def mix(spark: SparkSession, d: str) -> DataFrame:
    docs = Scratch(spark, "tokens").put(prepared(read(spark, d, "documents")))
    return draw(docs, read(spark, d, "mix_targets"))


def mix_report(spark: SparkSession, d: str) -> DataFrame:
    """Per mix and source: target and actual share, tokens available, wanted and drawn, and repeats."""
    docs = Scratch(spark, "tokens").put(prepared(read(spark, d, "documents")))
    got = draw(docs, read(spark, d, "mix_targets")).groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies"), F.count(F.lit(1)).alias("n_documents"))
    have = docs.groupBy("source").agg(F.sum("tokens").alias("available_tokens"))
    total = docs.agg(F.sum("tokens").alias("total"))
    r = targets(read(spark, d, "mix_targets")).crossJoin(F.broadcast(total)).join(have, "source", "left").join(got, ["mix_name", "source"], "left")
    r = r.select("mix_name", "source", F.col("share").alias("target_share"), "max_repeats", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"), (F.col("share") * F.col("size_factor") * F.coalesce("total", F.lit(0))).alias("target_tokens"), F.coalesce("drawn_tokens", F.lit(0)).alias("drawn_tokens"), F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"))
    w = Window.partitionBy("mix_name")
    return r.select("*", F.round(F.col("drawn_tokens") / F.sum("drawn_tokens").over(w), 6).alias("actual_share"), F.round(F.try_divide("drawn_tokens", "available_tokens"), 6).alias("repeats"), (F.col("target_tokens") > F.col("max_repeats") * F.col("available_tokens")).alias("exhausted"))
