"""Documents that contain held-out passages, in full, in part or slightly reworded.

Pigeonhole edit matching over words. A passage counts as leaked if a document holds `EXACT` consecutive words of it, or a
window of `SPAN` words with at most `ERRORS` edits. A window of SPAN words cut into ERRORS + 1 pieces has at least one
piece without an edit, so every leak holds one of the items' pieces exactly; any five consecutive words of an item are a
piece here, which covers the pieces of windows at every offset. Documents are scanned once for exact piece hits, a batch at
a time. Hits are screened by how many words can agree near their diagonal, and windows that pass are verified with Myers'
bit-parallel distance (words as symbols, the window as pattern, its start and end in the document free).

Up to `ITEMS` items travel with the tasks, and nothing is shuffled but the results. More items are a table of pieces: documents
are read once as well, their pieces that pass a filter of the items' pieces are joined with it, and hits meet their texts again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.tables import Hashed
from flowspark.session import Scratch, small_broadcast
from flowspark.sources.tables import canonical_name, read

#: Consecutive words that count as a leak; words and edits of a reworded window; words of a piece.
EXACT, SPAN, ERRORS = 15, 30, 5
PIECE = SPAN // (ERRORS + 1)
#: Items that travel with the tasks at most, bits of the filter of their pieces, documents handled at once.
ITEMS, FILTER, BATCH = 5000, 22, 1000
#: Hits screened at once.
SCREEN = 4096

_WORD = re.compile(r"[^\W_]+")
_QUOTES = re.compile("['\u2018\u2019\u201b`\u00b4\u02bc\"\u201c\u201d\u201e\u00ab\u00bb\u00ad\u200b-\u200d\u2060\ufeff]+")


def words(text: str | None) -> list[str]:
    """Lower-case words; quote marks and invisible characters vanish, character entities are resolved, other signs separate."""
    if not text:
        return []
    if "&" in text:
        text = unescape(unescape(text))
    return _WORD.findall(_QUOTES.sub("", text.lower()))


class Texts:
    """Texts as one array of word hashes with the start of each."""

    def __init__(self, texts: list[list[str]], known: dict[str, int]):
        n = np.array([len(x) for x in texts], np.int64)
        self.start, self.n = np.cumsum(n) - n, n
        self.w = np.fromiter((known[y] for x in texts for y in x), np.uint64, int(n.sum()))

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes of all pieces that lie in one text."""
        last = np.repeat(self.start + self.n, self.n)
        at = np.flatnonzero(np.arange(len(self.w)) + PIECE <= last)
        return at, pieces(self.w)[at]

    def of(self, at: np.ndarray) -> np.ndarray:
        """The text each place is in."""
        return np.searchsorted(self.start + self.n, at, side="right")


class Items(Texts):
    """Items with the sorted hashes of their pieces and the places these stand at."""

    def __init__(self, texts: list[list[str]], known: dict[str, int]):
        super().__init__(texts, known)
        at, h = self.pieces()
        order = np.argsort(h, kind="stable")
        self.hash, self.at = h[order], at[order]
        self.filter = _filter(self.hash)

    def hits(self, docs: Texts) -> tuple[np.ndarray, np.ndarray]:
        """Places of equal pieces (in the items, in the documents)."""
        pos, h = docs.pieces()
        may = self.filter[_slot(h)]
        pos, h = pos[may], h[may]
        lo, hi = np.searchsorted(self.hash, h, "left"), np.searchsorted(self.hash, h, "right")
        n = hi - lo
        k = np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return self.at[k], np.repeat(pos, n)


def _slot(h: np.ndarray) -> np.ndarray:
    return (h.view(np.uint64) >> np.uint64(64 - FILTER)).astype(np.int64)


def _filter(h: np.ndarray) -> np.ndarray:
    out = np.zeros(1 << FILTER, bool)
    out[_slot(h)] = True
    return out


def judged(items: Texts, docs: Texts, at: np.ndarray, pos: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(document, item, words of the longest exact run, words of the best reworded window that agree) by number in docs and items.

    at, pos: places of equal pieces. A window is looked for only where no exact run is long enough.
    """
    if not len(at):
        return []
    item, doc = items.of(at), docs.of(pos)
    # hits on one diagonal of an item and a document that follow each other are one exact run
    order = np.lexsort((at, pos - at, item, doc))
    item, doc, at, pos = item[order], doc[order], at[order], pos[order]
    new = np.r_[True, (np.diff(item) != 0) | (np.diff(doc) != 0) | (np.diff(pos - at) != 0) | (np.diff(at) != 1)]
    start = np.flatnonzero(new)
    length = np.diff(np.r_[start, len(new)]) + PIECE - 1
    item, doc, at, pos = item[start], doc[start], at[start], pos[start]
    out: dict[tuple[int, int], list[int]] = {}
    long = length >= EXACT
    for k, i, m in zip(doc[long].tolist(), item[long].tolist(), length[long].tolist()):
        r = out.setdefault((k, i), [0, 0])
        r[0] = max(r[0], m)
    both = doc * len(items.n) + item
    rest = np.flatnonzero(~np.isin(both, np.unique(both[long])) & (items.n[item] >= SPAN))
    tried: set[tuple[int, int, int, int]] = set()
    for s in range(0, len(rest), SCREEN):
        r = rest[s : s + SCREEN]
        for row, o in zip(*_windows(items, docs, item[r], doc[r], at[r], pos[r])):
            i, k = int(item[r[row]]), int(doc[r[row]])
            begin = int(at[r[row]]) + int(o)
            base = int(pos[r[row]]) + int(o)
            if (k, i, begin, base) in tried:
                continue
            tried.add((k, i, begin, base))
            left, right = int(docs.start[k]), int(docs.start[k] + docs.n[k])
            edits = myers(items.w[begin : begin + SPAN].tolist(), docs.w[max(left, base - ERRORS) : min(right, base + SPAN + ERRORS)].tolist())
            if edits <= ERRORS:
                x = out.setdefault((k, i), [0, 0])
                x[1] = max(x[1], SPAN - edits)
    return [(k, i, a, b) for (k, i), (a, b) in sorted(out.items())]


def _windows(items: Texts, docs: Texts, item: np.ndarray, doc: np.ndarray, at: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hit, offset) of the windows around hits in which enough words can agree: they find themselves within ERRORS of the diagonal."""
    reach = SPAN - PIECE
    off = np.arange(-reach, SPAN)
    q, lo, hi = at[:, None] + off, items.start[item][:, None], (items.start + items.n)[item][:, None]
    inside = (q >= lo) & (q < hi)
    word = items.w[np.clip(q, 0, len(items.w) - 1)]
    left, right = docs.start[doc][:, None], (docs.start + docs.n)[doc][:, None]
    hit = np.zeros(word.shape, bool)
    for e in range(-ERRORS, ERRORS + 1):
        p = pos[:, None] + off + e
        hit |= (word == docs.w[np.clip(p, 0, len(docs.w) - 1)]) & (p >= left) & (p < right)
    total = np.cumsum(np.c_[np.zeros(len(hit), np.int64), hit & inside], 1)
    span = total[:, SPAN:] - total[:, :-SPAN]
    row, o = np.nonzero(span >= SPAN - ERRORS)
    o = o - reach
    whole = (at[row] + o >= lo[row, 0]) & (at[row] + o + SPAN <= hi[row, 0])
    return row[whole], o[whole]


def pieces(x: np.ndarray) -> np.ndarray:
    """Hashes of the pieces at every place of an array of word hashes; the last ones run over its end."""
    with np.errstate(over="ignore"):
        h = np.zeros(len(x), np.uint64)
        for i in range(PIECE):
            h = (h ^ np.r_[x[i:], np.zeros(min(i, len(x)), np.uint64)]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
    return h.view(np.int64)


def myers(pattern: list[int], text: list[int]) -> int:
    """Least edit distance of pattern to any stretch of text, by bit vectors (Myers 1999)."""
    m = len(pattern)
    peq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | (1 << i)
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best = m
    for c in text:
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        best = min(best, score)
        ph, mh = (ph << 1) & full, (mh << 1) & full
        pv, mv = mh | ~(xv | ph) & full, ph & xv
    return best


def _item_words(text: str, lines: list[list[str]]) -> list[str]:
    x = words(text)
    for line in lines:
        if x[: len(line)] == line:
            return x[len(line) :]
    return x


def _scan(given: list[tuple[int, str]], lines: list[list[str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashed()
        items, ids = Items([_item_words(t, lines) for _, t in given], known), [i for i, _ in given]
        for b in batches:
            for s in range(0, len(b), BATCH):
                part = b.iloc[s : s + BATCH]
                docs = Texts([words(t) for t in part["text"]], known)
                number = part["doc_id"].to_numpy()
                rows = [(number[k], ids[i], a, g) for k, i, a, g in judged(items, docs, *items.hits(docs))]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run", "agree"])

    return run


def _pieces(lines: list[list[str]] | None, wanted: np.ndarray | None):
    """(id, hash, at) of the pieces of texts; of documents (no lines) only those that pass the filter."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashed()
        keep = None if wanted is None else np.unpackbits(wanted).view(bool)
        for b in batches:
            for s in range(0, len(b), BATCH):
                part = b.iloc[s : s + BATCH]
                x = Texts([words(t) if lines is None else _item_words(t, lines) for t in part["text"]], known)
                at, h = x.pieces()
                if keep is not None:
                    ok = keep[_slot(h)]
                    at, h = at[ok], h[ok]
                of = x.of(at)
                yield pd.DataFrame({"id": part["id"].to_numpy()[of], "key": part["key"].to_numpy()[of], "hash": h, "at": (at - x.start[of]).astype(np.int32)})

    return run


def _judge(lines: list[list[str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashed()
        for b in batches:
            for s in range(0, len(b), BATCH):
                part = b.iloc[s : s + BATCH]
                docs, items = Texts([words(t) for t in part["text"]], known), Texts([_item_words(t, lines) for t in part["item"]], known)
                n = [len(x) for x in part["at"]]
                row = np.repeat(np.arange(len(part)), n)
                at, pos = (np.concatenate(part[c].tolist()).astype(np.int64) + x.start[row] for c, x in (("at", items), ("pos", docs)))
                doc, item = part["doc_id"].to_numpy(), part["item_id"].to_numpy()
                rows = [(doc[k], item[k], a, g) for k, _, a, g in judged(items, docs, at, pos)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "run", "agree"])

    return run


RESULT = "doc_id long, item_id long, run int, agree int"


def leaks(spark: SparkSession, documents: DataFrame, items: DataFrame, most: int = ITEMS) -> DataFrame:
    """(doc_id, item_id, run, agree): every document and item of which it holds a passage.

    documents: (doc_id long, text), items: (item_id long, text); other columns are ignored. run is the longest exact run in
    words (0 if only a reworded window was found), agree the words that agree in the best window (0 if run is given). Null
    and empty texts, items shorter than a piece and rows without an id match nothing; items given twice count once, an item id
    or a document id given with several texts is judged by all of them. Empty input gives an empty table. Standing lines, with
    which different items open, are no item text. Beyond `most` items the pieces are joined as tables.
    """
    docs = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    given = items.where("item_id is not null and text is not null").select("item_id", "text").distinct()
    lines = _lines(given)
    first = given.orderBy("item_id", "text").limit(most + 1).collect()
    if len(first) <= most:
        out = docs.mapInPandas(_scan([tuple(r) for r in first], lines), RESULT)
    else:
        out = _joined(spark, docs, given, lines)
    return out.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"), F.max("agree").alias("agree"))


def _joined(spark: SparkSession, docs: DataFrame, given: DataFrame, lines: list[list[str]]) -> DataFrame:
    tmp = Scratch(spark, "leaks")
    schema = "id long, key long, hash long, at int"
    given = given.select("item_id", "text", F.xxhash64("text").alias("item_key"))
    mine = tmp.put(given.select(F.col("item_id").alias("id"), F.col("item_key").alias("key"), "text").mapInPandas(_pieces(lines, None), schema))
    # the filter has a fixed size, however many items there are
    slots = mine.select(F.expr(f"shiftrightunsigned(hash, {64 - FILTER})").alias("slot")).distinct().groupBy(F.expr("slot div 8").alias("byte")).agg(F.bit_or(F.expr("shiftleft(1, cast(7 - slot % 8 as int))")).alias("bits"))
    wanted = np.zeros((1 << FILTER) // 8, np.uint8)
    for byte, bits in slots.toLocalIterator():
        wanted[byte] = bits
    shared = docs.select("doc_id", "text", F.xxhash64("text").alias("doc_key"))
    theirs = shared.select(F.col("doc_id").alias("id"), F.col("doc_key").alias("key"), "text").mapInPandas(_pieces(None, wanted), schema)
    pair = ["doc_id", "doc_key", "item_id", "item_key"]
    hits = theirs.select(F.col("id").alias("doc_id"), F.col("key").alias("doc_key"), "hash", F.col("at").alias("pos")).join(mine.select(F.col("id").alias("item_id"), F.col("key").alias("item_key"), "hash", "at"), "hash")
    hits = tmp.put(hits.groupBy(pair).agg(F.collect_list(F.struct("at", "pos")).alias("x")).select(*pair, "x.at", "x.pos"))
    met = hits.join(shared.distinct(), ["doc_id", "doc_key"]).join(given.withColumnRenamed("text", "item"), ["item_id", "item_key"])
    return met.select("doc_id", "item_id", "text", "item", "at", "pos").mapInPandas(_judge(lines), RESULT)


def _lines(items: DataFrame) -> list[list[str]]:
    """Standing lines: opening sentences of two or more items that go on differently. Only repeated sentences come back.

    Items with the same opening that are near copies of each other have most of their further word pairs in common; of each
    opening, the items with the smallest and the largest hash are compared.
    """
    first = items.select(F.trim("text").alias("t")).withColumn("f", F.regexp_extract("t", r"^(.*?[.:!?])(\s|$)|^([^\n]*)", 0)).where("f <> ''")
    rest = F.split(F.lower(F.expr("substring(t, length(f) + 1)")), r"[^\p{L}\p{N}]+")
    two = F.array_distinct(F.zip_with("w", F.slice("w", 2, 1 << 30), lambda x, y: F.concat_ws(" ", x, y)))
    seen = first.select("f", "t", rest.alias("w")).select("f", F.struct(F.xxhash64("t").alias("h"), two.alias("w")).alias("r")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), F.min("r").alias("a"), F.max("r").alias("b"))
    common = F.size(F.array_intersect("a.w", "b.w")) / F.least(F.size("a.w"), F.size("b.w"))
    seen = seen.where((F.col("n") > 1) & (common < 0.5))
    return sorted((list(x) for x in {tuple(words(r[0])) for r in seen.select("f").toLocalIterator()} if x), key=len, reverse=True)


def leak_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items and documents concerned by source (spellings taken together) and side of the item."""
    found = Scratch(spark, "leaks").put(leaks(spark, read(spark, d, "documents"), read(spark, d, "eval_items")))
    docs = read(spark, d, "documents").select("doc_id", F.coalesce(canonical_name("source"), F.lit("unknown")).alias("source"))
    items = small_broadcast(read(spark, d, "eval_items").select("item_id", "side"))
    x = found.join(docs, "doc_id").join(items, "item_id")
    return x.groupBy("source", "side").agg(F.countDistinct("doc_id").alias("n_documents"), F.countDistinct("item_id").alias("n_items"), F.count_if(F.col("run") > 0).alias("n_exact"))
