"""Scores of abusive, hateful or sexual language: boosted trees over dense sentence features, calibrated isotonically.

A document is as bad as its worst sentence. Every sentence gets dense features: densities of small lexicons (after
disguised spellings are undone), distances between insults and the second person, cues of reported speech, self-blame,
clinical mention and rules, capitals, punctuation and disguise rates, a plain rule made of these, and the log-odds of word
sequences learned from labelled documents. Labels exist for documents only, and some are wrong: the fit starts from the rule
and the sequence odds, takes the worst sentences of positive documents as positive, and revises that choice with the trees' own
scores. Document scores are calibrated to probabilities by isotonic regression on documents the trees were not fitted on.

The model is fitted on at most FIT_DOCS labelled documents of at most FIT_CHARS characters (those with the smallest hash). All
documents are scored, whole, by one pass without a shuffle; features are made for many sentences at once, and a sentence that
comes again is looked up.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowspark.llm.boost import Boosted, Isotonic
from flowspark.session import Scratch, small_broadcast
from flowspark.sources.tables import canonical_name, read

#: Labelled documents the model may be fitted on, and their characters; harmless sentences per fit; hash table of word sequences.
FIT_DOCS, FIT_CHARS, FIT_NEGATIVES, TABLE = 12_000, 50_000, 10_000, 1 << 18
#: Calibrated probability from which a document counts as found.
FOUND = 0.5
#: Sentences a task remembers the score of.
REMEMBERED = 300_000
#: Small lexicons in English, Spanish and German.
LEXICON = {
    "insult": "ass asshole bastard bitch coward creep cretin cunt dickhead dog dumbass fool freak fuck fucker halfwit idiot imbecile jerk loser moron parasite pig prick rat scum scumbag slut tramp trash vermin whore worm cabrón cerdo escoria idiota imbécil basura inútil puta versager arschloch abschaum dreckskerl hure schlampe schwein trottel",
    "degrading": "brainless dirty disgusting dumb filthy lazy miserable pathetic repulsive rotten spineless stupid ugly useless vile worthless asqueroso asquerosa estúpido estúpida tonto tonta dumm dumme dummer ekelhaft widerlich widerlicher nutzlos nutzloser wertlos",
    "group": "migrants foreigners refugees immigrants muslims jews christians atheists gay gays lesbians disabled disabilities women men blacks whites gypsies people extranjeros inmigrantes mujeres refugiados ausländer flüchtlinge frauen juden",
    "hate": "animals beasts disease filth insects plague rats subhuman vermin breed deport exterminate gas hang infest invade purge steal stink wipe blood inferior deserve belong lock round basura echar fuera ratas plaga ungeziefer gesindel raus weg",
    "threat": "kill die dead burn break choke cut beat hurt hunt knife punch shoot stab strangle regret watch find bones legs throat matar morir muerto sterben töten umbringen",
    "sexual": "sex sexy naked nude bare breast breasts thigh thighs lips tongue horny moan moaned moaning panting undress undressed bed wet hard kissed licked skin neck body bodies strip caress cum dick pussy desnuda desnudo cama nackt bett",
    "second": "you your yours yourself u ya tú tu te ti eres usted du dich dir dein deine bist",
    "first": "i me my myself mine we us our yo mi me ich mich mir mein meinem meine",
    "third": "he she him her his they them their él ella ellos er sie ihn ihr",
    "reported": "call called calling told said says saying shouted shouts heard say wrote reported quoted yelled screamed claimed apologised apologized admitted repeated thought felt think feel believe dijo decía llamó llamaba gritó gritaba sagte sagten nannte rief schrie",
    "clinical": "client clients patient patients medication nurse doctor assault abuse disclosed intimacy therapist therapy session group couple symptoms health assessment treatment side effects sexual policy rule rules never clienta paciente salud terapia klientin patientin sitzung therapie",
    "things": "car phone computer printer machine weather traffic bus train software app laptop website engine alarm",
    "order": "stop shut get go keep leave crawl die call wear come vete cállate verpiss halt hau",
}
WORDS = {k: frozenset(v.split()) for k, v in LEXICON.items()}
KINDS = list(WORDS)
BIT = {k: i for i, k in enumerate(KINDS)}
_STRONG = WORDS["insult"] | WORDS["degrading"] | WORDS["sexual"]

_SENTENCE = re.compile(r"(?<=[.!?])[\s]+|[\r\n]+")
_CAPITAL = re.compile(r"(?<=[^\W\d_A-Z])\s+(?=(?!I\b)[A-Z])")
#: Blanks from which a sentence counts as long.
LONG = 18
_PREFIX = re.compile(r"^\s*[-*•]?\s*(?:\[\d+\]\s*\(\w+\)|[A-Z][a-z]+:)?\s*")
_TOKEN = re.compile(r"[^\W_][\w$@!*|+'.]*[\w$@!*]|[\w$@*]+")
_SPACED = re.compile(r"(?<![\w'])((?:[^\W\d_][ .\-_*]){2,}[^\W\d_])(?![\w'])")
_STRETCH = re.compile(r"(\w)\1{2,}")
_INSIDE = re.compile(r"(?<=[^\W\d_])[.\-_](?=[^\W\d_])")
#: Characters that stand for letters in disguised spelling.
_DISGUISE = str.maketrans("@$0134578!|+", "asoieastbiit")


def _plain(word: str) -> str:
    """A lower-case word with doubled letters made single, so that stretched and plain spellings meet."""
    return re.sub(r"(\w)\1+", r"\1", word)


_BY_PLAIN = {_plain(w): w for w in sorted(_STRONG)}
_BY_SHAPE: dict[tuple[str, str, int], str] = {}
for _w in sorted(_STRONG):
    if len(_w) > 3:
        _BY_SHAPE.setdefault((_w[0], _w[-1], len(_w)), _w)


@lru_cache(maxsize=1 << 17)
def undisguised(token: str) -> tuple[str, bool]:
    """The word a token stands for, and whether it was disguised."""
    t = token.lower()
    if t.isalpha():
        s = _STRETCH.sub(r"\1", t)
        if s != t:
            return _BY_PLAIN.get(_plain(t), s), True
        return t, False
    t = t.strip("'.!?")
    if "*" in t:
        w = _BY_SHAPE.get((t[0], t[-1], len(t))) if t and t[0] != "*" else None
        return (w, True) if w else (t, "*" in t.strip("*"))
    if any(c.isalpha() or c in "@$" for c in t):
        s = _INSIDE.sub("", t)
        if s != t and _plain(s) in _BY_PLAIN:
            return _BY_PLAIN[_plain(s)], True
        if re.search(r"[@$0-9!|+]", s) and re.search(r"[a-z]", s):
            s = s.translate(_DISGUISE)
            if _plain(s) in _BY_PLAIN:
                return _BY_PLAIN[_plain(s)], True
            if s.isalpha():
                return s, "@" in t or "$" in t
    return t, False


def sentences(text: str | None) -> list[str]:
    """Sentences and lines of a text, speaker marks removed, entities resolved."""
    if not text:
        return []
    if "&" in text:
        text = unescape(unescape(text))
    out = []
    for x in _SENTENCE.split(text):
        s = _PREFIX.sub("", x, count=1).strip()
        if s:
            out.append(s)
            if s.count(" ") > LONG:  # a lost full stop: parts that begin with a capital count as well
                parts = _CAPITAL.split(s)
                out += [p for p in parts if p.count(" ") > 3] if len(parts) > 1 else []
    return out


def tokens(sentence: str) -> tuple[list[str], int]:
    """Words of a sentence with disguises undone, and how many were disguised; single letters in a row are one word."""
    spaced = 0

    def join(m: re.Match) -> str:
        nonlocal spaced
        spaced += 1
        return re.sub(r"[ .\-_*]", "", m[1])

    s = _SPACED.sub(join, sentence.replace("’", "'"))
    out, n = [], spaced
    for t in _TOKEN.findall(s):
        w, hidden = undisguised(t)
        n += hidden
        if w:
            out.append(w)
    return out, n


@lru_cache(maxsize=1 << 17)
def _word(w: str) -> tuple[int, int]:
    """Bits of the lexicons a word is in, and its hash; insults, degrading words and groups are taken together in the latter."""
    stem = w[:-1] if w.endswith("s") and len(w) > 3 else w
    bits = sum(1 << BIT[k] for k in KINDS if w in WORDS[k] or (stem in WORDS[k] and k in ("insult", "group", "hate")))
    name = next((f"<{k}>" for k in ("insult", "degrading", "group") if bits >> BIT[k] & 1), w)
    return bits, xxhash.xxh64_intdigest(name)


_UPPER, _LETTER = (np.array([f(chr(i)) for i in range(0x250)], bool) for f in (str.isupper, str.isalpha))
_GAPS = [("insult", "second"), ("degrading", "second"), ("insult", "first"), ("insult", "reported"), ("group", "hate"), ("sexual", "second"), ("sexual", "first"), ("group", "degrading")]
#: A gap between words that do not occur together.
FAR = 30


class Features:
    """Dense features of many sentences, and the places of their one- to three-word sequences in the table."""

    def __init__(self, texts: list[str]):
        bits, hashes, n, hidden = [], [], [], []
        for t in texts:
            words, h = tokens(t)
            own = [_word(w) for w in words]
            bits += [x for x, _ in own]
            hashes.append(1)  # a sentence begins and ends with marks of its own
            hashes += [x for _, x in own]
            hashes.append(2)
            n.append(len(own))
            hidden.append(h)
        self.n = np.array(n, np.int64)
        end = np.cumsum(self.n)
        start = end - self.n
        bits = np.array(bits, np.int64)
        has = (bits[:, None] >> np.arange(len(KINDS)) & 1).astype(bool).reshape(-1, len(KINDS))
        total = np.r_[np.zeros((1, len(KINDS)), np.int64), np.cumsum(has, 0)]
        count = (total[end] - total[start]).astype(np.float64)
        size = np.maximum(self.n, 1)
        of = np.repeat(np.arange(len(texts)), self.n)
        at = [np.flatnonzero(has[:, k]) for k in range(len(KINDS))]
        col = lambda k: count[:, BIT[k]]
        gaps = [self._gap(at[BIT[x]], at[BIT[y]], of) for x, y in _GAPS]
        first = np.where(self.n > 0, np.r_[bits, 0][np.minimum(start, len(bits))], 0)
        bad = has[:, BIT["insult"]] | has[:, BIT["degrading"]]
        late = np.zeros(len(texts), bool)
        near_end = np.flatnonzero(bad & (np.arange(len(bits)) >= end[of] - 2))
        late[of[near_end]] = True
        hidden = np.array(hidden, np.float64)
        marks = np.array([[t.count("!"), t.count("?"), ('"' in t) or ("“" in t)] for t in texts], np.float64).reshape(-1, 3)
        gap = dict(zip(_GAPS, gaps))
        rule = (
            2.0 * (gap["insult", "second"] <= 4) + 1.5 * (gap["degrading", "second"] <= 3) + 2.0 * ((gap["group", "hate"] <= 6) | (gap["group", "degrading"] <= 3)) + 1.5 * ((col("threat") > 0) & (col("second") > 0))
            + 0.7 * np.minimum(col("sexual"), 4) + 0.5 * np.minimum(hidden, 2) - 2.0 * (col("reported") > 0) - 1.0 * (col("clinical") > 0) - 1.0 * (col("things") > 0) - 1.0 * (gap["insult", "first"] <= 3)
        )
        self.dense = np.column_stack([
            count, *(col(k) / size for k in ("insult", "degrading", "sexual", "reported")), *gaps,
            *((first >> BIT[k] & 1) for k in ("order", "second", "first")), late, self._capitals(texts), marks, hidden, hidden / size, np.log1p(self.n), rule,
        ]).astype(np.float64)
        self.rule = rule
        # sequences: of the marked words, those of two and three within a sentence, and single words
        h = np.array(hashes, np.uint64)
        own = np.repeat(np.arange(len(texts)), self.n + 2)
        with np.errstate(over="ignore"):
            mix = lambda x, y: (x * np.uint64(0x9E3779B97F4A7C15) ^ y) * np.uint64(0xBF58476D1CE4E5B9)
            two = mix(h[:-1], h[1:])
            three = mix(two[:-1], h[2:])
        one = h > 2
        in_two, in_three = own[:-1] == own[1:], own[:-2] == own[2:]
        key = np.concatenate([h[one], two[in_two], three[in_three]])
        of_key = np.concatenate([own[one], own[:-1][in_two], own[:-2][in_three]])
        order = np.argsort(of_key, kind="stable")
        self.key, self.of_key = ((key ^ key >> np.uint64(29)) & np.uint64(TABLE - 1)).astype(np.int64)[order], of_key[order]
        self.first_key = np.searchsorted(self.of_key, np.arange(len(texts)))

    @staticmethod
    def _gap(a: np.ndarray, b: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = np.full(int(of[-1]) + 1 if len(of) else 0, float(FAR))
        if len(a) and len(b):
            k = np.searchsorted(b, a)
            for near in (np.clip(k - 1, 0, len(b) - 1), np.clip(k, 0, len(b) - 1)):
                ok = of[b[near]] == of[a]
                np.minimum.at(out, of[a][ok], np.minimum(np.abs(a - b[near]), FAR)[ok].astype(np.float64))
        return out

    @staticmethod
    def _capitals(texts: list[str]) -> np.ndarray:
        c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        c = np.minimum(c, 0x24F)
        end = np.cumsum([len(t) for t in texts])
        part = lambda t: np.diff(np.r_[0, np.r_[0, np.cumsum(t[c])][end]])
        return part(_UPPER) / np.maximum(part(_LETTER), 1)

    def with_odds(self, odds: np.ndarray) -> np.ndarray:
        """All features: the largest, a soft largest, the mean and the smallest log-odds of a sentence's sequences go with the dense ones."""
        o = odds[self.key]
        if not len(self.n):
            return np.zeros((0, self.dense.shape[1] + 4))
        k = np.bincount(self.of_key, minlength=len(self.n))
        soft = np.log(np.add.reduceat(np.exp(o), self.first_key) / k)
        return np.column_stack([self.dense, np.maximum.reduceat(o, self.first_key), soft, np.add.reduceat(o, self.first_key) / k, np.minimum.reduceat(o, self.first_key)])


class Model:
    """Everything scoring needs; small enough to travel with the tasks."""

    def __init__(self, odds: np.ndarray, trees: Boosted | None, level: Isotonic | None, base: float):
        self.odds, self.trees, self.level, self.base = odds, trees, level, base

    def margins(self, texts: list[str]) -> np.ndarray:
        return self.trees.margin(Features(texts).with_odds(self.odds)) if self.trees and texts else np.full(len(texts), -9.0)

    def documents(self, texts: list[str | None], known: dict[str, float] | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(calibrated probability, margin) of each text; texts without sentences have probability 0. known: margins of sentences."""
        known = {} if known is None else known
        own = [sentences(t) for t in texts]
        if len(known) > REMEMBERED:
            known.clear()
        new = list({s: None for x in own for s in x if s not in known})
        for i in range(0, len(new), 20_000):
            known.update(zip(new[i : i + 20_000], self.margins(new[i : i + 20_000]).tolist()))
        m = np.array([max(map(known.__getitem__, x), default=-np.inf) for x in own], np.float64)
        seen = np.isfinite(m)
        p = np.zeros(len(texts))
        if seen.any():
            p[seen] = self.level.predict(m[seen]) if self.level else self.base
        return p, m


def _odds(pos: np.ndarray, neg: np.ndarray, n_pos: float, n_neg: float) -> np.ndarray:
    """Smoothed log-odds; sequences hardly seen are near 0."""
    a = 2.0
    r = max(n_pos, 1.0) / max(n_neg, 1.0)
    return np.log((pos + a * r) / r + 1e-9) - np.log(neg + a)


def fit(labelled: pd.DataFrame, seed: int = 3, odds: bool = True) -> Model:
    """A model of rows (text, toxic 0/1). Without both classes, a model that gives every text the share of positives.

    Without odds the trees see the dense features only. Equal sentences of a fold are one row with a weight.
    """
    y = labelled["toxic"].to_numpy(np.float64)
    base = float(y.mean()) if len(y) else 0.0
    if len(y) < 20 or base in (0.0, 1.0):
        return Model(np.zeros(TABLE), None, None, base)
    rng = np.random.default_rng(seed)
    fold_of = rng.permutation(len(y)) % 3
    number: dict[str, int] = {}
    found = [(i, number.setdefault(x, len(number))) for i, t in enumerate(labelled["text"]) for x in dict.fromkeys(sentences(t))]
    doc, sentence = np.array(found, np.int64).reshape(-1, 2).T
    f = Features(list(number))
    # one row per fold and sentence; row: of each occurrence
    code, row = np.unique(fold_of[doc] * len(number) + sentence, return_inverse=True)
    fold, which = code // len(number), code % len(number)
    harmless = np.bincount(row, y[doc] == 0, len(code))

    def learned(use: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Log-odds of sequences in chosen occurrences against the sentences of negative documents, within use (folds)."""
        if not odds:
            return np.zeros(TABLE)
        inside = use[fold_of[doc]]
        weigh = lambda m: np.bincount(sentence[m], minlength=len(number))[f.of_key]
        a, b = inside & chosen, inside & (y[doc] == 0)
        return _odds(np.bincount(f.key, weigh(a), TABLE), np.bincount(f.key, weigh(b), TABLE), a.sum(), b.sum())

    def grown(rows: np.ndarray, x: np.ndarray, positive: np.ndarray, score: np.ndarray, trees: int) -> Boosted:
        """Trees over rows: chosen sentences, and of the many harmless ones a bounded sample and the most doubtful."""
        neg = rows[harmless[rows] > 0]
        hard = neg[np.argsort(-score[neg], kind="stable")[: FIT_NEGATIVES // 3]]
        easy = neg if len(neg) <= FIT_NEGATIVES else rng.choice(neg, FIT_NEGATIVES, replace=False)
        neg, pos = np.unique(np.concatenate([hard, easy])), rows[positive[rows] > 0]
        both = np.concatenate([pos, neg])
        weight = np.concatenate([positive[pos], np.sqrt(harmless[neg])])
        return Boosted(trees=trees, least=min(8.0, max(2.0, len(pos) / 10))).fit(x[both], np.r_[np.ones(len(pos)), np.zeros(len(neg))], weight)

    chosen = y[doc] == 1  # at first, any sentence of a positive document
    score, last, all_rows = np.zeros(len(code)), 3, np.arange(len(code))
    for turn in range(last + 1):
        x = np.empty((len(code), f.dense.shape[1] + 4))
        for k in range(3):  # odds for a fold come from the others, so the trees see them as they are on new text
            mine = fold == k
            x[mine] = f.with_odds(learned(np.arange(3) != k, chosen))[which[mine]]
        positive = np.bincount(row, chosen, len(code))
        if turn == 0:
            score = x[:, -3] + f.rule[which]
        else:
            trees = [grown(np.flatnonzero(fold != k), x, positive, score, 30) for k in range(3)]
            for k in range(3):
                score[fold == k] = trees[k].margin(x[fold == k])
        best = np.full(len(y), -np.inf)
        np.maximum.at(best, doc, score[row])
        if turn == last:
            break
        # positive documents: the worst sentence, and others nearly certain; none where even the worst looks harmless
        cut = np.quantile(best[(y == 0) & np.isfinite(best)], 0.85) if turn else -np.inf
        sure = np.quantile(score[row][chosen], 0.8) if turn and chosen.any() else np.inf
        chosen = (y[doc] == 1) & (((score[row] == best[doc]) & (best[doc] > cut)) | (score[row] >= sure))
    model = Model(learned(np.ones(3, bool), chosen), None, Isotonic().fit(best[np.isfinite(best)], y[np.isfinite(best)]), base)
    model.trees = grown(all_rows, x, np.bincount(row, chosen, len(code)), score, 60)
    return model


def _score(model: Model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, float] = {}
        for b in batches:
            for i in range(0, len(b), 2000):  # bounds what one batch of long texts holds at once
                c = b.iloc[i : i + 2000]
                p, m = model.documents(c["text"].tolist(), known)
                yield pd.DataFrame({"doc_id": c["doc_id"].to_numpy(), "probability": p, "margin": np.where(np.isfinite(m), m, -99.0)})

    return run


def labelled_sample(spark: SparkSession, documents: DataFrame, labels: DataFrame, limit: int = FIT_DOCS) -> pd.DataFrame:
    """At most limit rows (text, toxic): documents whose raters agree, of at most FIT_CHARS characters, smallest hash first.

    The ids, whose number is bounded, go to the documents; texts are not shuffled.
    """
    y = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.avg("toxic").alias("y")).where("y = 0 or y = 1")
    ids = Scratch(spark, "labelled").put(y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit))
    texts = documents.where(f"text is not null and length(text) <= {FIT_CHARS}").select("doc_id", "text").join(small_broadcast(ids), "doc_id")
    return texts.select("doc_id", "text", F.col("y").alias("toxic")).toPandas().sort_values(["doc_id", "text"], kind="stable")[["text", "toxic"]].reset_index(drop=True)


def scores(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, probability, margin) of every document with an id.

    documents: (doc_id, text), labels: (doc_id, toxic); other columns are ignored. Null and empty texts get 0. Null labels and
    documents whose raters disagree are not learned from; without labels of both kinds every text gets the known share.
    """
    model = fit(labelled_sample(documents.sparkSession, documents, labels))
    return documents.where("doc_id is not null").select("doc_id", "text").mapInPandas(_score(model), "doc_id long, probability double, margin double")


def toxic_documents(spark: SparkSession, d: str) -> DataFrame:
    s = scores(read(spark, d, "documents"), read(spark, d, "doc_labels"))
    return s.where(F.col("probability") >= FOUND).select("doc_id").distinct()


def rates(spark: SparkSession, d: str) -> DataFrame:
    """Documents, found documents, rate and mean probability per source (spellings taken together)."""
    docs = read(spark, d, "documents")
    s = Scratch(spark, "toxic").put(scores(docs, read(spark, d, "doc_labels")))
    src = docs.select("doc_id", F.coalesce(canonical_name("source"), F.lit("unknown")).alias("source"))
    g = s.join(src, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n_documents"), F.count_if(F.col("probability") >= FOUND).alias("n_toxic"), F.round(F.avg("probability"), 6).alias("mean_probability"))
    return g.withColumn("rate", F.round(F.col("n_toxic") / F.col("n_documents"), 6))
