"""Clusters of mutually similar records: sketches in bands, exact verification, components, medoids.

Sets of texts are sketched by MinHash bands, which propose pairs; these are verified by their exact Jaccard similarity. All pairs
of a bucket are compared, those of large ones in parts.

A vector is no set. Its bands hold what a minimum is to a set: the strongest signed axis under a random rotation (cross-polytope
hashing). Every record has its own bands, whose number follows from the wanted recall at the wanted cosine, which therefore holds
at every size and place: a larger table has more buckets per band, so that buckets stay bounded, and more bands. Inside a bucket
every row meets every other, but for rows that the triangle inequality of angles rules out; large buckets are taken apart by
further bands, again with the wanted recall. Buckets see vectors as bytes: what a byte's error leaves open is
verified with the vectors themselves. A bucket larger than `BUCKET`, as a group of copies makes, is cut into parts: its largest
component stays where it is, and only the rows outside it visit the other parts.

Components of the links are the clusters. A component is loose if members are not similar to its medoid; on request these are
grouped around medoids of their own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowspark.llm.groups import spanning_forest
from flowspark.session import Scratch, small_broadcast
from flowspark.sources.tables import latest, read

#: MinHash bands of sets, and values per band.
SET_BANDS, SET_ROWS = 40, 2
#: Buckets of sets up to this size are compared at once, larger ones in parts of this size.
FULL_BUCKET = 64
#: The wanted similarities.
COSINE, JACCARD = 0.75, 0.5
#: Wanted share of the pairs at the wanted cosine that meet in a bucket, and of those that meet in one of its parts.
RECALL = 0.97
#: Rows of a bucket of vectors that one task takes, buckets of a band at least (if they are not small), rows compared at once, and rows multiplied at once.
BUCKET, SPREAD, WHOLE, STRIP = 200_000, 8, 16384, 1024
#: Share of the rows a task takes that an average bucket has, so that only groups of copies are too large, and axes per dimension of a value at most.
FILL, AXES = 0.25, 8
#: Rows up to which a bucket is compared without pivots, pivots tried at once, rows of a ball, and share of the rest that balls should take.
SMALL, PIVOTS, BALL, DENSE = 512, 128, 16, 0.1


def _roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return parent
        parent = up


def _contract(comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Components after the links i, j; the name of one is its smallest row."""
    while len(i):  # a root takes one link at a time
        a, c = comp[i], comp[j]
        parent = np.arange(len(comp))
        parent[np.maximum(a, c)] = np.minimum(a, c)
        comp = _roots(parent)[comp]
        still = comp[i] != comp[j]
        i, j = i[still], j[still]
    return comp


@lru_cache(maxsize=256)
def rotation(dim: int, k: int) -> np.ndarray:
    """The k-th random rotation of dim axes."""
    q, r = np.linalg.qr(np.random.default_rng([dim, k]).standard_normal((dim, dim)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


@lru_cache(maxsize=256)
def directions(dim: int, k: int, axes: int) -> np.ndarray:
    """The first axes of the k-th rotation; more than dim are continued by those of further rotations."""
    return np.ascontiguousarray(np.concatenate([rotation(dim, k + t * 1_000_003) for t in range(math.ceil(axes / dim))], 1)[:, :axes])


def strongest_axis(x: np.ndarray, k: int, axes: int) -> np.ndarray:
    """Number of the strongest one, with its sign, of the first axes of each row under the k-th rotation."""
    y = x @ directions(x.shape[1], k, axes)
    at = np.abs(y).argmax(1)
    return 2 * at + (y[np.arange(len(y)), at] < 0)


@lru_cache(maxsize=256)
def agreement(dim: int, axes: int, cosine: float = COSINE, pairs: int = 20_000) -> float:
    """Share of random pairs with the cosine whose strongest axis is the same, by simulation."""
    g = np.random.default_rng(dim)
    x, y = g.standard_normal((2, pairs, dim)).astype(np.float32)
    x /= np.sqrt((x * x).sum(1))[:, None]
    if dim > 1:
        y -= (x * y).sum(1)[:, None] * x
        y /= np.sqrt((y * y).sum(1))[:, None]
        y = cosine * x + math.sqrt(1 - cosine**2) * y
    else:
        y = x
    return float((strongest_axis(x, 0, axes) == strongest_axis(y, 0, axes)).mean())


def plan(n: int, dim: int, rows: float, least: float = COSINE) -> tuple[int, int, int]:
    """Bands, values per band, and axes per value, for n vectors in buckets of about that many rows: pairs meet with probability RECALL.

    Vectors that fit into one bucket need one band without values, in which all pairs meet. One value of many axes needs fewer
    bands than several values of few.
    """
    buckets = n / rows
    if buckets <= 1:
        return 1, 0, 0
    values = max(1, math.ceil(math.log(buckets) / math.log(2 * AXES * dim) - 1e-9))
    axes = min(AXES * dim, math.ceil(buckets ** (1 / values) / 2))
    return max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - min(agreement(dim, axes, least) ** values, 0.9999)))), values, axes


def _components(x: np.ndarray, slack: float, least: float, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Components (smallest row of each) of rows by sure links, and pairs (i, j) between components that the slack leaves open."""
    n = len(x)
    comp, rest, draw = np.arange(n), np.arange(n), np.random.default_rng(level)
    links, open_ = [], []
    while len(rest) > SMALL:
        # balls around pivots: the rows of one are one component; all other rows meet them where angles allow a link
        pivots = draw.choice(rest, PIVOTS, replace=False)
        c = x[pivots] @ x[rest].T
        sure, free = c >= least + slack, np.ones(len(rest), bool)
        for k in np.argsort(-sure.sum(1), kind="stable"):
            mine = sure[k] & free
            if mine.sum() < BALL:
                continue
            free &= ~mine
            ball = rest[mine]
            links.append((ball, np.full(len(ball), pivots[k])))
            reach = math.acos(max(-1.0, least - slack)) + math.acos(min(1.0, max(-1.0, float(c[k, mine].min()) - slack)))
            may = rest[free & (c[k] >= math.cos(min(math.pi, reach)) - slack)]
            i, j, o = linked(x[may], x[ball], slack, least)
            links.append((may[i], ball[j]))
            open_.append((may[o[0]], ball[o[1]]))
        taken, rest = 1 - len(rest[free]) / len(rest), rest[free]
        if taken < DENSE:
            break
    if len(rest) <= WHOLE:
        y = x[rest]
        for s in range(0, len(rest), STRIP):
            c = y[s : s + STRIP] @ y[s:].T
            i, j = np.divmod(np.flatnonzero(c >= least - slack), c.shape[1])
            keep = i < j
            i, j = i[keep], j[keep]
            good = c[i, j] >= least + slack
            links.append((rest[i[good] + s], rest[j[good] + s]))
            open_.append((rest[i[~good] + s], rest[j[~good] + s]))
    else:  # many small components: taken apart by further bands
        bands, values, axes = plan(len(rest), x.shape[1], WHOLE, least)
        for t in range(bands):
            value = np.zeros(len(rest), np.int64)
            for k in range(values):
                value = value * 2 * axes + strongest_axis(x[rest], 1000 * (level + 1) + t * values + k, axes)
            order = np.argsort(value, kind="stable")
            for g in np.split(order, np.flatnonzero(np.diff(value[order])) + 1):
                rows = np.sort(rest[g])
                sub, i, j = _components(x[rows], slack, least, level + 1)
                links.append((rows, rows[sub]))
                open_.append((rows[i], rows[j]))
    comp = _contract(comp, *(np.concatenate([p[k] for p in links]) if links else np.zeros(0, np.int64) for k in (0, 1)))
    return _open(comp, open_)


def _open(comp: np.ndarray, pairs: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i, j = (np.concatenate([p[k] for p in pairs]) if pairs else np.zeros(0, np.int64) for k in (0, 1))
    keep = comp[i] != comp[j]
    return comp, i[keep], j[keep]


def linked(x: np.ndarray, y: np.ndarray, slack: float, least: float) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """Sure links (i, j) of every row of x that has one, to the most similar row of y, and the open pairs of rows without one."""
    i, j, oi, oj = [], [], [], []
    for s in range(0, len(x), STRIP):
        for t in range(0, len(y), 16 * STRIP):
            c = x[s : s + STRIP] @ y[t : t + 16 * STRIP].T
            best = c.argmax(1)
            most = c[np.arange(len(c)), best]
            sure = most >= least + slack
            i.append(np.flatnonzero(sure) + s)
            j.append(best[sure] + t)
            left = np.flatnonzero((most >= least - slack) & ~sure)
            p, q = np.nonzero(c[left] >= least - slack)
            oi.append(left[p] + s)
            oj.append(q + t)
    cat = lambda z: np.concatenate(z) if z else np.zeros(0, np.int64)
    return cat(i), cat(j), (cat(oi), cat(oj))


def local_clusters(x: np.ndarray, least: float = COSINE) -> np.ndarray:
    """Components (smallest row of each) of unit vectors."""
    return _components(x, 0.0, least)[0]


def _vectors(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a usable vector of dim numbers, and the unit vectors; null, zero and non-finite ones are not usable."""
    column = column.cast(pa.list_(pa.float32()))
    start = column.offsets.to_numpy()
    at = np.flatnonzero(column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(start) == dim))
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat[start[at][:, None] + np.arange(dim)]
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.sqrt((x * x).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return at[ok], (x[ok] / norm[ok, None]).astype(np.float32)


CODED = "id long, code binary, keys array<long>"


def _encode(dim: int, bands: int, values: int, axes: int):
    """Batches of (id, vector) as bytes, one per number and four for their scale, with the keys of all bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _vectors(b.column("vector"), dim)
            if not len(at):
                continue
            scale = np.abs(x).max(1) / np.float32(127)
            code = np.concatenate([np.rint(x / scale[:, None]).astype(np.int8).view(np.uint8), scale.astype(np.float32)[:, None].view(np.uint8)], 1)
            keys = np.zeros((len(at), bands), np.int64)
            for k in range(bands):
                key = np.full(len(at), k, np.int64)
                for a in range(values):
                    key = key * (2 * axes) + strongest_axis(x, k * values + a, axes)
                keys[:, k] = key
            width, n = dim + 4, len(at)
            codes = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(code))])
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * bands, bands, dtype=np.int32)), pa.array(keys.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), codes, lists], ["id", "code", "keys"])

    return run


def _decode(codes: np.ndarray | pd.Series, dim: int) -> tuple[np.ndarray, float]:
    """Vectors of codes, and how far cosines of two of them may be from the true ones."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, dim + 4)
    scale = raw[:, dim:].copy().view(np.float32)
    # an error vector has numbers of at most half a scale; two errors and their product
    error = 0.5 * float(scale.max(initial=0)) * math.sqrt(dim)
    return raw[:, :dim].view(np.int8).astype(np.float32) * scale, error * (2 + error) + 1e-5


LINKS = "a long, b long, sure boolean"


def _rows(a: np.ndarray, b: np.ndarray, sure: bool) -> pd.DataFrame:
    return pd.DataFrame({"a": a, "b": b, "sure": np.full(len(a), sure)})


def _groups(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Whole groups of batches that are sorted by their key; several groups may come together."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        last = b[by[0]].to_numpy() != b[by[0]].iloc[-1]
        for c in by[1:]:
            last |= b[c].to_numpy() != b[c].iloc[-1]
        cut = int(np.flatnonzero(last)[-1]) + 1 if last.any() else 0
        if cut:
            yield pd.concat([*held, b.iloc[:cut]]) if held else b.iloc[:cut]
            held = []
        elif held and any(held[-1][c].iloc[-1] != b[c].iloc[0] for c in by):
            yield pd.concat(held)
            held = []
        held.append(b.iloc[cut:])
    if held:
        yield pd.concat(held)


def _compare(dim: int, least: float, by: list[str], members: bool = False):
    """Links of whole buckets (id, code), sorted by key and id; with members, rows (*by, id, root, n) instead of sure links."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in _groups(batches, by):
            cols = [g[c].to_numpy() for c in by]
            new = np.flatnonzero(np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0), True])
            ids, codes = g["id"].to_numpy(), g["code"].to_numpy()
            for s, e in zip(new[:-1], new[1:]):
                if e - s < 2 and not members:
                    continue
                x, slack = _decode(codes[s:e], dim)
                comp, i, j = _components(x, slack, least)
                own = ids[s:e]
                if members:
                    size = np.bincount(comp, minlength=len(comp))
                    yield pd.DataFrame({c: v[s:e] for c, v in zip(by, cols)} | {"id": own, "root": own[comp], "n": size[comp], "b": pd.Series([None] * len(own), dtype="Int64")})
                    if len(i):
                        yield pd.DataFrame({c: np.full(len(i), v[s]) for c, v in zip(by, cols)} | {"id": own[i], "root": own[i], "n": np.zeros(len(i), np.int64), "b": pd.Series(own[j], dtype="Int64")})
                else:
                    far = np.flatnonzero(comp != np.arange(len(comp)))
                    yield _rows(own[far], own[comp[far]], True)
                    yield _rows(own[i], own[j], False)

    return run


def _visit(dim: int, least: float):
    """Links of the visitors of a part with the rows that live there."""

    def run(home: pd.DataFrame, guests: pd.DataFrame) -> pd.DataFrame:
        if not len(home) or not len(guests):
            return _rows(np.zeros(0, np.int64), np.zeros(0, np.int64), True)
        (x, s), (y, t) = _decode(guests["code"], dim), _decode(home["code"], dim)
        g, h, root, out, slack = guests["id"].to_numpy(), home["id"].to_numpy(), home["root"].to_numpy(), [], max(s, t)
        for i in range(0, len(x), STRIP):
            for j in range(0, len(y), 16 * STRIP):
                c = x[i : i + STRIP] @ y[j : j + 16 * STRIP].T
                p, q = np.nonzero(c >= least - slack)
                sure = c[p, q] >= least + slack
                # one link to each component of the part is enough
                k = pd.DataFrame({"p": p[sure] + i, "q": q[sure] + j, "root": root[q[sure] + j]}).drop_duplicates(["p", "root"])
                out += [_rows(g[k["p"]], h[k["q"]], True), _rows(g[p[~sure] + i], h[q[~sure] + j], False)]
        return pd.concat(out)

    return run


def _hot_links(rows: DataFrame, hot: DataFrame, dim: int, least: float, tmp: Scratch, bucket: int) -> DataFrame:
    """Links inside buckets (key, n) that are too large for one task.

    Each part is compared alone. The bucket's largest component of a part gives a pivot; the components of all parts that hold a
    row similar to it are its core, which is one component. Rows outside the core visit all other parts.
    """
    parts = F.ceil(F.col("n") / bucket).cast("int")
    h = tmp.put(rows.join(small_broadcast(hot), "key").select("key", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"), "id", "code", parts.alias("parts")))
    alone = tmp.put(h.select("key", "part", "id", "code").repartition("key", "part").sortWithinPartitions("key", "part", "id").mapInPandas(_compare(dim, least, ["key", "part"], True), "key long, part int, id long, root long, n long, b long"))
    own = alone.where("b is null").select("key", "part", "id", "root", "n")
    first = own.where("id = root").groupBy("key").agg(F.max(F.struct("n", "part", "root")).alias("m")).select("key", F.col("m.part").alias("part"), F.col("m.root").alias("id"))
    pivot = tmp.put(h.join(small_broadcast(first), ["key", "part", "id"]).select("key", F.col("id").alias("pivot"), F.col("code").alias("pivot_code")))

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                (x, s), (y, t) = _decode(b["code"], dim), _decode(b["pivot_code"], dim)
                yield b.loc[(x * y).sum(1) >= least + max(s, t), ["key", "part", "id", "pivot"]]

    close = h.join(small_broadcast(pivot), "key").mapInPandas(near, "key long, part int, id long, pivot long")
    core = tmp.put(close.join(own, ["key", "part", "id"]).groupBy("key", "part", "root").agg(F.min("pivot").alias("pivot")))
    links = own.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b"), F.lit(True).alias("sure"))
    links = links.unionByName(alone.where("b is not null").select(F.col("id").alias("a"), "b", F.lit(False).alias("sure")))
    links = links.unionByName(core.select(F.col("root").alias("a"), F.col("pivot").alias("b"), F.lit(True).alias("sure")))
    out = tmp.put(own.join(core, ["key", "part", "root"], "left_anti").select("key", "part", "id"))
    slices = small_broadcast(tmp.put(out.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / bucket).cast("int").alias("slices"))))
    visitors = out.join(h, ["key", "part", "id"]).join(slices, "key").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).where("to <> part")
    visitors = tmp.put(visitors.select("key", F.col("to").alias("part"), F.pmod(F.xxhash64("id", F.lit(7)), F.col("slices")).cast("int").alias("slice"), "id", "code"))
    home = h.join(own, ["key", "part", "id"]).join(slices, "key").select("key", "part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "id", "root", "code")
    by = ["key", "part", "slice"]
    met = home.groupBy(by).cogroup(visitors.groupBy(by))
    return links.unionByName(met.applyInPandas(_visit(dim, least), LINKS))


def vector_roots(spark: SparkSession, vectors: DataFrame, dim: int, least: float, tmp: Scratch, bucket: int | None = None) -> DataFrame:
    """(id, root) of the components of the verified links among (id, vector), for every usable vector's id."""
    bucket, n = bucket or BUCKET, vectors.select("id").count()
    bands, values, axes = plan(n, dim, min(max(1, FILL * bucket), max(WHOLE, n / SPREAD)), least)
    coded = tmp.put(vectors.mapInArrow(_encode(dim, bands, values, axes), CODED))
    keys = coded.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    hot = tmp.put(keys.where(F.col("n") > bucket))
    rows = coded.select(F.explode("keys").alias("key"), "id", "code")
    any_hot = not hot.isEmpty()
    cold = rows.join(small_broadcast(hot.select("key")), "key", "left_anti") if any_hot else rows
    # keys are dense numbers: a few buckets for each task, in equal numbers
    tasks = min(bands * max(1, 2 * axes) ** values, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    links = cold.repartitionById(tasks, F.pmod("key", F.lit(tasks)).cast("int")).sortWithinPartitions("key", "id").mapInPandas(_compare(dim, least, ["key"]), LINKS)
    links = tmp.put(links.unionByName(_hot_links(rows, hot, dim, least, tmp, bucket)) if any_hot else links)
    pairs = tmp.put(links.where("not sure and a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ids = small_broadcast(tmp.put(pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()))
    v = tmp.put(vectors.join(ids, "id", "left_semi").dropDuplicates(["id"]))
    x, y = (v.select(F.col("id").alias(c), F.transform("vector", lambda z: z.cast("double")).alias(w)) for c, w in (("a", "x"), ("b", "y")))
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    true = pairs.join(x, "a").join(y, "b").where(dot("x", "y") >= least * F.sqrt(dot("x", "x")) * F.sqrt(dot("y", "y"))).select("a", "b")
    true = tmp.put(true)
    # a row's first partner stands for it: its other links become links of that partner, which few rows have
    own = tmp.put(links.where("sure and a <> b").groupBy("a").agg(F.min("b").alias("first"), F.collect_set("b").alias("all")))
    edges = own.select(F.col("first").alias("a"), F.explode("all").alias("b")).where("a <> b").distinct().unionByName(true)
    nodes = own.select(F.explode("all").alias("a")).unionByName(true.select("a")).unionByName(true.select(F.col("b").alias("a"))).distinct()
    edges = edges.unionByName(own.join(small_broadcast(tmp.put(nodes)), "a", "left_semi").select("a", F.col("first").alias("b")))
    forest, _ = spanning_forest(spark, edges)
    first = coded.select("id").distinct().join(own.select(F.col("a").alias("id"), "first"), "id", "left").withColumn("v", F.coalesce("first", "id"))
    return first.join(small_broadcast(forest), "v", "left").select("id", F.coalesce("root", "v").alias("root"))


def _units(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _vectors(b.column("vector"), dim)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(at) + 1) * dim, dim, dtype=np.int32)), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), lists], ["id", "vector"])

    return run


def _bucket_links(buckets: DataFrame, verify, tmp: Scratch, least: float) -> DataFrame | None:
    """Verified links (a, b) among the members (key, id) of buckets; all pairs of a bucket are verified, large buckets in parts."""
    n = small_broadcast(tmp.put(buckets.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")))
    parts = F.ceil(F.col("n") / FULL_BUCKET)
    m = tmp.put(buckets.join(n, "key").withColumn("part", F.pmod(F.xxhash64("id"), parts)))
    # a member of part p meets part q under the key (p, q), p <= q
    two = F.inline(F.transform(F.sequence(F.lit(0), parts - 1), lambda q: F.struct(F.least("part", q).alias("p"), F.greatest("part", q).alias("q"))))
    x = m.select("key", "id", "part", two)
    pairs = x.select("key", "p", "q", F.col("id").alias("a"), F.col("part").alias("s")).join(x.select("key", "p", "q", F.col("id").alias("b"), F.col("part").alias("t")), ["key", "p", "q"])
    pairs = pairs.where("a < b and (s <> t or p = q)").select("a", "b").distinct()
    links = tmp.put(verify(pairs).where(F.col("cosine") >= least).select("a", "b"))
    return None if links.isEmpty() else links


def _split_loose(comps: DataFrame, links: DataFrame, verify, tmp: Scratch, least: float) -> DataFrame:
    """comps (id, root) with the members not similar to their component's medoid moved to medoids of their own."""
    deg = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("deg"))
    rest, done = tmp.put(comps.join(deg, "id", "left").withColumn("deg", F.coalesce("deg", F.lit(0)))), None
    while True:
        med = rest.groupBy("root").agg(F.max(F.struct("deg", (-F.col("id")).alias("o"), "id")).alias("m")).select("root", F.col("m.id").alias("medoid"))
        x = rest.join(med, "root")
        ok = verify(x.where("id <> medoid").select(F.col("id").alias("a"), F.col("medoid").alias("b"))).where(F.col("cosine") >= least).select(F.col("a").alias("id"), F.lit(True).alias("ok"))
        x = tmp.put(x.join(ok, "id", "left").withColumn("far", ~(F.coalesce("ok", F.lit(False)) | (F.col("id") == F.col("medoid")))))
        near = x.where("not far").select("id", F.col("medoid").alias("root"))
        done = near if done is None else done.unionByName(near)
        loose = x.where("far").select("id", "root", "deg")
        if loose.isEmpty():
            return done
        rest = loose


def _around_medoids(rows: DataFrame, dim: int, split_loose: bool, tmp: Scratch, least: float) -> DataFrame:
    """(id, root, near, central) of members (id, vector, root) of components; with split_loose, members not similar to the medoid have medoids of their own."""
    rest, done = tmp.put(rows), None
    while True:
        total = rest.groupBy("root").agg(F.array(*[F.sum(F.col("vector")[i].cast("double")) for i in range(dim)]).alias("total"))
        cosine = lambda y: F.aggregate(F.zip_with("vector", y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, p: s + p)
        med = rest.join(total, "root").groupBy("root").agg(F.max(F.struct(F.round(cosine("total"), 9).alias("c"), (-F.col("id")).alias("o"), "id", "vector")).alias("m"))
        med = tmp.put(med.select("root", F.col("m.id").alias("medoid"), F.col("m.vector").alias("mv")))
        x = tmp.put(rest.join(med, "root").withColumn("near", cosine("mv")))
        close = (F.col("near") >= least) | (F.col("id") == F.col("medoid")) | F.lit(not split_loose)
        near = x.where(close).select("id", F.col("medoid").alias("root"), F.col("near").cast("float").alias("near"), (F.col("id") == F.col("medoid")).alias("central"))
        done = near if done is None else done.unionByName(near)
        rest = x.where(~close).select("id", "vector", "root")
        if rest.isEmpty():
            return tmp.put(done)


def vector_clusters(spark: SparkSession, vectors: DataFrame, least: float = COSINE, split_loose: bool = True, medoids: bool = True, bucket: int | None = None) -> DataFrame:
    """(id, cluster, size, near, central): the cluster of every vector, named by its smallest id; near is the cosine to the
    cluster's medoid (the member with the greatest sum of cosines to all), which is central. Without medoids only the
    components: (id, cluster, size).

    vectors: (id long, vector array<float>); other columns are ignored. Null, empty, zero and non-finite vectors and null ids
    belong to no cluster and have no row, nor do vectors of another length than the most frequent one (ties: the longer); of rows
    with equal id and different vectors each counts for its id's links, and the id has one row. A record that resembles no other
    is a cluster of one. Empty input gives an empty table. bucket: rows of a bucket that one task takes.
    """
    tmp = Scratch(spark, "vectors")
    v = vectors.where("id is not null and vector is not null and size(vector) > 0").select("id", "vector")
    common = v.groupBy(F.size("vector").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if common is None:
        return spark.createDataFrame([], "id long, cluster long, size long" + (", near float, central boolean" if medoids else ""))
    dim = common["dim"]
    m = vector_roots(spark, v, dim, least, tmp, bucket)
    if medoids:
        m = _around_medoids(v.mapInArrow(_units(dim), "id long, vector array<float>").dropDuplicates(["id"]).join(m, "id"), dim, split_loose, tmp, least)
    m = tmp.put(m)
    tmp.only(m)
    name = m.groupBy("root").agg(F.min("id").alias("cluster"), F.count(F.lit(1)).alias("size"))
    return m.join(name, "root").select("id", "cluster", "size", *(["near", "central"] if medoids else []))


def set_clusters(spark: SparkSession, sets: DataFrame, least: float = JACCARD, split_loose: bool = False) -> DataFrame:
    """(id, cluster, size): components of sets whose Jaccard similarity is at least `least`.

    sets: (id, items array<string>); equal ids are united, null items and empty sets are ignored (their ids have no row).
    Equal sets are one class; only classes are sketched and compared. cluster is the smallest id.
    """
    tmp = Scratch(spark, "sets")
    s = sets.where("id is not null and items is not null").select("id", F.explode("items").alias("x")).where("x is not null").groupBy("id").agg(F.sort_array(F.collect_set("x")).alias("items"))
    s = tmp.put(s.withColumn("class", F.xxhash64("items")))
    classes = s.groupBy("class", "items").agg(F.min("id").alias("name"))
    classes = tmp.put(classes.select(F.xxhash64("name").alias("id"), "name", "class", "items"))
    h = F.transform(F.sequence(F.lit(1), F.lit(SET_BANDS * SET_ROWS)), lambda i: F.array_min(F.transform("items", lambda t: F.xxhash64(i, t))))
    sig = classes.select("id", h.alias("h"))
    band = F.transform(F.sequence(F.lit(0), F.lit(SET_BANDS - 1)), lambda b: F.xxhash64(b, F.slice(F.col("h"), b * SET_ROWS + 1, SET_ROWS)))
    buckets = tmp.put(sig.select("id", F.explode(band).alias("key")))

    def verify(pairs: DataFrame) -> DataFrame:
        full = pairs.join(classes.select(F.col("id").alias("a"), F.col("items").alias("x")), "a").join(classes.select(F.col("id").alias("b"), F.col("items").alias("y")), "b")
        common = F.size(F.array_intersect("x", "y"))
        return full.select("a", "b", (common / (F.size("x") + F.size("y") - common)).alias("cosine"))

    links = _bucket_links(buckets, verify, tmp, least)
    if links is None:
        links = spark.createDataFrame([], "a long, b long")
    links = tmp.put(links.distinct())
    forest, _ = spanning_forest(spark, links)
    comps = forest.withColumnRenamed("v", "id")
    if split_loose:
        comps = _split_loose(comps, links, verify, tmp, least)
    c = classes.join(comps, "id", "left").select("class", "items", F.coalesce("root", "id").alias("root"))
    m = tmp.put(s.join(c, ["class", "items"]).select("id", "root"))
    tmp.only(m)
    name = m.groupBy("root").agg(F.min("id").alias("cluster"), F.count(F.lit(1)).alias("size"))
    return m.join(name, "root").select("id", "cluster", "size")


def utterance_vectors(spark: SparkSession, d: str) -> DataFrame:
    """(id, vector) of the latest deliveries. Only ids delivered more than once are looked up: vectors are not shuffled for it."""
    u = read(spark, d, "utterances").where("utt_id is not null")
    twice = u.groupBy("utt_id").agg(F.max("loaded_at").alias("last"), F.count(F.lit(1)).alias("n")).where("n > 1").select("utt_id", "last")
    twice = small_broadcast(Scratch(spark, "deliveries").put(twice))
    return u.join(twice, "utt_id", "left").where("last is null or loaded_at = last").select(F.col("utt_id").alias("id"), F.col("embedding").alias("vector"))


def bucket_sets(spark: SparkSession, d: str) -> DataFrame:
    b = read(spark, d, "intent_buckets").select(F.col("bucket_id").alias("id"), F.explode("utterances").alias("x"))
    b = b.select("id", F.lower(F.trim(F.regexp_replace("x", r"^\s+|\s+$", ""))).alias("x")).where("x <> ''")
    return b.groupBy("id").agg(F.collect_set("x").alias("items"))


def found(spark: SparkSession, d: str, least_utterances: int = 3, least_buckets: int = 2) -> DataFrame:
    """(record_kind, record_id, cluster_id) of utterances in clusters of at least three and buckets of at least two."""
    v = vector_clusters(spark, utterance_vectors(spark, d), split_loose=False, medoids=False).where(F.col("size") >= least_utterances)
    s = set_clusters(spark, bucket_sets(spark, d)).where(F.col("size") >= least_buckets)
    row = lambda kind: [F.lit(kind).alias("record_kind"), F.col("id").cast("string").alias("record_id"), F.col("cluster").cast("string").alias("cluster_id")]
    return v.select(*row("utterance")).unionByName(s.select(*row("bucket")))


def described(spark: SparkSession, d: str, top: int = 3) -> DataFrame:
    """(record_kind, cluster, size, rank, member, similarity, text): clusters and their `top` most typical texts.

    Of clusters of at least three utterances these are the medoid and the members nearest to it, similarity being the cosine to the
    medoid. Of clusters of at least two buckets these are the texts that most of the members hold, similarity being their share
    and member the smallest bucket that holds the text.
    """
    v = Scratch(spark, "described").put(vector_clusters(spark, utterance_vectors(spark, d)).where("size >= 3"))
    best = v.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.col("central").desc(), F.col("near").desc(), "id"))).where(F.col("rank") <= top)
    text = latest(read(spark, d, "utterances"), "utt_id", "text").withColumnRenamed("utt_id", "id")
    row = lambda kind, member, similarity, text: [F.lit(kind).alias("record_kind"), F.col("cluster").cast("string").alias("cluster"), "size", "rank", F.col(member).cast("string").alias("member"), F.round(similarity, 4).cast("double").alias("similarity"), text]
    utterances = best.join(text, "id", "left").select(*row("utterance", "id", "near", F.trim("text").alias("text")))
    sets = Scratch(spark, "described").put(bucket_sets(spark, d))
    held = set_clusters(spark, sets).where("size >= 2").join(sets, "id").select("id", "cluster", "size", F.explode("items").alias("text"))
    held = held.groupBy("cluster", "size", "text").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    held = held.withColumn("rank", F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("n"), "text"))).where(F.col("rank") <= top)
    return utterances.unionByName(held.select(*row("bucket", "id", F.col("n") / F.col("size"), "text")))
