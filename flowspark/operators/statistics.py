"""Splits, samples and tests: everything statistical, from partially aggregated group-bys; only p-values and resampling use Arrow tasks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowspark.functions.vectors import average_rank
from flowspark.session import Scratch, small_broadcast


def hash_order(seed: int, *columns: str) -> Column:
    """A reproducible random order: the MD5 of seed and key, as every SQL engine computes it."""
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def stratified_split(items: DataFrame, stratum: str, item: str, fraction: float = 0.7, seed: int = 0, least: int = 1) -> DataFrame:
    """items with side: the first round(fraction * n) of each stratum in hash order, at least one, are train (halves to even).

    Strata with fewer than `least` items are left out; a stratum whose share rounds to all its items is all train.
    """
    n = items.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= least)
    w = Window.partitionBy(stratum).orderBy(hash_order(seed, item), item)
    x = items.join(n, stratum).withColumn("_k", F.row_number().over(w))
    cut = F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(fraction), 0))
    return x.withColumn("side", F.when(F.col("_k") <= cut, "train").otherwise("test")).drop("_n", "_k")


def multi_split(items: DataFrame, stratum: str, item: str, splits: int, seed: int = 0, negatives: bool = True) -> DataFrame:
    """(split, stratum, item, pool): per split, half of a stratum's items as positives and as many of other strata as negatives, unless these are not wanted.

    Both in an order of their own per split. An item is drawn as a negative of a stratum by the rank of its hash among all items
    of other strata; ranks come from one window per (split, stratum), the number of strata being small.
    """
    n = small_broadcast(Scratch(items.sparkSession, "halves").put(items.groupBy(stratum).agg(F.floor(F.count(F.lit(1)) / 2).alias("half"))))
    s = items.crossJoin(items.sparkSession.range(splits).select(F.col("id").cast("int").alias("split")))
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("split").cast("string"), F.col(item).cast("string")))
    s = s.withColumn("h", h)
    pos = s.join(n, stratum).withColumn("k", F.row_number().over(Window.partitionBy("split", stratum).orderBy("h", item))).where("k <= half").select("split", stratum, item, F.lit("positive").alias("pool"))
    if not negatives:
        return pos
    other = s.withColumnRenamed(stratum, "_own").join(n, F.col("_own") != F.col(stratum))
    neg = other.withColumn("k", F.row_number().over(Window.partitionBy("split", stratum).orderBy("h", item))).where("k <= half").select("split", stratum, item, F.lit("negative").alias("pool"))
    return pos.unionByName(neg)


def discrimination(scores: DataFrame, *keys: str) -> DataFrame:
    """Per keys: counts, means, sample deviations (0 for one value), ratio and gap of the positive and negative scores.

    scores: (keys, pool, score). The ratio is null where the positive mean is not above 0.
    """
    p, q = F.when(F.col("pool") == "positive", F.col("score")), F.when(F.col("pool") == "negative", F.col("score"))
    g = scores.groupBy(*keys).agg(F.count(p).alias("n_pos"), F.count(q).alias("n_neg"), F.avg(p).alias("mean_pos"), F.avg(q).alias("mean_neg"), F.coalesce(F.nanvl(F.stddev_samp(p), F.lit(0.0)), F.lit(0.0)).alias("std_pos"), F.coalesce(F.nanvl(F.stddev_samp(q), F.lit(0.0)), F.lit(0.0)).alias("std_neg"))
    return g.withColumn("ratio", F.when(F.col("mean_pos") > 0, F.col("mean_neg") / F.col("mean_pos"))).withColumn("gap", F.col("mean_neg") - F.col("mean_pos"))


def moments(scores: DataFrame, *keys: str) -> DataFrame:
    """(keys, n, mean, std_samp, std_pop) of score; the sample deviation of one score is 0."""
    s = F.col("score")
    return scores.groupBy(*keys).agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.coalesce(F.nanvl(F.stddev_samp(s), F.lit(0.0)), F.lit(0.0)).alias("std_samp"), F.stddev_pop(s).alias("std_pop"))


def mann_whitney(scores: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_pos, n_neg, u, rbc, tie_term): U of the positives and rank-biserial correlation, from average ranks."""
    r = average_rank(scores.select(*keys, "pool", "score"), "score", *keys, out="rank")
    p = F.col("pool") == "positive"
    g = r.groupBy(*keys).agg(F.count_if(p).alias("n_pos"), F.count_if(~p).alias("n_neg"), F.sum(F.when(p, F.col("rank")).otherwise(0.0)).alias("r1"))
    t = scores.groupBy(*keys, "score").agg(F.count(F.lit(1)).alias("_k")).groupBy(*keys).agg(F.sum(F.col("_k") * F.col("_k") * F.col("_k") - F.col("_k")).alias("tie_term"))
    g = g.join(t, list(keys)).withColumn("u", F.col("r1") - F.col("n_pos") * (F.col("n_pos") + 1) / 2)
    return g.withColumn("rbc", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.lit(1.0) - F.lit(2.0) * F.col("u") / (F.col("n_pos") * F.col("n_neg")))).drop("r1")


def normal_tail(z: pd.Series) -> pd.Series:
    """Lower tail of the standard normal distribution."""
    return z.map(lambda x: None if x is None or math.isnan(x) else 0.5 * math.erfc(-x / math.sqrt(2)))


#: Sizes up to which the smaller pool, or the ranked differences, have their exact distribution (without ties).
EXACT_POOL, EXACT_PAIRS = 8, 50


def u_counts(n1: int, n2: int) -> np.ndarray:
    """How many arrangements of two pools have each value of U, by the sizes' product of Gaussian binomials."""
    c = np.zeros(n1 * n2 + 1)
    c[0] = 1
    for k in range(1, n1 + 1):
        d = c.copy()  # times (1 - q^(n2 + k))
        if n2 + k < len(c):
            d[n2 + k :] -= c[: len(c) - n2 - k]
        for j in range(k, len(d)):  # over (1 - q^k)
            d[j] += d[j - k]
        c = d
    return c


def signed_rank_counts(n: int) -> np.ndarray:
    """How many sign patterns of ranks 1..n have each sum of the positive ones."""
    c = np.zeros(n * (n + 1) // 2 + 1)
    c[0] = 1
    for r in range(1, n + 1):
        c[r:] = c[r:] + c[: len(c) - r]
    return c


def mann_whitney_p(u: DataFrame) -> DataFrame:
    """u, as from mann_whitney(), with p_less = P(U <= u): exact if a pool has at most EXACT_POOL scores and none are tied, else
    the tie- and continuity-corrected normal approximation."""

    @F.pandas_udf("double")
    def exact(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        return pd.Series([float((c := u_counts(int(a), int(b)))[: int(x) + 1].sum() / c.sum()) for x, a, b in zip(u, n1, n2)])

    n1, n2 = F.col("n_pos"), F.col("n_neg")
    n = n1 + n2
    var = n1 * n2 / 12.0 * ((n + 1) - F.col("tie_term") / F.greatest(n * (n - 1), F.lit(1)))
    u = u.withColumn("p_less", F.when(var > 0, F.pandas_udf(normal_tail, "double")((F.col("u") - n1 * n2 / 2.0 + 0.5) / F.sqrt(F.when(var > 0, var)))))
    small = (F.least(n1, n2) > 0) & (F.least(n1, n2) <= EXACT_POOL) & (F.col("tie_term") == 0)
    few = u.where(small)
    return u.where(~small).unionByName(few.withColumn("p_less", exact("u", "n_pos", "n_neg")))


def averages(scores: DataFrame) -> DataFrame:
    """(stratum, dialogue_id, n_splits, mean_score) of the positive scores of every conversation over splits."""
    return scores.where("pool = 'positive'").groupBy("stratum", "dialogue_id").agg(F.count(F.lit(1)).alias("n_splits"), F.avg("score").alias("mean_score"))


def paired(a: DataFrame, b: DataFrame, key: str, least: int = 5, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, median_diff, w_plus, w_minus, n_ranked, tie_term): Wilcoxon's signed ranks of a.score - b.score over common keys, zeros
    dropped from the ranks. Fewer than `least` common keys give no row. by: columns of both sides; ranks and rows are those of their values."""
    d = a.select(*by, key, F.col("score").alias("x")).join(b.select(*by, key, F.col("score").alias("y")), [*by, key]).select(*by, (F.col("x") - F.col("y")).alias("d"))
    n = d.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.median("d").alias("median_diff")).where(F.col("n") >= least)
    r = average_rank(d.where("d <> 0").select(*by, F.abs("d").alias("a"), (F.col("d") > 0).alias("up"), F.lit(1).alias("g")), "a", *by, "g")
    w = r.groupBy(*by).agg(F.sum(F.when(F.col("up"), F.col("rank"))).alias("w_plus"), F.sum(F.when(~F.col("up"), F.col("rank"))).alias("w_minus"), F.count(F.lit(1)).alias("n_ranked"))
    t = r.groupBy(*by, "a").agg(F.count(F.lit(1)).alias("k")).groupBy(*by).agg(F.sum(F.col("k") * F.col("k") * F.col("k") - F.col("k")).alias("tie_term"))
    x = n.join(w, list(by), "left").join(t, list(by), "left") if by else n.crossJoin(w).crossJoin(t)  # without by one row each
    return x.select(*by, "n", "median_diff", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("w_plus", "w_minus")], *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_ranked", "tie_term")])


def paired_p(w: DataFrame) -> DataFrame:
    """w, as from paired(), with p_two_sided, p_less and p_greater; all 1 if no difference is left.

    Exact for at most EXACT_PAIRS differences without ties and zeros, else the normal approximation with tie correction.
    """

    @F.pandas_udf("p_less double, p_greater double, p_two_sided double")
    def p(n: pd.Series, ranked: pd.Series, up: pd.Series, ties: pd.Series) -> pd.DataFrame:
        rows = []
        for total, m, x, t in zip(n, ranked, up, ties):
            if m == 0:
                rows.append((1.0, 1.0, 1.0))
            elif m <= EXACT_PAIRS and t == 0 and m == total:
                c = signed_rank_counts(int(m))
                low, high = (float(c[k].sum() / c.sum()) for k in (slice(None, round(x) + 1), slice(round(x), None)))
                rows.append((low, high, min(1.0, 2 * min(low, high))))
            else:
                z = (x - m * (m + 1) / 4) / math.sqrt(m * (m + 1) * (2 * m + 1) / 24 - t / 48)
                low, high = (0.5 * math.erfc(-y / math.sqrt(2)) for y in (z, -z))
                rows.append((low, high, min(1.0, 2 * min(low, high))))
        return pd.DataFrame(rows, columns=["p_less", "p_greater", "p_two_sided"])

    return w.withColumn("_p", p("n", "n_ranked", "w_plus", "tie_term")).select("*", "_p.*").drop("_p")


def spearman(df: DataFrame, x: str, y: str, *keys: str) -> DataFrame:
    """(keys, rho, n): correlation of average ranks; null where either is constant."""
    r = average_rank(average_rank(df.select(*keys, x, y), x, *keys, out="_rx"), y, *keys, out="_ry")
    return r.groupBy(*keys).agg(F.try_divide(F.covar_pop("_rx", "_ry"), F.stddev_pop("_rx") * F.stddev_pop("_ry")).alias("rho"), F.count(F.lit(1)).alias("n"))


def length_matched(scores: DataFrame, *keys: str, width: int = 3, least: int = 5) -> DataFrame:
    """(keys, lm_ratio, coverage, out_coverage, n_bins): negative over positive mean inside bins of length, weighted by positives.

    scores: (keys, pool, score, length). Bins need `least` scores of either pool; keys without such a bin have null and zeros.
    """
    p, q = F.col("pool") == "positive", F.col("pool") == "negative"
    b = scores.groupBy(*keys, F.floor(F.col("length") / width).alias("_bin")).agg(F.count_if(p).alias("_np"), F.count_if(q).alias("_nq"), F.sum(F.when(p, F.col("score"))).alias("_sp"), F.avg(F.when(q, F.col("score"))).alias("_mq"))
    ok = (F.col("_np") >= least) & (F.col("_nq") >= least)
    g = b.groupBy(*keys).agg(F.sum(F.when(ok, F.col("_np") * F.col("_mq"))).alias("_a"), F.sum(F.when(ok, F.col("_sp"))).alias("_b"), F.sum(F.when(ok, F.col("_np")).otherwise(0)).alias("_kp"), F.sum(F.when(ok, F.col("_nq")).otherwise(0)).alias("_kq"), F.sum("_np").alias("_np"), F.sum("_nq").alias("_nq"), F.count_if(ok).alias("n_bins"))
    zero = F.lit(0.0)
    return g.select(*keys, F.when(F.col("_b") > 0, F.col("_a") / F.col("_b")).alias("lm_ratio"), F.coalesce(F.try_divide("_kp", "_np"), zero).alias("coverage"), F.coalesce(F.try_divide("_kq", "_nq"), zero).alias("out_coverage"), "n_bins")


def _by_key(scores: DataFrame, keys: tuple[str, ...], f, out: str) -> DataFrame:
    """Resampling needs a key's scores in one task: (key, pool, length bin) vectors of doubles, the size of a test set."""
    schema = ", ".join(f"`{k}` {t}" for k, t in scores.select(*keys).dtypes) + ", " + out
    return scores.groupBy(*keys).applyInPandas(lambda key, b: pd.DataFrame([(*key, *f(b))], columns=[*keys, *[x.split()[0] for x in out.split(", ")]]), schema)


def bootstrap_ratio(scores: DataFrame, *keys: str, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(keys, ratio, ratio_lo, ratio_hi, gap_lo, gap_hi): percentile intervals of ratio and gap; null with an empty pool."""

    def run(b: pd.DataFrame) -> tuple:
        rng = np.random.default_rng(seed)
        p, q = (b.loc[b["pool"] == k, "score"].to_numpy(np.float64) for k in ("positive", "negative"))
        if not len(p) or not len(q):
            return (None,) * 5
        mp, mq = (np.array([x[rng.integers(0, len(x), len(x))].mean() for _ in range(draws)]) for x in (p, q))
        r = np.where(mp > 0, mq / np.where(mp > 0, mp, 1), np.inf)
        return (float(q.mean() / p.mean()) if p.mean() > 0 else None, *map(float, np.quantile(r, [0.025, 0.975])), *map(float, np.quantile(mq - mp, [0.025, 0.975])))

    return _by_key(scores, keys, run, "ratio double, ratio_lo double, ratio_hi double, gap_lo double, gap_hi double")


def _bins(b: pd.DataFrame, width: int, least: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(positive, negative) scores of the length bins with enough of both."""
    pos, score, bins = (b["pool"] == "positive").to_numpy(), b["score"].to_numpy(np.float64), (b["length"] // width).to_numpy()
    both = [(score[(bins == k) & pos], score[(bins == k) & ~pos]) for k in np.unique(bins)]
    return [(p, q) for p, q in both if len(p) >= least and len(q) >= least]


def length_matched_ci(scores: DataFrame, *keys: str, width: int = 3, least: int = 5, draws: int = 2000, seed: int = 0) -> DataFrame:
    """(keys, lm_ci_lo, lm_ci_hi): percentile interval of the length-matched ratio, scores drawn anew inside each bin; null without a bin."""

    def run(b: pd.DataFrame) -> tuple:
        use, rng = _bins(b, width, least), np.random.default_rng(seed)
        if not use:
            return (None, None)
        again = lambda x: x[rng.integers(0, len(x), (draws, len(x)))].mean(1)
        above, below = np.zeros(draws), np.zeros(draws)
        for p, q in use:
            above, below = above + len(p) * again(q), below + len(p) * again(p)
        r = np.where(below > 0, above / np.where(below > 0, below, 1), np.inf)
        return tuple(map(float, np.quantile(r, [0.025, 0.975])))

    return _by_key(scores, keys, run, "lm_ci_lo double, lm_ci_hi double")


def permutation_p(scores: DataFrame, *keys: str, width: int = 3, least: int = 5, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(keys, p_perm): share of shuffles inside length bins whose length-matched ratio reaches the true one, (count + 1) / (draws + 1)."""

    def run(b: pd.DataFrame) -> tuple:
        use, rng = _bins(b, width, least), np.random.default_rng(seed)
        if not use:
            return (None,)
        ratio = lambda a, c: np.where(c > 0, a / np.where(c > 0, c, 1), np.inf)
        true = ratio(sum(len(p) * q.mean() for p, q in use), np.float64(sum(p.sum() for p, _ in use)))
        hits = 0
        for k in range(0, draws, 500):  # bounds the shuffled copies held at once
            m = min(500, draws - k)
            above, below = np.zeros(m), np.zeros(m)
            for p, q in use:
                x = rng.permuted(np.tile(np.concatenate([p, q]), (m, 1)), axis=1)
                below += x[:, : len(p)].sum(1)
                above += len(p) * x[:, len(p) :].mean(1)
            hits += int((ratio(above, below) >= true - 1e-12).sum())
        return ((hits + 1) / (draws + 1),)

    return _by_key(scores, keys, run, "p_perm double")


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, kappa): Cohen's kappa of two raters' labels."""
    cell = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("x"), F.col(b).alias("y")).agg(F.count(F.lit(1)).alias("n"))
    total = cell.agg(F.sum("n").alias("n"), (F.sum(F.when(F.col("x") == F.col("y"), F.col("n")).otherwise(0)) / F.sum("n")).alias("agreement"))
    ex = cell.groupBy("x").agg(F.sum("n").alias("nx")).join(cell.groupBy(F.col("y").alias("x")).agg(F.sum("n").alias("ny")), "x").agg(F.sum(F.col("nx") * F.col("ny")).alias("chance"))
    r = total.crossJoin(ex).withColumn("e", F.col("chance") / (F.col("n") * F.col("n")))
    return r.select("n", "agreement", F.try_divide(F.col("agreement") - F.col("e"), F.lit(1.0) - F.col("e")).alias("kappa"))
