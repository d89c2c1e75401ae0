"""Summaries over splits, variants, passes and calls, and their printed forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowspark.operators import statistics as S


def split_summary(ratios: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_splits, mean, std, least, most) of the column ratio over splits; null ratios do not count."""
    r = F.col("ratio")
    return ratios.groupBy(*keys).agg(F.count(r).alias("n_splits"), F.avg(r).alias("mean"), F.coalesce(F.stddev_samp(r), F.lit(0.0)).alias("std"), F.min(r).alias("least"), F.max(r).alias("most"))


def pass_count(tests: DataFrame, alpha: float = 0.01) -> DataFrame:
    """(n_tests, n_passed, threshold, passed): tests (p, gap) pass below alpha over their number with a positive gap; all must, and there must be one."""
    n = tests.agg(F.count(F.lit(1)).alias("n_tests"))
    x = tests.crossJoin(F.broadcast(n)).agg(F.max("n_tests").alias("n_tests"), F.count_if((F.col("p") < F.lit(alpha) / F.col("n_tests")) & (F.col("gap") > 0)).alias("n_passed"))
    x = x.withColumn("n_tests", F.coalesce("n_tests", F.lit(0).cast("long")))
    return x.select("n_tests", "n_passed", F.try_divide(F.lit(alpha), F.col("n_tests").cast("double")).alias("threshold"), ((F.col("n_tests") > 0) & (F.col("n_passed") == F.col("n_tests"))).alias("passed"))


def common_phase_summary(rows: DataFrame) -> DataFrame:
    """(variant, n_phases, mean_ratio, best) over the phases for which every variant has a ratio. rows (variant, phase, ratio)."""
    r = rows.where("ratio is not null")
    variants = r.agg(F.countDistinct("variant").alias("k"))
    full = r.groupBy("phase").agg(F.countDistinct("variant").alias("n")).crossJoin(F.broadcast(variants)).where("n = k").select("phase")
    g = r.join(full, "phase", "left_semi").groupBy("variant").agg(F.countDistinct("phase").alias("n_phases"), F.avg("ratio").alias("mean_ratio"))
    return g.withColumn("best", F.col("mean_ratio") == F.max("mean_ratio").over(Window.partitionBy(F.lit(1))))


def budget_stability(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, n_budgets, spread, converged): range of a ratio over pass budgets, and whether all of them converged."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_budgets"), (F.max("ratio") - F.min("ratio")).alias("spread"), F.bool_and("converged").alias("converged"))


def usage_totals(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """(model, n_calls, n_hits, tokens_in, tokens_out, cost): cost from (model, price_in, price_out) per million tokens; unknown models cost 0, cached calls nothing."""
    paid = ~F.col("hit")
    g = calls.groupBy("model").agg(F.count(F.lit(1)).alias("n_calls"), F.count_if("hit").alias("n_hits"), F.sum(F.when(paid, F.col("tokens_in")).otherwise(0)).alias("tokens_in"), F.sum(F.when(paid, F.col("tokens_out")).otherwise(0)).alias("tokens_out"))
    g = g.join(prices, "model", "left")
    return g.select("model", "n_calls", "n_hits", "tokens_in", "tokens_out", F.coalesce((F.col("tokens_in") * F.col("price_in") + F.col("tokens_out") * F.col("price_out")) / 1e6, F.lit(0.0)).alias("cost"))


def length_confound(scores: DataFrame, *keys: str, width: int = 3, least: int = 5) -> DataFrame:
    """(keys, raw_ratio, in_rho, lm_ratio, coverage, out_coverage, n_bins, lm_ci_lo, lm_ci_hi, p_perm): the raw ratio, the rank
    correlation of positive scores with length, the length-matched ratio with its interval, and its permutation p."""
    raw = S.discrimination(scores, *keys).select(*keys, F.col("ratio").alias("raw_ratio"))
    rho = S.spearman(scores.where("pool = 'positive'"), "score", "length", *keys).select(*keys, F.col("rho").alias("in_rho"))
    lm = S.length_matched(scores, *keys, width=width, least=least).select(*keys, "lm_ratio", "coverage", "out_coverage", "n_bins")
    ci, p = S.length_matched_ci(scores, *keys, width=width, least=least), S.permutation_p(scores, *keys, width=width, least=least)
    out = raw
    for part in (rho, lm, ci, p):
        out = out.join(part, list(keys), "left")
    return out


def separation(means: DataFrame, places: float = 1e-9) -> DataFrame:
    """(flow_id, own, nearest, nearest_score, gap, self_best) from the means (flow_id, stratum, mean_score) of a confusion matrix.

    nearest is the other stratum with the smallest mean (ties: the smallest name); a flow is best for its own stratum if no other has a
    smaller mean. Flows without a mean of their own or of another stratum have no row.
    """
    mine = F.col("stratum") == F.col("flow_id")
    g = means.groupBy("flow_id").agg(F.max(F.when(mine, F.col("mean_score"))).alias("own"), F.min(F.when(~mine, F.struct("mean_score", "stratum"))).alias("m"))
    g = g.where("own is not null and m is not null").select("flow_id", "own", F.col("m.stratum").alias("nearest"), F.col("m.mean_score").alias("nearest_score"))
    return g.withColumn("gap", F.col("nearest_score") - F.col("own")).withColumn("self_best", F.col("own") <= F.col("nearest_score") + places)


def markdown(df: DataFrame, limit: int = 200) -> str:
    """The first rows of a report as a Markdown table."""
    rows = df.limit(limit).collect()
    show = lambda x: "" if x is None else f"{x:.4f}" if isinstance(x, float) else str(x)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join(map(show, r)) + " |" for r in rows)])


def result_spec(spec: str) -> tuple[str, str]:
    """(label, path) of 'label=path' or of a path, whose stem is then the label."""
    label, eq, path = spec.partition("=")
    return (label, path) if eq else (spec.rsplit("/", 1)[-1].rsplit(".", 1)[0], spec)
