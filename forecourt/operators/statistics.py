"""Distributions, correlation, outliers, bootstrap, imputation."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.numbers import half_up, ratio
from forecourt.functions.tails import chi_square_quantile, t_p
from forecourt.operators.drift import long_numbers, long_texts, numeric_drift
from forecourt.operators.joins import join_on, known_size
from forecourt.operators.quantiles import (
    QUARTILES, absolute_deviation, one_row, quantile_values, quantiles, value_counts, values_at_ranks)


def adjusted_shape(column: str) -> tuple[Column, Column]:
    """Bias-adjusted sample skewness and excess kurtosis."""
    n, skew, kurt = F.count(column), F.skewness(column), F.kurtosis(column)
    g1 = F.when(n > 2, skew * F.sqrt(n * (n - 1.0)) / F.nullif(n - 2, F.lit(0)))
    g2 = F.when(n > 3, (n - 1.0) / F.nullif((n - 2.0) * (n - 3.0), F.lit(0.0)) * ((n + 1) * kurt + 6))
    return g1, g2


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, mode, std, variance, skewness and kurtosis (both bias-adjusted)."""
    skew, kurt = adjusted_shape(column)
    base = df.agg(half_up(F.avg(column)).alias("mean"), half_up(F.stddev_samp(column)).alias("std"),
                  half_up(F.var_samp(column), 0).alias("variance"), half_up(skew, 6).alias("skewness"),
                  half_up(kurt, 6).alias("kurtosis"))
    counts = value_counts(df, column, [])
    most = counts.agg(F.min(F.struct(-F.col("_w"), F.col("_value")))["_value"]).scalar()
    return base.withColumns({"median": half_up(quantile_values(df, column, {"m": 0.5})["m"]), "mode": most})


def quartile_summary(df: DataFrame, column: str) -> DataFrame:
    """Quartiles with (mean - median) / std and IQR / median, on rounded figures."""
    base = df.agg(F.count("*").alias("total_count"), half_up(F.avg(column)).alias("mean_price"),
                  half_up(F.stddev_samp(column)).alias("std_price"), F.min(column).alias("min_price"), F.max(column).alias("max_price"))
    base = base.withColumn("_q", quantile_values(df, column, QUARTILES)).withColumns(
        {c: half_up(F.col(f"_q.{c}")) for c in ("q1", "median", "q3")}).drop("_q")
    return base.withColumns({
        "skewness": half_up(ratio(F.col("mean_price") - F.col("median"), F.col("std_price")), 4),
        "relative_iqr": half_up(ratio(F.col("q3") - F.col("q1"), F.col("median")), 4)})


def robust_distributions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column: median, MAD, IQR, and population skewness and excess kurtosis."""
    long = long_numbers(df, columns).where(F.col("value").isNotNull())
    shape = long.groupBy("column_name").agg(
        half_up(F.skewness("value"), 6).alias("skewness"), half_up(F.kurtosis("value"), 6).alias("kurtosis"))
    q = quantiles(long, "value", QUARTILES, ["column_name"]).select(
        "column_name", half_up("median").alias("median"), half_up(F.col("q3") - F.col("q1")).alias("iqr"))
    mad = absolute_deviation(long, "value", ["column_name"]).withColumn("mad", half_up("mad"))
    return join_on(join_on(q, mad, ["column_name"]), shape, ["column_name"])


def robust_prices(df: DataFrame, groups: list[str]) -> DataFrame:
    """Count, median, MAD and IQR of the price overall and for each value of each group column."""
    named = [F.struct(F.lit("overall").alias("group_column"), F.lit("all").alias("group_value"))]
    named += [F.struct(F.lit(g).alias("group_column"), F.col(g).cast("string").alias("group_value")) for g in groups]
    by = ["group_column", "group_value"]
    # counted per price first, so the copies for each grouping are made of counts; written, as each step below reads them anew
    priced = df.where(F.col("price").isNotNull()).groupBy(*groups, "price").agg(F.count("*").alias("_n"))
    long = priced.select(F.explode(F.array(*named)).alias("g"), "price", "_n").select("g.*", "price", "_n")
    long = known_size(long.where(F.col("group_value").isNotNull()).groupBy(*by, "price").agg(F.sum("_n").alias("_n")))
    q = known_size(quantiles(long, "price", QUARTILES, by, weight="_n"))
    count = long.groupBy(*by).agg(F.sum("_n").alias("count"))
    gaps = join_on(long, q.select(*by, "median"), by).withColumn("_gap", F.abs(F.col("price") - F.col("median")))
    mad = quantiles(gaps, "_gap", {"mad": 0.5}, by, weight="_n")
    return join_on(join_on(count, q, by), mad, by).select(
        *by, "count", half_up("median").alias("median"), half_up("mad").alias("mad"),
        half_up(F.col("q3") - F.col("q1")).alias("iqr"))


def bootstrap_median(df: DataFrame, column: str, resamples: int = 1000, confidence: float = 0.95, seed: int = 42) -> DataFrame:
    """Bootstrap confidence interval of the median without building a single resample.

    The median of n draws with replacement is the data value at a rank whose law is known:
    the middle order statistics of n uniform draws are Beta distributed. So each resample is
    one pair of ranks, and all of them are looked up together. Only the row count and the
    ranks, two per resample, pass through the driver.
    """
    n = df.where(F.col(column).isNotNull()).count()
    if n == 0:
        return df.sparkSession.createDataFrame([], "ci_low double, ci_high double, resamples bigint")
    rng = np.random.default_rng(seed)
    if n % 2:
        low = high = rng.beta((n + 1) / 2, (n + 1) / 2, resamples)
    else:
        low = rng.beta(n / 2, n / 2 + 1, resamples)
        high = low + (1 - low) * rng.beta(1, n / 2, resamples)
    ranks = np.minimum((np.stack([low, high], 1) * n).astype(np.int64), n - 1)
    draws = df.sparkSession.createDataFrame(pd.DataFrame(ranks, columns=["lo", "hi"]).assign(draw=range(resamples)))
    wanted = F.array(*[F.lit(int(x)) for x in np.unique(ranks)])
    found = values_at_ranks(df, column, lambda _: wanted)
    exact = found.select(F.explode(F.filter(wanted, lambda x: (x >= F.col("_first")) & (x < F.col("_next")))).alias("rank"), "_value")
    sides = draws.unpivot(["draw"], ["lo", "hi"], "side", "rank").join(exact, "rank")
    medians = sides.groupBy("draw").agg(F.avg("_value").alias("median"))
    alpha = (1 - confidence) / 2
    return medians.agg(F.percentile("median", F.lit(alpha)).alias("ci_low"),
                       F.percentile("median", F.lit(1 - alpha)).alias("ci_high"), F.count("*").alias("resamples"))


def correlations(df: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """Pearson correlation of each column pair over the rows where both are known."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    one = df.agg(*[x for i, (a, b) in enumerate(pairs) for x in (
        F.corr(a, b).alias(f"r{i}"), F.count_if(F.col(a).isNotNull() & F.col(b).isNotNull()).alias(f"n{i}"))])
    long = one.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"n{i}").alias("pairs"), F.col(f"r{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)])))
    free = F.col("pairs") - 2
    t = F.col("correlation") * F.sqrt(free / F.nullif(1 - F.pow("correlation", F.lit(2)), F.lit(0.0)))
    return long.withColumn("p_value", t_p(t, free)).withColumn("significant", F.col("p_value") < alpha)


def iqr_outliers(df: DataFrame, column: str, fence: float = 1.5) -> DataFrame:
    """Fence bounds, outliers below and above, their share, and the mean of the rest."""
    q = df.withColumn("_q", quantile_values(df, column, QUARTILES))
    x, q1, q3 = F.col(column), F.col("_q.q1"), F.col("_q.q3")
    low, high = q1 - (q3 - q1) * fence, q3 + (q3 - q1) * fence
    return q.agg(
        half_up(F.max(q1)).alias("q1"), half_up(F.max(q3)).alias("q3"), half_up(F.max(q3 - q1)).alias("iqr"),
        half_up(F.max(low)).alias("lower_bound"), half_up(F.max(high)).alias("upper_bound"),
        F.count_if(x < low).alias("low_outliers"), F.count_if(x > high).alias("high_outliers"),
        half_up(ratio(F.count_if((x < low) | (x > high)) * 100.0, F.count("*")), 4).alias("outliers_percentage"),
        half_up(F.avg(F.when(x.between(low, high), x))).alias("avg_normal"))


def largest_outliers(df: DataFrame, column: str, key: str, k: int = 5, fence: float = 1.5) -> DataFrame:
    """The ``k`` largest rows above the upper fence, ties by key; every task hands on ``k`` rows at most."""
    q = quantile_values(df, column, QUARTILES)
    return df.where(F.col(column) > q["q3"] + (q["q3"] - q["q1"]) * fence).orderBy(F.desc(column), key).limit(k)


def box_figures(df: DataFrame, group: str, column: str) -> DataFrame:
    """Box-plot numbers per group: quartiles, and the whiskers within 1.5 IQR."""
    rows = df.where(F.col(group).isNotNull() & F.col(column).isNotNull())
    counts = value_counts(rows, column, [group])
    q = quantiles(counts, "_value", QUARTILES, [group], weight="_w")
    near = join_on(counts, q, [group])
    gap, x = (F.col("q3") - F.col("q1")) * 1.5, F.col("_value")
    inside = x.between(F.col("q1") - gap, F.col("q3") + gap)
    return near.groupBy(group).agg(
        F.sum("_w").alias("listings"), half_up(F.max("q1")).alias("q1"), half_up(F.max("median")).alias("median"),
        half_up(F.max("q3")).alias("q3"), F.min(F.when(inside, x)).alias("lower_whisker"),
        F.max(F.when(inside, x)).alias("upper_whisker"),
        F.coalesce(F.sum(F.when(~inside, F.col("_w"))), F.lit(0).cast("bigint")).alias("outliers"))


def mahalanobis_outliers(df: DataFrame, columns: list[str], share: float = 0.975) -> DataFrame:
    """Add the Mahalanobis distance of median-filled, robust-scaled columns and its outlier flag.

    The driver inverts one p x p covariance matrix; distances are native expressions.
    """
    p = len(columns)
    filled = df = known_size(df)  # read once per column and twice more
    for c in columns:
        q = quantiles(df, c, QUARTILES).first()
        spread = (q.q3 - q.q1) or 1.0
        filled = filled.withColumn(f"_z_{c}", (F.coalesce(F.col(c).cast("double"), F.lit(q.median)) - q.median) / spread)
    z = [f"_z_{c}" for c in columns]
    m = filled.agg(*[F.avg(a).alias(f"m{i}") for i, a in enumerate(z)], *[
        F.covar_samp(z[i], z[j]).alias(f"c{i}_{j}") for i in range(p) for j in range(i, p)]).first()
    cov = np.array([[m[f"c{min(i, j)}_{max(i, j)}"] for j in range(p)] for i in range(p)], dtype=float)
    inverse = np.linalg.pinv(cov)
    gap = [F.col(a) - m[f"m{i}"] for i, a in enumerate(z)]
    square = F.lit(0.0)
    for i in range(p):
        for j in range(p):
            square = square + gap[i] * gap[j] * float(inverse[i, j])
    cut = float(np.sqrt(chi_square_quantile(share, p)))
    return filled.withColumn("distance", F.sqrt(square)).withColumn("is_outlier", F.col("distance") > cut).drop(*z)


def mad_anomalies(df: DataFrame, column: str, times: float = 3.0, name: str = "is_anomaly") -> DataFrame:
    """Flag values more than ``times`` median absolute deviations from the median."""
    middle = quantile_values(df, column, {"m": 0.5})["m"]
    mad = one_row(absolute_deviation(df, column))["mad"]
    return df.withColumn(name, F.coalesce(F.abs(F.col(column) - middle) > mad * times, F.lit(False)))


def column_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: the mode of each column, smallest on a tie."""
    counts = long_texts(df, columns).where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(F.count("*").alias("_n"))
    return counts.groupBy().agg(*[
        F.min(F.when(F.col("column_name") == c, F.struct(-F.col("_n"), F.col("value"))))["value"].alias(c) for c in columns])


def fill_modes(df: DataFrame, columns: list[str]) -> DataFrame:
    modes = one_row(column_modes(df, columns))
    return df.withColumns({c: F.coalesce(F.col(c), modes[c].cast(dict(df.dtypes)[c])) for c in columns})


def fill_conditional_modes(df: DataFrame, target: str, given: list[str]) -> DataFrame:
    """Fill nulls with the mode among rows sharing ``given``, else with the overall mode.

    The modes come from counts, and only they are joined back.
    """
    from forecourt.operators.aggregates import group_mode

    local = group_mode(df.dropna(subset=given), given, target, "_local")
    overall = one_row(column_modes(df, [target]))[target]
    kind = dict(df.dtypes)[target]
    joined = join_on(df, local, given, "left")
    return joined.withColumn(target, F.coalesce(F.col(target), F.col("_local"), overall.cast(kind))).drop("_local")


def imputation_report(before: DataFrame, after: DataFrame, numeric: list[str]) -> DataFrame:
    """Per numeric column: nulls before and after, mean and std before and after, KS distance."""
    def figures(df: DataFrame, tag: str) -> DataFrame:
        return long_numbers(df, numeric).groupBy("column_name").agg(
            F.count_if(F.col("value").isNull()).alias(f"missing_{tag}"), half_up(F.avg("value"), 4).alias(f"mean_{tag}"),
            half_up(F.stddev_samp("value"), 4).alias(f"std_{tag}"))

    ks = numeric_drift(before, after, numeric).select("column_name", half_up("statistic", 6).alias("ks_statistic"))
    return join_on(join_on(figures(before, "before"), figures(after, "after"), ["column_name"]), ks, ["column_name"])


def category_change(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """Change of each category's share, before minus after."""
    from forecourt.operators.drift import aligned_counts

    counts = aligned_counts(before, after, columns)
    totals = counts.groupBy("column_name").agg(F.sum("reference").alias("_reference"), F.sum("current").alias("_current"))
    return join_on(counts, totals, ["column_name"]).select("column_name", "value", half_up(
        F.col("reference") / F.col("_reference") - F.col("current") / F.col("_current"), 6).alias("change"))
