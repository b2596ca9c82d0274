"""Daily and monthly series: resampling, events, decomposition, forecast figures.

A series has one row per day or month, so windows over a whole series stay small no matter
how many listings there are. ``by`` keeps many series apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.functions.numbers import half_up, ratio
from forecourt.operators.joins import join_on
from forecourt.operators.quantiles import one_row, quantiles


def resample(df: DataFrame, moment: str, period: str, **aggs: Column) -> DataFrame:
    """Aggregate per day, month or another period; periods without rows do not appear."""
    start = F.date_trunc(period, F.col(moment)).cast("date")
    return df.where(F.col(moment).isNotNull()).groupBy(start.alias("period")).agg(*[c.alias(a) for a, c in aggs.items()])


def rolling_events(series: DataFrame, value: str, window: int = 30, threshold: float = 2.0,
                   by: list[str] | None = None) -> DataFrame:
    """z-score against the trailing window (the row included) and an event flag.

    Null until the window is full and holds no null.
    """
    last = Window.partitionBy(*(by or [])).orderBy("period").rowsBetween(-(window - 1), 0)
    full = F.count(value).over(last) == window
    z = F.when(full, ratio(F.col(value) - F.avg(value).over(last), F.stddev_samp(value).over(last)))
    return series.withColumn("z_score", z).withColumn("is_event", F.coalesce(F.abs("z_score") > threshold, F.lit(False)))


def trailing_mean(series: DataFrame, value: str, last: int = 7) -> Column:
    """Mean of the last ``last`` points as a scalar, for a regressor's future values."""
    return series.orderBy(F.desc("period")).limit(last).agg(F.avg(value)).scalar()


def decompose(series: DataFrame, value: str, period: int = 12, extrapolate: bool = True) -> DataFrame:
    """Additive seasonal decomposition: trend, seasonal, residual.

    The trend is the centred moving average (half weights at the ends for an even period).
    The ends, where the average has no full window, follow the line through the nearest
    ``period`` trend points, or stay null.
    """
    w = Window.orderBy("period")
    rows = series.withColumn("_i", F.row_number().over(w) - 1)
    half = period // 2
    around, inner = w.rowsBetween(-half, half), w.rowsBetween(-half + 1, half - 1)
    if period % 2:
        mean = F.avg(value).over(around)
    else:
        ends = F.lag(value, half).over(w) + F.lead(value, half).over(w)
        mean = (F.sum(value).over(inner) + ends / 2) / period
    rows = rows.withColumn("trend", F.when(F.count(value).over(around) == 2 * half + 1, mean))
    if extrapolate:
        known = rows.where(F.col("trend").isNotNull())
        edge = one_row(known.agg(F.min("_i").alias("a"), F.max("_i").alias("b")))
        near = known.withColumn("_e", edge)
        i, a, b = F.col("_i"), F.col("_e.a"), F.col("_e.b")
        front = (i < F.least(a + period, b))
        back = (i >= F.greatest(a, b - period)) & (i < b)
        x = i.cast("double")

        def line(where: Column, name: str) -> list[Column]:
            y = F.when(where, F.col("trend"))
            return [F.regr_slope(y, x).alias(f"{name}_slope"), F.regr_intercept(y, x).alias(f"{name}_start")]

        ends = one_row(near.agg(F.max(a).alias("a"), F.max(b).alias("b"), *line(front, "front"), *line(back, "back")))
        rows = rows.withColumn("_e", ends)
        rows = rows.withColumn("trend", F.when(i < F.col("_e.a"), F.col("_e.front_slope") * i + F.col("_e.front_start"))
                               .when(i > F.col("_e.b"), F.col("_e.back_slope") * i + F.col("_e.back_start"))
                               .otherwise(F.col("trend"))).drop("_e")
    rows = rows.withColumns({"_phase": F.col("_i") % period, "_loose": F.col(value) - F.col("trend")})
    phases = rows.groupBy("_phase").agg(F.avg("_loose").alias("_mean"))
    phases = phases.withColumn("seasonal", F.col("_mean") - F.avg("_mean").over(Window.partitionBy())).drop("_mean")
    out = join_on(rows, phases, ["_phase"])
    return out.withColumn("residual", F.col(value) - F.col("trend") - F.col("seasonal")).drop("_i", "_phase", "_loose")


def season_extremes(seasonal: DataFrame, moment: str, value: str) -> DataFrame:
    """Month and weekday (Monday 0) of the highest and lowest seasonal value, and the amplitude."""
    def part(name: str, unit: Column) -> DataFrame:
        mean = seasonal.groupBy(unit.alias("unit")).agg(F.avg(value).alias("level"))
        top = F.min(F.struct(-F.col("level"), F.col("unit")))["unit"]
        low = F.min(F.struct(F.col("level"), F.col("unit")))["unit"]
        return mean.agg(F.lit(name).alias("component"), top.alias("peak"), low.alias("trough"),
                        half_up(F.max("level") - F.min("level"), 4).alias("amplitude"))

    return part("yearly", F.month(moment)).unionByName(part("weekly", F.weekday(moment)))


def robust_daily(df: DataFrame, moment: str, min_rows: int = 30) -> DataFrame:
    """Daily price series cleared of extremes.

    Prices up to 100 and from the 99th percentile on are left out, then days whose median
    lies outside P10 - 1.5 spread .. P90 + 1.5 spread. Fewer than ``min_rows`` usable
    listings give an empty series.
    """
    dated = df.where(F.col(moment).isNotNull())
    # one number on the driver: a literal bound reaches the file reader and is not recomputed
    found = quantiles(dated, "price", {"top": 0.99}).first()
    top = found.top if found else 0.0
    good = dated.where((F.col("price") > 100) & (F.col("price") < top)).withColumn("period", F.col(moment).cast("date"))
    stats = good.groupBy("period").agg(
        F.avg("price").alias("price_mean"), F.stddev_samp("price").alias("price_std"), F.count("*").alias("listing_count"))
    daily = join_on(stats, quantiles(good, "price", {"price_median": 0.5}, ["period"]), ["period"])
    q = quantiles(daily, "price_median", {"a": 0.1, "b": 0.9})
    gap = (F.col("b") - F.col("a")) * 1.5
    fence = one_row(q.select((F.col("a") - gap).alias("low"), (F.col("b") + gap).alias("high")))
    enough = good.agg(F.count("*")).scalar() >= min_rows
    return daily.where(enough & F.col("price_median").between(fence["low"], fence["high"]))


def forecast_metrics(df: DataFrame, actual: str, predicted: str, by: list[str] | None = None,
                     normalised: bool = False) -> DataFrame:
    """MAE, MSE, RMSE and MAPE over rows where both values are finite.

    ``normalised`` divides each side by its own mean before the percentage error.
    """
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    by = by or []
    rows = df.where(finite(actual) & finite(predicted))
    y, p = F.col(actual).cast("double"), F.col(predicted).cast("double")
    if normalised:
        means = rows.groupBy(*by).agg(F.avg(y).alias("_my"), F.avg(p).alias("_mp"))
        rows = join_on(rows, means, by, nulls_match=True) if by else rows.withColumn("_m", one_row(means)).withColumns(
            {"_my": F.col("_m._my"), "_mp": F.col("_m._mp")})
        off = F.abs(ratio(y / F.col("_my") - p / F.col("_mp"), y / F.col("_my")))
    else:
        off = F.abs(ratio(y - p, y))
    enough = F.count("*") >= 2
    return rows.groupBy(*by).agg(
        F.when(enough, F.avg(F.abs(y - p))).alias("mae"), F.when(enough, F.avg(F.pow(y - p, F.lit(2)))).alias("mse"),
        F.when(enough, F.sqrt(F.avg(F.pow(y - p, F.lit(2))))).alias("rmse"),
        F.when(enough, F.avg(off) * 100).alias("mape"))
