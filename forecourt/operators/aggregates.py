"""Grouped market figures built from one vocabulary of metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.functions.numbers import half_up, ratio
from forecourt.operators.joins import join_on
from forecourt.operators.quantiles import quantiles


def _financed(column: str) -> Column:
    return F.when(F.col("has_installments"), F.col(column))


def metrics() -> dict[str, Column]:
    """Metric name to aggregate; averages and spreads are rounded half up."""
    price, km = F.col("price"), F.col("odometer")
    return dict(
        total_listings=F.count("*"),
        priced=F.count(price),
        avg_price=half_up(F.avg(price)),
        min_price=F.min(price),
        max_price=F.max(price),
        std_price=half_up(F.stddev_samp(price)),
        total_value=half_up(F.sum(price)),
        avg_mileage=half_up(F.avg(km)),
        min_mileage=F.min(km),
        max_mileage=F.max(km),
        std_mileage=half_up(F.stddev_samp(km)),
        avg_year=half_up(F.avg("year")),
        total_financed=F.count_if(F.col("has_installments")),
        financing_percentage=half_up(ratio(F.count_if(F.col("has_installments")) * 100, F.count("*"))),
        # over the financed listings only
        avg_monthly_payment=half_up(F.avg(_financed("monthly_payment"))),
        avg_down_payment=half_up(F.avg(_financed("down_payment"))),
        avg_installments=half_up(F.avg(_financed("installments"))),
        # over every listing that states the value
        mean_monthly_payment=half_up(F.avg("monthly_payment")),
        mean_down_payment=half_up(F.avg("down_payment")),
        mean_installments=half_up(F.avg("installments")),
    )


def summarise(df: DataFrame, by: list[str], names: list[str], *, drop_null_keys: bool = False,
              min_count: int = 0, order: str | None = None, top: int | None = None,
              **extra: Column) -> DataFrame:
    """Group and measure; optionally keep groups of ``min_count`` rows and the top k.

    Ties in the ordering metric are broken by the keys.
    """
    if drop_null_keys:
        df = df.dropna(subset=by)
    known = metrics()
    aggs = [known[k].alias(k) for k in names] + [c.alias(k) for k, c in extra.items()]
    if min_count:
        aggs.append(F.count("*").alias("_size"))
    out = df.groupBy(*by).agg(*aggs)
    if min_count:
        out = out.where(F.col("_size") >= min_count).drop("_size")
    if order and top:
        out = out.orderBy(F.desc(order), *[F.asc(k) for k in by]).limit(top)
    return out


def with_medians(stats: DataFrame, df: DataFrame, by: list[str], **columns: str) -> DataFrame:
    """Add rounded medians: ``with_medians(stats, df, keys, median_price="price")``."""
    for name, value in columns.items():
        mid = quantiles(df, value, {name: 0.5}, by)
        stats = join_on(stats, mid.withColumn(name, half_up(name)), by, "left", nulls_match=True)
    return stats


def share_of_total(counts: DataFrame, amount: str, name: str = "percentage") -> DataFrame:
    """Percentage of the column total. For grouped counts, not for raw listings."""
    return counts.withColumn(name, half_up(F.col(amount) * 100.0 / F.sum(amount).over(Window.partitionBy())))


def top_counts(df: DataFrame, column: str, k: int | None = None, name: str = "total") -> DataFrame:
    """Value counts without nulls, largest first, ties by value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias(name))
    return counts.orderBy(F.desc(name), column).limit(k) if k else counts


def top_per_group(counts: DataFrame, group: list[str], amount: str, key: str, k: int) -> DataFrame:
    """The k largest rows of each group of an already grouped frame, with their rank."""
    place = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(amount), key))
    return counts.withColumn("place", place).where(F.col("place") <= k)


def group_mode(df: DataFrame, by: list[str], column: str, name: str) -> DataFrame:
    """Most frequent non-null value per group, the smallest on a tie.

    Counts per (group, value) first, so a hot group is spread over its values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("_n"))
    best = F.min(F.struct(-F.col("_n"), F.col(column)))[column]
    return counts.groupBy(*by).agg(best.alias(name))


def retention(df: DataFrame, as_of_year: int, min_count: int = 10, top: int = 15) -> DataFrame:
    """Price kept per 1000 miles driven, by make and model."""
    rows = df.where(F.col("odometer") > 0)
    return summarise(
        rows, ["manufacturer", "model"], ["avg_price", "total_listings"], min_count=min_count,
        avg_age=half_up(F.avg(F.lit(as_of_year) - F.col("year")), 1),
        avg_price_per_1000_miles=half_up(F.avg(ratio(F.col("price"), F.col("odometer")) * 1000)),
        order="avg_price_per_1000_miles", top=top,
    )


def pivot_means(df: DataFrame, row: str, column: str, values: list[str], measure: str) -> DataFrame:
    """Mean of ``measure`` by row and column value, wide; a missing pair is 0.

    The column values are given, so Spark plans one pass and no extra job to find them.
    """
    wide = df.where(F.col(row).isNotNull()).groupBy(row).pivot(column, values).agg(F.avg(measure))
    return wide.select(row, *[half_up(F.coalesce(F.col(f"`{v}`"), F.lit(0.0))).alias(v) for v in values])
