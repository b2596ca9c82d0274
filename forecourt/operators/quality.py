"""Data quality: checks, expectations, profiles, anomalies by make."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.numbers import half_up, ratio
from forecourt.operators.aggregates import top_per_group
from forecourt.operators.drift import long_numbers, long_texts
from forecourt.operators.joins import join_on
from forecourt.operators.quantiles import QUARTILES, quantiles, value_counts
from forecourt.schema import REQUIRED_COLUMNS


@dataclass(frozen=True)
class Expectation:
    """One expectation: kind, column, and its bounds, set or least passing share."""

    kind: str
    column: str | None = None
    mostly: float = 1.0
    low: float | None = None
    high: float | None = None
    values: tuple[str, ...] = ()


def raw_suite(as_of_year: int, most_rows: int | None = None) -> list[Expectation]:
    """Expectations of listings as read; ``most_rows`` bounds the row count if given."""
    # Columns, tolerances, ranges and sets of the raw suite.
    exist = ["price", "year", "odometer", "manufacturer", "state", "fuel", "transmission"]
    return [
        *[Expectation("exists", c) for c in exist],
        Expectation("not_null", "price", 0.70),
        Expectation("not_null", "year", 0.90),
        Expectation("not_null", "odometer", 0.70),
        Expectation("between", "price", 0.95, 0, 1_000_000),
        Expectation("between", "year", 0.99, 1900, as_of_year + 1),
        Expectation("between", "odometer", 0.99, 0, 1_500_000),
        Expectation("in_set", "fuel", 0.90, values=("gas", "diesel", "hybrid", "electric", "other")),
        Expectation("in_set", "transmission", 0.90, values=("automatic", "manual", "other")),
        Expectation("row_count", low=1_000, high=most_rows),
    ]


def clean_suite(as_of_year: int, most_rows: int | None = None) -> list[Expectation]:
    """Expectations of listings after cleaning; ``most_rows`` bounds the row count if given."""
    # Columns, tolerances and ranges of the clean suite.
    return [
        *[Expectation("exists", c) for c in ("price", "year", "odometer", "vehicle_age")],
        Expectation("not_null", "price", 0.99),
        Expectation("not_null", "year", 0.99),
        Expectation("not_null", "odometer", 0.95),
        Expectation("between", "price", 0.99, 100, 500_000),
        Expectation("between", "year", 0.99, 1980, as_of_year + 1),
        Expectation("between", "odometer", 0.95, 0, 500_000),
        Expectation("row_count", low=500, high=most_rows),
    ]


def _passes(e: Expectation, seen: Column) -> Column:
    if e.kind != "row_count":
        return seen >= e.mostly
    return seen >= e.low if e.high is None else seen.between(e.low, e.high)


def _observed(e: Expectation, columns: list[str]) -> Column:
    """Passing share of an expectation; the row count for ``row_count``."""
    if e.kind == "exists":
        return F.max(F.lit(1.0 if e.column in columns else 0.0))
    if e.kind == "row_count":
        return F.count("*").cast("double")
    if e.column not in columns:
        return F.max(F.lit(0.0))
    c = F.col(e.column)
    if e.kind == "not_null":
        return F.count(c) / F.count("*").cast("double")
    hit = c.between(e.low, e.high) if e.kind == "between" else c.isin(*e.values)
    # over the non-null values; nothing to judge counts as passed
    return F.coalesce(ratio(F.count_if(hit), F.count(c)), F.lit(1.0))


def validate(df: DataFrame, suite: list[Expectation]) -> DataFrame:
    """Every expectation judged in one pass: (position, expectation, column_name, observed, success)."""
    names = [f"e{i}" for i in range(len(suite))]
    seen = df.agg(*[_observed(e, df.columns).alias(x) for x, e in zip(names, suite)])
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("position"), F.lit(e.kind).alias("expectation"), F.lit(e.column).alias("column_name"),
            F.col(x).alias("observed"),
            _passes(e, F.col(x)).alias("success"))
        for i, (x, e) in enumerate(zip(names, suite))])
    return seen.select(F.inline(rows))


class QualityGateError(ValueError):
    """A suite that must pass did not."""


def gate(df: DataFrame, suite: list[Expectation], must_pass: bool) -> list[str]:
    """Failed expectations by name; raises if ``must_pass`` and there are any.

    Only the failed lines of the suite, at most its length, reach the driver.
    """
    failed = [f"{r.expectation}({r.column_name or 'table'})" for r in validate(df, suite).where("not success").collect()]
    if failed and must_pass:
        raise QualityGateError("; ".join(failed))
    return failed


def raw_checks(df: DataFrame, as_of_year: int) -> DataFrame:
    """Missing columns, nulls and out-of-range counts of raw listings, long."""
    checks = {f"missing_column:{c}": F.max(F.lit(0 if c in df.columns else 1)).cast("bigint") for c in REQUIRED_COLUMNS}
    present = [c for c in REQUIRED_COLUMNS if c in df.columns]
    checks |= {f"nulls:{c}": F.count_if(F.col(c).isNull()) for c in present}
    bad = {"year": (F.col("year") < 1900) | (F.col("year") > as_of_year + 1) if "year" in present else None,
           "price": F.col("price") < 0 if "price" in present else None,
           "odometer": F.col("odometer") < 0 if "odometer" in present else None}
    checks |= {f"out_of_range:{c}": F.count_if(x) for c, x in bad.items() if x is not None}
    return long_counts(df, checks)


def long_counts(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    names = list(checks)
    one = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(checks.values())])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("listings")) for i, name in enumerate(names)])))


def invalid_values(df: DataFrame, top: float = 99_999_999.99, last_year: int = 2024) -> DataFrame:
    """Overflow, negative, missing and bad-year counts, long."""
    money = [c for c in ("price", "price_original", "monthly_payment", "down_payment") if c in df.columns]
    checks = {f"overflow:{c}": F.count_if(F.col(c) > top) for c in money}
    checks |= {f"negative:{c}": F.count_if(F.col(c) < 0) for c in money}
    checks |= {f"missing:{c}": F.count_if(F.col(c).isNull()) for c in ("manufacturer", "model", "year", "price")}
    checks["bad_year"] = F.count_if((F.col("year") < 1900) | (F.col("year") > last_year))
    return long_counts(df, checks)


def make_anomalies(df: DataFrame, low_share: float = 0.1, spread: float = 3.0) -> DataFrame:
    """Listings priced below a tenth of their make's mean or above mean + 3 std."""
    stats = df.where(F.col("manufacturer").isNotNull()).groupBy("manufacturer").agg(
        F.avg("price").alias("_mean"), F.stddev_samp("price").alias("_std"))
    rows = join_on(df, stats, ["manufacturer"])
    flag = F.when(F.col("price") < F.col("_mean") * low_share, "too_low").when(
        F.col("price") > F.col("_mean") + spread * F.col("_std"), "too_high")
    return rows.withColumn("price_anomaly", flag).where(F.col("price_anomaly").isNotNull()).drop("_mean", "_std")


def numeric_metrics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per numeric column: moments, quartiles, missing rate, distinct values, IQR outliers."""
    long = long_numbers(df, columns)
    base = long.groupBy("column_name").agg(
        half_up(F.avg("value"), 4).alias("mean"), half_up(F.stddev_samp("value"), 4).alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        half_up(F.count_if(F.col("value").isNull()) / F.count("*"), 6).alias("missing_rate"))
    counts = value_counts(long, "value", ["column_name"])
    q = quantiles(counts, "_value", QUARTILES, ["column_name"], weight="_w")
    fence = (F.col("q3") - F.col("q1")) * 1.5
    outside = (F.col("_value") < F.col("q1") - fence) | (F.col("_value") > F.col("q3") + fence)
    rest = join_on(counts, q, ["column_name"]).groupBy("column_name").agg(
        half_up(F.max("q1")).alias("q1"), half_up(F.max("median")).alias("median"), half_up(F.max("q3")).alias("q3"),
        F.count("*").alias("unique_count"),
        F.coalesce(F.sum(F.when(outside, F.col("_w"))), F.lit(0).cast("bigint")).alias("outliers_count"))
    return join_on(base, rest, ["column_name"], "left")


def category_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return long_texts(df, columns).groupBy("column_name", "value").agg(F.count("*").alias("total"))


def category_metrics(df: DataFrame, columns: list[str]) -> DataFrame:
    """Per text column: distinct values, missing rate, mode, Shannon entropy (nats).

    Entropy of counts c with sum s is ln s - sum(c ln c) / s, so one group-by is enough.
    """
    counts = category_counts(df, columns)
    there = F.col("value").isNotNull()
    c = F.when(there, F.col("total"))
    known = F.sum(c)
    best = F.min(F.when(there, F.struct(-F.col("total"), F.col("value"))))["value"]
    return counts.groupBy("column_name").agg(
        F.count("value").alias("unique_count"),
        half_up(F.coalesce(F.sum(F.when(~there, F.col("total"))), F.lit(0)) / F.sum("total"), 6).alias("missing_rate"),
        best.alias("mode"), half_up(F.log(known) - F.sum(c * F.log(c)) / known, 6).alias("entropy"))


def top_values(df: DataFrame, columns: list[str], k: int = 5) -> DataFrame:
    counts = category_counts(df, columns).where(F.col("value").isNotNull())
    return top_per_group(counts, ["column_name"], "total", "value", k)


def profile(df: DataFrame) -> DataFrame:
    """Per column: type, rows, nulls, and mean, std, min and max where numeric."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    types = dict(df.dtypes)

    def figures(c: str) -> list[Column]:
        x = F.col(c).cast("double") if types[c] in numeric or types[c].startswith("decimal") else F.lit(None).cast("double")
        return [F.count_if(F.col(c).isNull()).alias(f"{c}|nulls"), half_up(F.avg(x), 4).alias(f"{c}|mean"),
                half_up(F.stddev_samp(x), 4).alias(f"{c}|std"), F.min(x).alias(f"{c}|min"), F.max(x).alias(f"{c}|max")]

    one = df.agg(F.count("*").alias("rows"), *[f for c in df.columns for f in figures(c)])
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.lit(types[c]).alias("type"), F.col("rows").alias("total_rows"),
                 *[F.col(f"`{c}|{x}`").alias(x) for x in ("nulls", "mean", "std", "min", "max")]) for c in df.columns])))
