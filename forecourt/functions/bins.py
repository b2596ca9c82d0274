"""Bins: fixed width, by quantile, histogram."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.operators.quantiles import one_row, quantile_values


def equal_width(df: DataFrame, column: str, bins: int, labels: list[str] | None = None, name: str = "bin") -> DataFrame:
    """Right-closed bins of equal width over the column's range; the minimum is in the first.

    Bin numbers start at 0; with ``labels`` their names are used.
    """
    span = one_row(df.agg(F.min(column).cast("double").alias("lo"), F.max(column).cast("double").alias("hi")))
    placed = df.withColumn("_span", span)
    lo, hi, x = F.col("_span.lo"), F.col("_span.hi"), F.col(column)
    names = [F.lit(v) for v in labels] if labels else [F.lit(i) for i in range(bins)]
    number = names[-1]
    for i in range(bins - 1, 0, -1):
        number = F.when(x <= lo + (hi - lo) / bins * i, names[i - 1]).otherwise(number)
    return placed.withColumn(name, F.when(x.isNotNull(), number)).drop("_span")


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Counts per bin, bins closed below and the last closed on both sides; empty bins are 0."""
    x = F.col(column)
    span = one_row(df.agg(F.min(x).cast("double").alias("lo"), F.max(x).cast("double").alias("hi")))
    rows = df.where(x.isNotNull()).withColumn("_span", span)
    lo, width = F.col("_span.lo"), (F.col("_span.hi") - F.col("_span.lo")) / bins
    number = F.least(F.floor((x - lo) / F.when(width == 0, 1.0).otherwise(width)), F.lit(bins - 1))
    counts = rows.groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("listings"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").withColumn("listings", F.coalesce("listings", F.lit(0).cast("bigint")))


def by_quantile(df: DataFrame, column: str, labels: list[str], name: str = "band") -> DataFrame:
    """Bins between quantile edges, right closed; equal values always share a bin."""
    count = len(labels)
    edges = quantile_values(df, column, {f"e{i}": i / count for i in range(1, count)})
    out: Column = F.lit(labels[-1])
    rows = df.withColumn("_edges", edges)
    for i in range(count - 1, 0, -1):
        out = F.when(F.col(column) <= F.col(f"_edges.e{i}"), labels[i - 1]).otherwise(out)
    return rows.withColumn(name, F.when(F.col(column).isNotNull(), out)).drop("_edges")
