"""Exact quantiles that never gather a group's values in one task.

``percentile`` keeps every distinct value of a group in one task's memory. Here the rows are first reduced to value
counts, the counts to totals per bucket of similar values, and only the buckets holding a wanted rank are opened. A
bucket is the leading bits of the value: its sign, its power of two and ten bits more; an opened bucket is cut again by
the next fourteen bits, and only the parts that hold a wanted rank are put in order. What meets in one task has 24
leading bits in common, wherever on the scale the values lie and however they crowd. The bits depend on the value
alone, so a retried or repeated step agrees with the first, which the edges of a sampled or merged sketch need not.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.operators.joins import join_on

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def bucket_of(value: Column) -> Column:
    """Bucket number that grows with the value, about 1 % of the value wide."""
    return F.floor(F.signum(value) * F.log2(F.abs(value) + 1) * 64)


#: Buckets of a power of two, and parts of a bucket.
_COARSE, _FINE = 1 << 10, 1 << 14


def leading_bits(value: Column) -> tuple[Column, Column]:
    """Bucket and part of the bucket, both growing with the value.

    The height above is the exponent plus the mantissa, which runs on without a step from one power of two to the next,
    so an exponent that rounding puts one off at a power of two gives the same height.
    """
    size = F.abs(value)
    power = F.floor(F.log2(size))
    height = F.when(size > 0, (power + 1100 + size / F.pow(F.lit(2.0), power) - 1) * _COARSE).otherwise(0.0) * F.signum(value)
    bucket = F.floor(height)
    return bucket, F.floor((height - bucket) * _FINE).cast("int")


def _spots(value: Column) -> list[Column]:
    bucket, part = leading_bits(value)
    return [bucket.alias("_bucket"), part.alias("_part")]


def value_counts(df: DataFrame, value: str, by: list[str], weight: str | None = None) -> DataFrame:
    """Rows per group and distinct value, with the value's bucket and part.

    With ``weight`` the rows are counts already and are only placed; a value may then
    occur in several rows, which ranks do not mind.
    """
    v = F.col(value).cast("double")
    known = df.where(F.col(value).isNotNull())
    if weight:
        return known.select(*by, *_spots(v), v.alias("_value"), F.col(weight).alias("_w"))
    counts = known.groupBy(*by, v.alias("_value")).agg(F.count("*").alias("_w"))
    return counts.select(*by, *_spots(F.col("_value")), "_value", "_w")


def _before(totals: DataFrame, by: list[str], place: str, amounts: list[str]) -> DataFrame:
    """``totals`` (one row per group and ``place``) with the total before each place and that of the group.

    The windows run over places: thousands of buckets per group, or the parts of a bucket, however many rows there are.
    """
    group = Window.partitionBy(*by)
    so_far = group.orderBy(place).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = [c for c in totals.columns if c not in (*by, place, *amounts)]
    return totals.select(
        *by, place, *kept,
        *[(F.sum(a).over(so_far) - F.col(a)).alias(f"{a}_before") for a in amounts],
        *[F.col(a).alias(f"{a}_here") for a in amounts],
        *[F.sum(a).over(group).alias(f"{a}_total") for a in amounts],
    )


def placed_parts(counts: DataFrame, by: list[str], amounts: list[str]) -> DataFrame:
    """For every part of every bucket: the totals before it (``_before``) and of its group (``_total``)."""
    parts = counts.groupBy(*by, "_bucket", "_part").agg(*[F.sum(a).alias(a) for a in amounts])
    buckets = _before(parts.groupBy(*by, "_bucket").agg(*[F.sum(a).alias(a) for a in amounts]), by, "_bucket", amounts)
    inner = _before(parts, [*by, "_bucket"], "_part", amounts)
    outer = buckets.select(*by, "_bucket", *[F.col(f"{a}_before").alias(f"{a}_outer") for a in amounts], *[f"{a}_total" for a in amounts])
    inner = inner.select(*by, "_bucket", "_part", *[F.col(f"{a}_before").alias(f"{a}_inner") for a in amounts])
    both = join_on(inner, outer, [*by, "_bucket"], nulls_match=bool(by))
    return both.select(*by, "_bucket", "_part", *[(F.col(f"{a}_outer") + F.col(f"{a}_inner")).alias(f"{a}_before") for a in amounts],
                       *[f"{a}_total" for a in amounts])


def values_at_ranks(df: DataFrame, value: str, ranks, by: list[str] | None = None,
                    weight: str | None = None) -> DataFrame:
    """Distinct values covering the wanted 0-based ranks.

    ``ranks`` maps the group total to an array of ranks. Each row tells the ranks it
    covers: from ``_first`` up to but not including ``_next``.
    """
    by = by or []
    counts = value_counts(df, value, by, weight)

    def holding(places: DataFrame) -> DataFrame:
        return places.where(F.exists(ranks(F.col("_n")), lambda x: (x >= F.col("_from")) & (x < F.col("_from") + F.col("_w_here"))))

    buckets = _before(counts.groupBy(*by, "_bucket").agg(F.sum("_w").alias("_w")), by, "_bucket", ["_w"])
    buckets = holding(buckets.withColumnsRenamed({"_w_before": "_from", "_w_total": "_n"})).drop("_w_here")
    near = join_on(counts, buckets, [*by, "_bucket"], nulls_match=bool(by))
    parts = near.groupBy(*by, "_bucket", "_part").agg(F.sum("_w").alias("_w"), F.max("_n").alias("_n"), F.max("_from").alias("_outer"))
    parts = _before(parts, [*by, "_bucket"], "_part", ["_w"]).withColumn("_from", F.col("_outer") + F.col("_w_before"))
    parts = holding(parts).select(*by, "_bucket", "_part", "_from")
    near = join_on(near.drop("_from"), parts, [*by, "_bucket", "_part"], nulls_match=bool(by))
    running = F.sum("_w").over(
        Window.partitionBy(*by, "_bucket", "_part").orderBy("_value")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    upto = F.col("_from") + running
    return near.select(*by, "_n", "_value", (upto - F.col("_w")).alias("_first"), upto.alias("_next"))


def quantiles(df: DataFrame, value: str, wanted: dict[str, float], by: list[str] | None = None,
              weight: str | None = None) -> DataFrame:
    """Interpolated quantiles (``percentile_cont``) of ``value``, one row per group.

    Nulls are left out. ``weight`` is a whole-number row count, for pre-counted input.
    """
    by = by or []
    spot = {k: F.lit(float(p)) * (F.col("_n") - 1) for k, p in wanted.items()}

    def ranks(total: Column) -> Column:
        places = [F.lit(float(p)) * (total - 1) for p in wanted.values()]
        return F.array(*[F.floor(x) for x in places], *[F.ceil(x) for x in places])

    found = values_at_ranks(df, value, ranks, by, weight)
    picks = [F.max("_n").alias("_n")]
    for k, x in spot.items():
        for side, rank in (("lo", F.floor(x)), ("hi", F.ceil(x))):
            covers = (F.col("_first") <= rank) & (rank < F.col("_next"))
            picks.append(F.max(F.when(covers, F.col("_value"))).alias(f"_{side}_{k}"))
    rows = found.groupBy(*by).agg(*picks)
    return rows.select(
        *by,
        *[(F.col(f"_lo_{k}") + (F.col(f"_hi_{k}") - F.col(f"_lo_{k}")) * (x - F.floor(x))).alias(k)
          for k, x in spot.items()],
    )


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a scalar subquery: read its columns with ``one_row(df)["name"]``."""
    return df.select(F.struct("*")).scalar()


def quantile_values(df: DataFrame, value: str, wanted: dict[str, float]) -> Column:
    """Whole-table quantiles as one scalar struct."""
    return one_row(quantiles(df, value, wanted))


def absolute_deviation(df: DataFrame, value: str, by: list[str] | None = None,
                       name: str = "mad") -> DataFrame:
    """Median absolute deviation per group, on value counts instead of rows."""
    by = by or []
    counts = value_counts(df, value, by)
    if by:
        centre = quantiles(df, value, {"_mid": 0.5}, by)
        spread = join_on(counts, centre, by, nulls_match=True)
        middle = F.col("_mid")
    else:
        spread, middle = counts, quantile_values(df, value, {"_mid": 0.5})["_mid"]
    return quantiles(spread.withColumn("_gap", F.abs(F.col("_value") - middle)),
                     "_gap", {name: 0.5}, by, weight="_w")


def any_of(conditions: list[Column]) -> Column:
    return reduce(or_, conditions)
