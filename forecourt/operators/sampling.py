"""Repeatable samples: the same rows on every run, partitioning and retry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.operators.joins import join_on, known_size


def lot(seed: int, *columns: str) -> Column:
    """Pseudo-random number in [0, 1) drawn from the row's own key."""
    return F.shiftrightunsigned(F.xxhash64(*columns, F.lit(seed)), 11) / float(1 << 53)


def split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows, by the key's lot."""
    marked = lot(seed, key) < share
    return df.where(marked), df.where(~marked)


def bounded_sample(df: DataFrame, key: str, size: int = 5000, seed: int = 42) -> DataFrame:
    """``size`` random rows: the lowest lots.

    Rows are cut by lot first, at a share that leaves a little more than ``size`` of the whole table,
    so that what meets for the final order does not grow with the number of partitions.
    """
    rows, mark = df.count(), lot(seed, key)
    near, share = df, (size + 10 * size ** 0.5 + 20) / max(rows, 1)
    while share < 1:
        near = df.where(mark <= share)
        if near.count() >= size:
            break
        near, share = df, 2 * share
    return near.orderBy(mark, key).limit(size)


def quotas(strata: DataFrame, size: int, amount: str = "_n") -> DataFrame:
    """Sample size per stratum, proportional, trimmed so that the sum is at most ``size``.

    The excess from rounding is taken one by one from whichever stratum is then largest.
    That levels the largest strata, and the level follows from the running sum over the
    distinct sizes, so nothing is looped.
    """
    total = strata.agg(F.sum(amount).alias("n")).first().n or 1
    sized = strata.withColumn("quota", F.bround(F.col(amount) / total * size).cast("bigint"))
    levels = sized.groupBy(F.col("quota").alias("_size")).agg(F.count("*").alias("_c"))
    down = Window.orderBy(F.desc("_size"))
    run = down.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    stairs = levels.select(
        "_size", F.sum("_c").over(run).alias("_strata"), F.sum(F.col("_c") * F.col("_size")).over(run).alias("_sum"),
        F.coalesce(F.lead("_size").over(down), F.lit(0)).alias("_below"),
        (F.sum(F.col("_c") * F.col("_size")).over(Window.partitionBy()) - size).alias("_excess"))
    # the highest step on which the strata above it can give up the whole excess
    step = stairs.where(F.col("_sum") - F.col("_strata") * F.col("_below") >= F.col("_excess")).orderBy(
        F.desc("_size")).first()
    if step is None or step["_excess"] <= 0:
        return sized
    level, over = divmod(step["_sum"] - step["_excess"], step["_strata"])
    keys = [c for c in strata.columns if c != amount]
    place = F.row_number().over(Window.orderBy(F.desc(amount), *keys))
    # the first strata are lowered first, so the ones left one above the level are the last
    high = sized.where(F.col("quota") > step["_below"]).withColumn("_place", place)
    lowered = high.withColumn("quota", F.when(F.col("_place") > step["_strata"] - over, level + 1).otherwise(level).cast("bigint"))
    return lowered.drop("_place").unionByName(sized.where(F.col("quota") <= step["_below"]))


def stratified_sample(df: DataFrame, strata: list[str], key: str, size: int = 100_000, seed: int = 42, margin: float = 10) -> DataFrame:
    """Random rows per stratum up to its quota; null is a stratum value of its own.

    Rows whose lot is far above the stratum's share are dropped before any shuffle, so only
    about ``size`` rows are ranked however large a stratum is. The ``margin`` is in standard
    deviations; the rows left are counted, and if a stratum should lack some of its quota all rows are ranked.
    Rows, strata and the rows left are written, as each is read more than once.
    """
    df = known_size(df)
    counts = known_size(df.groupBy(*strata).agg(F.count("*").alias("_n")))
    wanted = known_size(quotas(counts, size))
    rows = join_on(df.withColumn("_lot", lot(seed, key)), wanted, strata, nulls_match=True)
    q = F.col("quota")
    near = known_size(rows.where(F.col("_lot") * F.col("_n") <= q + margin * F.sqrt(q.cast("double")) + 2 * margin))
    left = near.groupBy(*strata).agg(F.count("*").alias("_left"))
    full = join_on(wanted.where(q > 0), left, strata, "left", nulls_match=True)
    if not full.where(F.coalesce("_left", F.lit(0)) < F.least(q, F.col("_n"))).isEmpty():
        near = rows
    place = F.row_number().over(Window.partitionBy(*strata).orderBy("_lot", key))
    return near.withColumn("_place", place).where(F.col("_place") <= q).drop("_lot", "_place", "_n", "quota")
