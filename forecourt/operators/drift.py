"""Drift between a reference and a current set of listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from forecourt.functions.tails import chi_square_p, ks_p
from forecourt.operators.joins import join_on
from forecourt.operators.quantiles import leading_bits, placed_parts


def long_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, value) rows of numeric columns."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "column_name", "value")


def long_texts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], columns, "column_name", "value")


def numeric_drift(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Largest gap between the two cumulative shares (two-sample KS) per column.

    Both sides are reduced to counts per distinct value. Each value's running count is the
    total before its part of a bucket plus the running count within the part, so the global order
    needs no task that sees a whole column.
    """
    sides = long_numbers(reference, columns).withColumn("_side", F.lit(0)).unionByName(
        long_numbers(current, columns).withColumn("_side", F.lit(1))).where(F.col("value").isNotNull())
    counts = sides.groupBy("column_name", F.col("value").alias("_value")).agg(
        F.count_if(F.col("_side") == 0).alias("_ref"), F.count_if(F.col("_side") == 1).alias("_cur"))
    bucket, part = leading_bits(F.col("_value"))
    counts = counts.withColumns({"_bucket": bucket, "_part": part})
    near = join_on(counts, placed_parts(counts, ["column_name"], ["_ref", "_cur"]), ["column_name", "_bucket", "_part"])
    upto = Window.partitionBy("column_name", "_bucket", "_part").orderBy("_value").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    share = {s: (F.col(f"{s}_before") + F.sum(s).over(upto)) / F.col(f"{s}_total") for s in ("_ref", "_cur")}
    gaps = near.select("column_name", F.abs(share["_ref"] - share["_cur"]).alias("_gap"), "_ref_total", "_cur_total")
    return gaps.groupBy("column_name").agg(
        F.max("_gap").alias("statistic"), F.max("_ref_total").alias("reference_rows"),
        F.max("_cur_total").alias("current_rows"))


def chi_square(cells: DataFrame, by: list[str], row: str, column: str, amount: str) -> DataFrame:
    """Chi-square of each group's row x column table of counts (missing cells are 0).

    With one degree of freedom Yates' correction applies. Runs over cells, not listings.
    A missing cell adds its expected count, which is the row total times the column total
    over the grand total; summed that is what the present cells leave of the grand total.
    """
    # totals are aggregated and joined back, so no task holds all cells of a column
    c = cells
    for name, keys in (("_r", [*by, row]), ("_c", [*by, column]), ("_t", by)):
        c = join_on(c, cells.groupBy(*keys).agg(F.sum(amount).alias(name)), keys, nulls_match=True)
    expected = F.col("_r") * F.col("_c") / F.col("_t")
    gap = F.abs(F.col(amount) - expected)
    figures = c.groupBy(*by).agg(
        F.sum(gap * gap / expected).alias("_plain"), F.sum(expected).alias("_seen"), F.max("_t").alias("_t"),
        F.sum(F.pow(gap - F.least(gap, F.lit(0.5)), 2) / expected).alias("_eased"),
        F.count_distinct(row).alias("_rows"), F.count_distinct(column).alias("_columns"), F.count("*").alias("_cells"))
    freedom = (F.col("_rows") - 1) * (F.col("_columns") - 1)
    missing = F.col("_t") - F.col("_seen")
    # of a 2 x 2 table one cell can be absent, or the two of a diagonal with equal expectation
    absent = 4 - F.col("_cells")
    each = missing / F.nullif(absent, F.lit(0))
    eased = F.coalesce(absent * F.pow(each - F.least(each, F.lit(0.5)), 2) / F.nullif(each, F.lit(0.0)), F.lit(0.0))
    return figures.select(
        *by, F.when(freedom == 1, F.col("_eased") + eased).otherwise(F.col("_plain") + missing).alias("statistic"),
        freedom.alias("degrees_of_freedom"))


def aligned_counts(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    """Category counts of both sides, 0 where a side lacks the category."""
    def counted(df: DataFrame, name: str) -> DataFrame:
        return long_texts(df, columns).where(F.col("value").isNotNull()).groupBy("column_name", "value").agg(
            F.count("*").alias(name))

    both = join_on(counted(reference, "reference"), counted(current, "current"), ["column_name", "value"], "full")
    return both.fillna(0, subset=["reference", "current"])


def category_drift(reference: DataFrame, current: DataFrame, columns: list[str]) -> DataFrame:
    counts = aligned_counts(reference, current, columns)
    cells = counts.unpivot(["column_name", "value"], ["reference", "current"], "_side", "_n")
    return chi_square(cells, ["column_name"], "_side", "value", "_n")


def drift_report(reference: DataFrame, current: DataFrame, numeric: list[str], categorical: list[str],
                 threshold: float = 0.05) -> DataFrame:
    """Statistic, probability and verdict per column."""
    ks = numeric_drift(reference, current, numeric)
    ks = ks.select("column_name", F.lit("ks").alias("test"), "statistic",
                   ks_p(F.col("statistic"), F.col("reference_rows"), F.col("current_rows")).alias("p_value"))
    chi = category_drift(reference, current, categorical)
    chi = chi.select("column_name", F.lit("chi_square").alias("test"), "statistic",
                     chi_square_p(F.col("statistic"), F.col("degrees_of_freedom")).alias("p_value"))
    return ks.unionByName(chi).withColumn("has_drift", F.col("p_value") < threshold)


def associations(df: DataFrame, target: str, others: list[str], alpha: float = 0.05) -> DataFrame:
    """Chi-square between ``target`` and each other column, nulls counted as MISSING."""
    filled = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("MISSING")).alias(c) for c in [target, *others]])
    pairs = filled.unpivot([target], others, "column_name", "value")
    cells = pairs.groupBy("column_name", target, "value").agg(F.count("*").alias("_n"))
    out = chi_square(cells, ["column_name"], target, "value", "_n")
    p = chi_square_p(F.col("statistic"), F.col("degrees_of_freedom"))
    return out.withColumn("p_value", p).withColumn("is_associated", F.col("p_value") < alpha)
