"""Financing terms: repair, refresh and comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.numbers import half_up
from forecourt.operators.aggregates import summarise
from forecourt.operators.cleaning import search
from forecourt.operators.joins import join_on

FINANCE = ["total_listings", "total_financed", "financing_percentage",
           "avg_monthly_payment", "avg_down_payment", "avg_installments"]

# Labels and upper edges of the closed-above price ranges in R$.
REAL_RANGES = [("Até R$ 50.000", 50000), ("R$ 50.001 - R$ 100.000", 100000),
               ("R$ 100.001 - R$ 150.000", 150000), ("R$ 150.001 - R$ 200.000", 200000)]
REAL_ABOVE = "Acima de R$ 200.000"

# Labels and lower edges of the half-open price ranges in $.
DOLLAR_RANGES = [("Under $10k", 0, 10000), ("$10k-$20k", 10000, 20000), ("$20k-$30k", 20000, 30000),
                 ("$30k-$50k", 30000, 50000), ("Over $50k", 50000, float("inf"))]


def real_range(price: Column) -> Column:
    """Closed-above range of a price; everything up to the first edge is in the first range."""
    out = F.lit(REAL_ABOVE)
    for label, top in reversed(REAL_RANGES):
        out = F.when(price <= top, label).otherwise(out)
    return F.when(price.isNotNull(), out)


def dollar_range(price: Column) -> Column:
    """Half-open range [low, high) of a price."""
    out = F.lit(None).cast("string")
    for label, low, high in DOLLAR_RANGES:
        out = F.when((price >= low) & (price < high), label).otherwise(out)
    return out


def repair_installments(df: DataFrame) -> DataFrame:
    """Recompute the financing flag and mend its terms.

    A listing is financed if its payment is above 0 and below the price. Missing down
    payments become 20 % of the price, missing terms 48, terms are held within 12..60, and
    a payment above a twelfth of the financed sum is that sum over the term.
    """
    price, monthly = F.col("price").try_cast("double"), F.col("monthly_payment").try_cast("double")
    flag = F.coalesce((monthly > 0) & (monthly < price), F.lit(False))
    down = F.coalesce(F.col("down_payment").try_cast("double"), price * 0.2)
    term = F.least(F.greatest(F.coalesce(F.col("installments").cast("double"), F.lit(48.0)), F.lit(12.0)), F.lit(60.0))
    owed = price - down
    payment = F.when(monthly > owed / 12, owed / term).otherwise(monthly)
    return df.withColumns({
        "price": price, "has_installments": flag, "monthly_payment": F.when(flag, payment),
        "down_payment": F.when(flag, down), "installments": F.when(flag, term.cast("int"))})


def zero_unfinanced(df: DataFrame) -> DataFrame:
    """Terms as stored: 0 without financing, missing payments 0, a missing term 48."""
    def stored(column: str, missing: float) -> Column:
        return F.when(F.col("has_installments"), F.coalesce(column, F.lit(missing))).otherwise(F.lit(missing) * 0)

    return df.withColumns({
        "monthly_payment": stored("monthly_payment", 0.0), "down_payment": stored("down_payment", 0.0),
        "installments": stored("installments", 48).cast("int")})


def refreshed_stats(stored: DataFrame, df: DataFrame, key: str) -> DataFrame:
    """Stored per-key statistics with their financing columns recomputed.

    One conditional aggregate instead of a correlated subquery per column.
    """
    fresh = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count_if("has_installments").alias("total_installment_cars"),
        *[half_up(F.avg(F.when(F.col("has_installments"), F.col(c)))).alias(f"avg_{c}")
          for c in ("monthly_payment", "down_payment", "installments")])
    return join_on(stored, fresh, [key], "left").withColumn(
        "total_installment_cars", F.coalesce("total_installment_cars", F.lit(0).cast("bigint")))


def served_stats(listings: DataFrame, stored: DataFrame, by: list[str], names: list[str], **filters) -> DataFrame:
    """Stored statistics as they are if nothing is asked of the listings, else computed from those that fit."""
    if all(v is None for v in filters.values()):
        return stored.select(*by, *names)
    return zero_averages(summarise(search(listings, **filters), by, names))


def installment_stats(df: DataFrame) -> DataFrame:
    """Financing figures by make, model and year with the change from the original price."""
    now, before = F.avg("price"), F.avg("price_original")
    return summarise(
        df, ["manufacturer", "model", "year"],
        ["total_listings", "total_financed", "avg_monthly_payment", "avg_down_payment", "avg_installments"],
        avg_total_price=half_up(now), avg_original_price=half_up(before),
        price_difference_percent=F.when(before > 0, half_up((now - before) / before * 100)).otherwise(F.lit(0.0)))


def terms_summary(df: DataFrame) -> DataFrame:
    """Average, minimum and maximum of payment, down payment and term of financed listings."""
    rows = df.where(F.col("has_installments"))
    aggs = []
    for name, column in (("monthly", "monthly_payment"), ("down", "down_payment"), ("term", "installments")):
        aggs += [F.coalesce(half_up(F.avg(column)), F.lit(0.0)).alias(f"avg_{name}"),
                 F.coalesce(F.min(column), F.lit(0)).alias(f"min_{name}"),
                 F.coalesce(F.max(column), F.lit(0)).alias(f"max_{name}")]
    return rows.agg(*aggs)


def zero_averages(df: DataFrame) -> DataFrame:
    """Missing averages as 0, the way the figures are served."""
    return df.fillna(0, subset=[c for c in df.columns if c.startswith("avg_")])


def consistency(df: DataFrame) -> DataFrame:
    """Per listing: what is wrong with its financing terms, null when nothing is."""
    flag = F.col("has_installments")
    missing = F.coalesce(F.col("monthly_payment") == 0, F.lit(True)) | F.coalesce(F.col("installments") == 0, F.lit(True))
    owed = F.col("monthly_payment") * F.col("installments") + F.col("down_payment")
    return df.withColumn("financing_problem", F.when(flag & missing, "missing_terms").when(
        flag & (F.abs(F.col("price") - owed) > 0.01), "price_mismatch"))


