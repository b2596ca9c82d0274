"""Market structure: limits by make, competition, concentration, positioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from forecourt.functions.numbers import half_up, ratio
from forecourt.functions.tails import t_p
from forecourt.operators.aggregates import share_of_total, summarise, top_per_group
from forecourt.operators.joins import join_on
from forecourt.operators.quantiles import bucket_of, quantiles, value_counts
from forecourt.schema import AUDIT_DEFAULT_LIMITS, AUDIT_LIMITS


def limit_of(make: Column, limits: dict[str, tuple], default: tuple, side: int) -> Column:
    """Lower (side 0) or upper (side 1) price limit of a make."""
    table = F.create_map(*[F.lit(x) for k, v in limits.items() for x in (k, float(v[side]))])
    return F.coalesce(F.try_element_at(table, F.lower(make)), F.lit(float(default[side])))


def prices_under_make_limit(df: DataFrame, min_count: int = 10) -> DataFrame:
    """Price figures by make over listings not above the make's upper limit."""
    top = limit_of(F.col("manufacturer"), AUDIT_LIMITS, AUDIT_DEFAULT_LIMITS, 1)
    rows = df.where(F.col("manufacturer").isNotNull() & (F.col("price") <= top))
    return summarise(rows, ["manufacturer"], ["total_listings", "avg_price", "min_price", "max_price"],
                     min_count=min_count)


def top_keys_remeasured(df: DataFrame, key: str, k: int, max_km: float = 1_000_000) -> DataFrame:
    """Top-k keys over all listings, measured over those with a plausible odometer.

    One pass: the count over everything and the conditional averages come from the same
    group-by, which equals joining the top-k list back to the listings.
    """
    ok = F.col("odometer").between(0, max_km)
    figures = df.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.count("*").alias("total_listings"),
        half_up(F.avg(F.when(ok, F.col("odometer")))).alias("avg_mileage"),
        half_up(F.avg(F.when(ok, F.col("price")))).alias("avg_price"),
        F.count_if(ok).alias("_measured"),
    )
    best = figures.orderBy(F.desc("total_listings"), key).limit(k)
    return best.where(F.col("_measured") > 0).drop("_measured")


def concentration(df: DataFrame, segment: str, brand: str, k: int = 3) -> DataFrame:
    """Per segment: listings, distinct brands and models, share of the k largest brands."""
    sizes = df.where(F.col(segment).isNotNull()).groupBy(segment, brand).agg(F.count("*").alias("_n"))
    largest = top_per_group(sizes.where(F.col(brand).isNotNull()), [segment], "_n", brand, k)
    largest = largest.groupBy(segment).agg(F.sum("_n").alias("_top"))
    figures = df.where(F.col(segment).isNotNull()).groupBy(segment).agg(
        F.count("*").alias("total_listings"),
        F.count_distinct(brand).alias("distinct_makes"),
        F.count_distinct("model").alias("distinct_models"),
        half_up(F.avg("price")).alias("avg_price"),
        half_up(F.stddev_samp("price")).alias("std_price"),
        F.min("price").alias("min_price"), F.max("price").alias("max_price"),
    )
    both = join_on(figures, largest, [segment], "left")
    return both.withColumn("concentration", half_up(ratio(F.col("_top"), F.col("total_listings")), 3)).drop("_top")


def competition(df: DataFrame) -> DataFrame:
    """For every make: share, price quartiles and the other makes priced inside them.

    Works on counts per (make, price bucket). A bucket wholly inside a make's band adds
    its totals; only the two buckets at the band's ends are looked at price by price. Both
    steps are equi joins on the bucket, and listings are never paired with listings.
    """
    makes = df.where(F.col("manufacturer").isNotNull())
    bounds = quantiles(makes, "price", {"q1": 0.25, "q3": 0.75}, ["manufacturer"])
    own = makes.groupBy("manufacturer").agg(
        F.count("*").alias("total_listings"), half_up(F.avg("price")).alias("avg_price"))
    counts = value_counts(makes, "price", ["manufacturer"]).withColumn("_bucket", bucket_of(F.col("_value")))
    totals = counts.groupBy("manufacturer", "_bucket").agg(
        F.sum("_w").alias("_n"), F.sum(F.col("_value") * F.col("_w")).alias("_sum"))
    bands = bounds.select(F.col("manufacturer").alias("target"), "q1", "q3",
                          bucket_of(F.col("q1")).alias("_from"), bucket_of(F.col("q3")).alias("_to"))
    inner = bands.where(F.col("_to") - F.col("_from") > 1).select(
        "target", F.explode(F.sequence(F.col("_from") + 1, F.col("_to") - 1)).alias("_bucket"))
    ends = bands.select("target", "q1", "q3",
                        F.explode(F.array_distinct(F.array("_from", "_to"))).alias("_bucket"))
    whole = inner.join(totals, "_bucket").select("target", "manufacturer", "_n", "_sum")
    partial = ends.join(counts, "_bucket").where(F.col("_value").between(F.col("q1"), F.col("q3"))).select(
        "target", "manufacturer", F.col("_w").alias("_n"), (F.col("_value") * F.col("_w")).alias("_sum"))
    pairs = whole.unionByName(partial).where(F.col("target") != F.col("manufacturer")).groupBy(
        "target", "manufacturer").agg(F.sum("_n").alias("_n"), F.sum("_sum").alias("_sum"))
    rivals = pairs.groupBy(F.col("target").alias("manufacturer")).agg(
        F.count("*").alias("direct_competitors"),
        F.sum("_n").alias("competitor_listings"),
        half_up(F.sum("_sum") / F.sum("_n")).alias("avg_competitor_price"),
    )
    total = df.agg(F.count("*").alias("n")).scalar()
    out = join_on(join_on(own, bounds, ["manufacturer"], "left"), rivals, ["manufacturer"], "left")
    return out.select(
        "manufacturer", "total_listings", half_up(F.col("total_listings") / total, 4).alias("market_share"),
        "avg_price", half_up("q1").alias("q1"), half_up("q3").alias("q3"),
        "direct_competitors", "competitor_listings", "avg_competitor_price",
    )


def closest_rivals(df: DataFrame, target: str, k: int = 5) -> DataFrame:
    """Makes with most listings inside the target make's price quartiles."""
    bounds = quantiles(df.where(F.col("manufacturer") == target), "price", {"q1": 0.25, "q3": 0.75})
    band = bounds.select(F.struct("*")).scalar()
    rows = df.where((F.col("manufacturer") != target) & F.col("price").between(band["q1"], band["q3"]))
    return rows.groupBy("manufacturer").agg(F.count("*").alias("listings")).orderBy(
        F.desc("listings"), "manufacturer").limit(k)


def positioning(df: DataFrame, target: str) -> DataFrame:
    """Where the target make's median price stands among the other makes' prices.

    Percentile of score counts half of the ties; t is the pooled two-sample statistic.
    """
    median = quantiles(df.where(F.col("manufacturer") == target), "price", {"m": 0.5}).scalar()
    price, own = F.col("price"), F.col("manufacturer") == target
    rows = df.where(F.col("manufacturer").isNotNull() & price.isNotNull())
    mine, theirs = F.when(own, price), F.when(~own, price)
    s = rows.agg(
        F.avg(mine).alias("m1"), F.avg(theirs).alias("m2"),
        F.var_samp(mine).alias("v1"), F.var_samp(theirs).alias("v2"),
        F.count(mine).alias("n1"), F.count(theirs).alias("n2"),
        F.count_if(~own & (price < median)).alias("below"),
        F.count_if(~own & (price <= median)).alias("upto"),
    )
    free = F.col("n1") + F.col("n2") - 2
    pooled = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / free
    spot = (F.col("below") + F.col("upto")) * 50.0 / F.col("n2")
    gap = F.col("m1") - F.col("m2")
    t = gap / F.sqrt(pooled * (1 / F.col("n1") + 1 / F.col("n2")))
    s = s.withColumn("_p", t_p(t, free))  # one row
    return s.select(
        F.lit(target).alias("manufacturer"),
        half_up(gap).alias("price_difference"),
        half_up(gap / F.col("m2") * 100).alias("price_difference_pct"),
        half_up(t, 4).alias("t_statistic"),
        free.alias("degrees_of_freedom"),
        F.col("_p").alias("p_value"),
        (F.col("_p") < 0.05).alias("is_significant"),
        half_up(spot, 4).alias("market_percentile"),
        F.when(spot > 75, "premium").when(spot > 25, "competitive").otherwise("economic").alias("positioning"),
    )


def average_step(df: DataFrame, as_of_year: int) -> DataFrame:
    """Year-over-year change of the average price; a missing year gives null."""
    by_year = df.where(F.col("year").isNotNull()).groupBy("year").agg(F.avg("price").alias("_avg"))
    w = Window.orderBy("year")  # one row per model year
    before = F.when(F.lag("year").over(w) == F.col("year") - 1, F.lag("_avg").over(w))
    return by_year.where(F.col("year") <= as_of_year).select(
        "year", half_up("_avg").alias("avg_price"),
        half_up(ratio(F.col("_avg") - before, before) * 100).alias("change_pct"))


def share(df: DataFrame, by: str, only: list[str] | None = None) -> DataFrame:
    rows = df.where(F.col(by).isin(only)) if only else df.where(F.col(by).isNotNull())
    return share_of_total(rows.groupBy(by).agg(F.count("*").alias("total")), "total")


def flag_against_year(df: DataFrame, fence: float = 1.5) -> DataFrame:
    """Each listing against the quartile fence of its model year."""
    q = quantiles(df, "price", {"_q1": 0.25, "_q3": 0.75}, ["year"])
    gap = (F.col("_q3") - F.col("_q1")) * fence
    outside = (F.col("price") < F.col("_q1") - gap) | (F.col("price") > F.col("_q3") + gap)
    flag = F.when(outside, "Outlier").otherwise("Normal")
    return join_on(df, q, ["year"]).withColumn("price_flag", flag).drop("_q1", "_q3")
