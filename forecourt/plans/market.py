"""Market questions: prices, volumes, shares, rankings, pivots."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.functions.numbers import half_up, ratio
from forecourt.operators import market as mk
from forecourt.operators.aggregates import (
    group_mode, pivot_means, retention, share_of_total, summarise, top_counts, top_per_group, with_medians)
from forecourt.operators.joins import join_on, keep_frequent
from forecourt.operators.quantiles import one_row, quantiles
from forecourt.plans.registry import m, n, query, r

PRICED = "price BETWEEN 100 AND 1000000"
AS_OF = "DATE '2002-01-01'"
AS_OF_YEAR = 2002
PRICES = ["total_listings", "avg_price", "min_price", "max_price"]


def priced(df):
    return df.where(F.col("price").between(100, 1_000_000))


@query("price_by_make", "AG1 SF14", f"""SELECT manufacturer, {m('total_listings avg_price min_price max_price')}
FROM listings WHERE manufacturer IS NOT NULL AND {PRICED} GROUP BY 1""")
def _(k):
    return summarise(priced(k.listings("manufacturer", "price")), ["manufacturer"], PRICES, drop_null_keys=True)


@query("price_by_make_top10", "AG1 SL1", f"""SELECT manufacturer, {m('total_listings avg_price')}
FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1 ORDER BY total_listings DESC, 1 LIMIT 10""")
def _(k):
    return summarise(k.listings("manufacturer", "price"), ["manufacturer"], ["total_listings", "avg_price"],
                     drop_null_keys=True, order="total_listings", top=10)


@query("top_models_mileage", "AG2 SL1", f"""SELECT model, {m('total_listings avg_mileage avg_price')} FROM listings
WHERE model IS NOT NULL GROUP BY 1 ORDER BY total_listings DESC, model LIMIT 5""")
def _(k):
    return summarise(k.listings("model", "price", "odometer"), ["model"],
                     ["total_listings", "avg_mileage", "avg_price"], drop_null_keys=True,
                     order="total_listings", top=5)


@query("top_fuels_mileage", "AG3", f"""SELECT fuel, {m('total_listings avg_mileage avg_price')} FROM listings
WHERE fuel IS NOT NULL GROUP BY 1 ORDER BY total_listings DESC, 1 LIMIT 3""")
def _(k):
    return summarise(k.listings("fuel", "price", "odometer"), ["fuel"],
                     ["total_listings", "avg_mileage", "avg_price"], drop_null_keys=True,
                     order="total_listings", top=3)


@query("top_regions_by_price", "AG4", f"""SELECT region, {m('total_listings avg_price min_price max_price')} FROM listings
WHERE region IS NOT NULL AND {PRICED} GROUP BY 1 ORDER BY avg_price DESC, region LIMIT 5""")
def _(k):
    return summarise(priced(k.listings("region", "price")), ["region"], PRICES, drop_null_keys=True,
                     order="avg_price", top=5)


@query("top_states_by_price", "AG5", f"""SELECT state, {m('total_listings avg_price min_price max_price')} FROM listings
WHERE price IS NOT NULL GROUP BY 1 HAVING count(*) >= 10 ORDER BY avg_price DESC, state LIMIT 5""")
def _(k):
    return summarise(k.listings("state", "price").where(F.col("price").isNotNull()), ["state"], PRICES,
                     min_count=10, order="avg_price", top=5)


@query("make_prices_over_ten", "AG6", f"""SELECT manufacturer, {m('total_listings avg_price min_price max_price')}
FROM listings WHERE price IS NOT NULL GROUP BY 1 HAVING count(*) > 10""")
def _(k):
    return summarise(k.listings("manufacturer", "price").where(F.col("price").isNotNull()), ["manufacturer"],
                     PRICES, min_count=11)


@query("top_make_models", "AG7", f"""SELECT manufacturer, model, {m('total_listings avg_price avg_mileage')}
FROM listings WHERE manufacturer IS NOT NULL AND model IS NOT NULL GROUP BY 1, 2
ORDER BY total_listings DESC, 1, 2 LIMIT 10""")
def _(k):
    return summarise(k.listings("manufacturer", "model", "price", "odometer"), ["manufacturer", "model"],
                     ["total_listings", "avg_price", "avg_mileage"], drop_null_keys=True,
                     order="total_listings", top=10)


def _remeasured_sql(key, k):
    return f"""WITH best AS (SELECT {key}, {n()} AS total_listings FROM listings WHERE {key} IS NOT NULL
GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT {k})
SELECT b.{key}, total_listings, {r('avg(odometer)')} AS avg_mileage, {r('avg(price)')} AS avg_price
FROM best b JOIN listings l ON b.{key} = l.{key} WHERE odometer BETWEEN 0 AND 1000000 GROUP BY 1, 2"""


@query("top_models_remeasured", "JN1 JN9", _remeasured_sql("model", 5))
def _(k):
    return mk.top_keys_remeasured(k.listings("model", "price", "odometer"), "model", 5)


@query("top_fuels_remeasured", "JN2", _remeasured_sql("fuel", 3))
def _(k):
    return mk.top_keys_remeasured(k.listings("fuel", "price", "odometer"), "fuel", 3)


@query("transmission_split", "JN3", f"""WITH c AS (SELECT transmission, {n()} AS total FROM listings
WHERE transmission IN ('manual', 'automatic') GROUP BY 1)
SELECT transmission, total, {r('total * 100.0 / (SELECT sum(total) FROM c)')} AS percentage FROM c""")
def _(k):
    return mk.share(k.listings("transmission"), "transmission", ["manual", "automatic"])


@query("transmission_share", "WN1", f"""SELECT transmission, {n()} AS total,
{r('100.0 * count(*) / sum(count(*)) OVER ()')} AS percentage FROM listings WHERE transmission IS NOT NULL GROUP BY 1""")
def _(k):
    return mk.share(k.listings("transmission"), "transmission")


@query("prices_under_make_limit", "JN6 PF24", f"""SELECT manufacturer, {m('total_listings avg_price min_price max_price')}
FROM listings WHERE manufacturer IS NOT NULL AND price <= 200000 GROUP BY 1 HAVING count(*) >= 10""")
def _(k):
    return mk.prices_under_make_limit(k.listings("manufacturer", "price"))


@query("market_stats_by_make_model_year", "AG8", f"""SELECT manufacturer, model, year,
{m('avg_price median_price min_price max_price priced')}, cast({AS_OF} - max(posting_date) as bigint) AS days_listed
FROM listings WHERE manufacturer IS NOT NULL AND model IS NOT NULL AND year IS NOT NULL GROUP BY 1, 2, 3""")
def _(k):
    df = k.listings("manufacturer", "model", "year", "price", "posting_date").dropna(
        subset=["manufacturer", "model", "year"])
    by = ["manufacturer", "model", "year"]
    stats = summarise(df, by, ["avg_price", "min_price", "max_price", "priced"],
                      days_listed=F.datediff(F.lit("2002-01-01").cast("date"), F.max("posting_date")).cast("bigint"))
    return with_medians(stats, df, by, median_price="price")


def _segment_sql(key, extra=""):
    return f"""SELECT {key}, {m('avg_price min_price max_price priced' + extra)}, {m('total_financed mean_monthly_payment mean_down_payment mean_installments')}
FROM listings WHERE {key} IS NOT NULL GROUP BY 1"""


_SEGMENT = ["avg_price", "min_price", "max_price", "priced", "total_financed",
            "mean_monthly_payment", "mean_down_payment", "mean_installments"]
_FINANCE_COLUMNS = ["price", "has_installments", "monthly_payment", "down_payment", "installments"]


@query("segment_stats_by_make", "AG9", _segment_sql("manufacturer", " avg_year"))
def _(k):
    return summarise(k.listings("manufacturer", "year", *_FINANCE_COLUMNS), ["manufacturer"],
                     [*_SEGMENT, "avg_year"], drop_null_keys=True)


@query("segment_stats_by_state", "AG9", _segment_sql("state"))
def _(k):
    return summarise(k.listings("state", *_FINANCE_COLUMNS), ["state"], _SEGMENT, drop_null_keys=True)


@query("segment_stats_by_year", "AG9", _segment_sql("year"))
def _(k):
    return summarise(k.listings("year", *_FINANCE_COLUMNS), ["year"], _SEGMENT, drop_null_keys=True)


def _load_sql(key):
    return f"""SELECT {key}, {m('priced avg_price min_price max_price avg_year avg_mileage')} FROM listings
WHERE {key} IS NOT NULL GROUP BY 1"""


_LOAD = ["priced", "avg_price", "min_price", "max_price", "avg_year", "avg_mileage"]

for _key in ("manufacturer", "state", "year"):
    @query(f"load_stats_by_{_key}", "AG10", _load_sql(_key))
    def _(k, key=_key):
        wanted = dict.fromkeys([key, "price", "year", "odometer"])
        return summarise(k.listings(*wanted), [key], _LOAD, drop_null_keys=True)


@query("make_metrics", "AG11 IO11", f"""SELECT manufacturer, {m('priced avg_price median_price std_price avg_year avg_mileage')}
FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1""")
def _(k):
    df = k.listings("manufacturer", "price", "year", "odometer").where("manufacturer is not null")
    stats = summarise(df, ["manufacturer"], ["priced", "avg_price", "std_price", "avg_year", "avg_mileage"])
    return with_medians(stats, df, ["manufacturer"], median_price="price")


@query("state_metrics", "AG12", f"""SELECT state, {m('priced avg_price median_price avg_mileage')},
{r('arg_min(latitude, listing_id)')} AS latitude, {r('arg_min(longitude, listing_id)')} AS longitude
FROM listings WHERE state IS NOT NULL GROUP BY 1""")
def _(k):
    df = k.listings("state", "price", "odometer", "latitude", "longitude", "listing_id")
    first = {c: half_up(F.min_by(c, F.when(F.col(c).isNotNull(), F.col("listing_id")))) for c in ("latitude", "longitude")}
    stats = summarise(df, ["state"], ["priced", "avg_price", "avg_mileage"], drop_null_keys=True, **first)
    return with_medians(stats, df, ["state"], median_price="price")


@query("bi_make_metrics", "AG13 IO11", f"""SELECT manufacturer, {m('priced avg_price min_price max_price avg_mileage avg_year')}
FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1""")
def _(k):
    return summarise(k.listings("manufacturer", "price", "odometer", "year"), ["manufacturer"],
                     ["priced", "avg_price", "min_price", "max_price", "avg_mileage", "avg_year"], drop_null_keys=True)


@query("bi_region_metrics", "AG13 IO11", f"""SELECT region, state, {m('priced avg_price avg_mileage')} FROM listings
WHERE region IS NOT NULL AND state IS NOT NULL GROUP BY 1, 2""")
def _(k):
    return summarise(k.listings("region", "state", "price", "odometer"), ["region", "state"],
                     ["priced", "avg_price", "avg_mileage"], drop_null_keys=True)


@query("bi_month_metrics", "AG14 IO11", f"""SELECT cast(date_trunc('month', posting_date) as date) AS posting_month,
{m('priced avg_price avg_mileage')} FROM listings WHERE posting_date IS NOT NULL GROUP BY 1""")
def _(k):
    df = k.listings("posting_date", "price", "odometer").withColumn(
        "posting_month", F.trunc("posting_date", "month"))
    return summarise(df, ["posting_month"], ["priced", "avg_price", "avg_mileage"], drop_null_keys=True)


RANGE_LABELS = ["0-10000", "10000-20000", "20000-30000", "30000-50000", "50000-inf"]


@query("price_range_counts", "AG19", """WITH bins(price_range, lo, hi) AS (VALUES ('0-10000', 0, 10000),
('10000-20000', 10000, 20000), ('20000-30000', 20000, 30000), ('30000-50000', 30000, 50000), ('50000-inf', 50000, 1e300))
SELECT price_range, cast(count(price) as bigint) AS listings FROM bins LEFT JOIN listings ON price >= lo AND price < hi GROUP BY 1""")
def _(k):
    # one row out of one aggregation, turned into five: an empty range stays, with 0
    price, edges = F.col("price"), [0, 10000, 20000, 30000, 50000, float("inf")]
    counts = k.listings("price").agg(*[
        F.count_if((price >= lo) & (price < hi)).alias(label)
        for label, lo, hi in zip(RANGE_LABELS, edges, edges[1:])])
    return counts.unpivot([], RANGE_LABELS, "price_range", "listings")


@query("value_retention", "AG27", f"""SELECT manufacturer, model, {m('avg_price total_listings')},
{r(f'avg({AS_OF_YEAR} - year)', 1)} AS avg_age, {r('avg(price / nullif(odometer, 0) * 1000)')} AS avg_price_per_1000_miles
FROM listings WHERE odometer > 0 GROUP BY 1, 2 HAVING count(*) >= 10
ORDER BY avg_price_per_1000_miles DESC, manufacturer NULLS FIRST, model LIMIT 15""")
def _(k):
    return retention(k.listings("manufacturer", "model", "price", "odometer", "year"), AS_OF_YEAR)


@query("seasonality_by_month", "AG28", f"""SELECT cast(month(posting_date) as int) AS month,
{m('total_listings avg_price min_price max_price')} FROM listings WHERE posting_date IS NOT NULL GROUP BY 1""")
def _(k):
    df = k.listings("posting_date", "price").withColumn("month", F.month("posting_date"))
    return summarise(df, ["month"], PRICES, drop_null_keys=True)


# The given tables have no paint colour; condition takes its place as the second key.
@query("type_by_condition_prices", "AG29", f"""SELECT type, condition, {m('total_listings avg_price avg_mileage')}
FROM listings WHERE type != 'unknown' AND condition != 'unknown' GROUP BY 1, 2 HAVING count(*) > 10""")
def _(k):
    df = k.listings("type", "condition", "price", "odometer")
    return summarise(df.where("type != 'unknown' and condition != 'unknown'"), ["type", "condition"],
                     ["total_listings", "avg_price", "avg_mileage"], min_count=11)


@query("state_price_variation", "AG30", f"""SELECT state, {m('total_listings avg_price std_price avg_mileage')},
{r('stddev_samp(price) / avg(price) * 100')} AS price_variation_pct FROM listings WHERE state IS NOT NULL
GROUP BY 1 HAVING count(*) >= 50""")
def _(k):
    return summarise(k.listings("state", "price", "odometer"), ["state"],
                     ["total_listings", "avg_price", "std_price", "avg_mileage"], min_count=50,
                     price_variation_pct=half_up(F.stddev_samp("price") / F.avg("price") * 100))


@query("make_by_condition", "AG31", f"""WITH best AS (SELECT manufacturer FROM listings WHERE manufacturer IS NOT NULL
GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10)
SELECT manufacturer, condition, {m('total_listings avg_price avg_mileage')}, {r(f'avg({AS_OF_YEAR} - year)')} AS avg_age
FROM listings WHERE manufacturer IN (SELECT manufacturer FROM best) GROUP BY 1, 2 HAVING count(*) >= 5""")
def _(k):
    df = keep_frequent(k.listings("manufacturer", "condition", "price", "odometer", "year"), "manufacturer", top=10)
    return summarise(df, ["manufacturer", "condition"], ["total_listings", "avg_price", "avg_mileage"], min_count=5,
                     avg_age=half_up(F.avg(F.lit(AS_OF_YEAR) - F.col("year"))))


@query("fuel_by_type", "AG32", f"""SELECT fuel, type, {m('total_listings avg_price')},
{n('DISTINCT manufacturer')} AS distinct_makes FROM listings GROUP BY 1, 2 HAVING count(*) >= 10""")
def _(k):
    return summarise(k.listings("fuel", "type", "price", "manufacturer"), ["fuel", "type"],
                     ["total_listings", "avg_price"], min_count=10,
                     distinct_makes=F.count_distinct("manufacturer"))


_MILES = "total_listings avg_mileage std_mileage min_mileage max_mileage"


@query("mileage_by_make_fuel", "AG33", f"""SELECT manufacturer, fuel, {m(_MILES)} FROM listings
WHERE manufacturer != 'unknown' AND fuel != 'unknown' AND odometer > 0 GROUP BY 1, 2 HAVING count(*) >= 10""")
def _(k):
    df = k.listings("manufacturer", "fuel", "odometer")
    return summarise(df.where("manufacturer != 'unknown' and fuel != 'unknown' and odometer > 0"),
                     ["manufacturer", "fuel"], _MILES.split(), min_count=10)


@query("mileage_by_fuel", "AG33", f"""SELECT fuel, {n('odometer')} AS measured, {m('avg_mileage std_mileage median_mileage')}
FROM listings WHERE fuel IS NOT NULL GROUP BY 1""")
def _(k):
    df = k.listings("fuel", "odometer")
    stats = summarise(df, ["fuel"], ["avg_mileage", "std_mileage"], drop_null_keys=True, measured=F.count("odometer"))
    return with_medians(stats, df, ["fuel"], median_mileage="odometer")


@query("year_price_stats", "AG34", f"""SELECT year, {m('total_listings avg_price std_price min_price max_price')}
FROM listings WHERE year BETWEEN 1990 AND 2024 AND price BETWEEN 5000 AND 1000000 GROUP BY 1""")
def _(k):
    df = k.listings("year", "price").where("year between 1990 and 2024 and price between 5000 and 1000000")
    return summarise(df, ["year"], ["total_listings", "avg_price", "std_price", "min_price", "max_price"])


@query("year_price_correlation", "AG34 ST6", f"""WITH y AS (SELECT year, avg(price) AS p FROM listings
WHERE year BETWEEN 1990 AND 2024 AND price BETWEEN 5000 AND 1000000 GROUP BY 1)
SELECT {n()} AS years, {r('corr(year, p)', 6)} AS correlation FROM y""")
def _(k):
    df = k.listings("year", "price").where("year between 1990 and 2024 and price between 5000 and 1000000")
    means = df.groupBy("year").agg(F.avg("price").alias("p"))
    return means.agg(F.count("*").alias("years"), half_up(F.corr("year", "p"), 6).alias("correlation"))


@query("value_counts_top", "AG35", " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS column_name, cast({c} as varchar) AS value, {n()} AS total FROM listings
WHERE {c} IS NOT NULL GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 5)"""
    for c in ("manufacturer", "model", "fuel", "transmission", "state", "year")))
def _(k):
    columns = ["manufacturer", "model", "fuel", "transmission", "state", "year"]
    df = k.listings(*columns)
    long = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x"))
    counts = long.select("x.*").where("value is not null").groupBy("column_name", "value").agg(F.count("*").alias("total"))
    return top_per_group(counts, ["column_name"], "total", "value", 5).drop("place")


@query("executive_kpis", "AG36", f"""SELECT {n()} AS volume, {r('100.0 * count(*) / (SELECT count(*) FROM listings)')} AS share_pct,
{m('total_value avg_price')}, {r(f'{AS_OF_YEAR} - avg(year)')} AS fleet_age FROM listings WHERE year >= 1997 AND fuel IN ('gas', 'diesel')""")
def _(k):
    wanted = (F.col("year") >= 1997) & F.col("fuel").isin("gas", "diesel")
    df = k.listings("year", "fuel", "price")
    return df.agg(
        F.count_if(wanted).alias("volume"),
        half_up(F.count_if(wanted) * 100.0 / F.count("*")).alias("share_pct"),
        half_up(F.sum(F.when(wanted, F.col("price")))).alias("total_value"),
        half_up(F.avg(F.when(wanted, F.col("price")))).alias("avg_price"),
        half_up(F.lit(AS_OF_YEAR) - F.avg(F.when(wanted, F.col("year")))).alias("fleet_age"))


@query("market_insights", "AG37", f"""SELECT {m('total_listings total_value avg_price std_price avg_year avg_mileage')} FROM listings""")
def _(k):
    return summarise(k.listings("price", "year", "odometer"), [],
                     ["total_listings", "total_value", "avg_price", "std_price", "avg_year", "avg_mileage"])


@query("market_insights_trend", "AG37 ML24", f"""SELECT cast(date_trunc('month', posting_date) as date) AS month,
{m('avg_price total_listings')} FROM listings WHERE posting_date IS NOT NULL GROUP BY 1""")
def _(k):
    df = k.listings("posting_date", "price").withColumn("month", F.trunc("posting_date", "month"))
    return summarise(df, ["month"], ["avg_price", "total_listings"], drop_null_keys=True)


@query("home_summary", "AG38", f"""SELECT {m('total_listings avg_price min_price max_price')},
{n('DISTINCT manufacturer')} AS makes, min(year) AS first_year, max(year) AS last_year FROM listings""")
def _(k):
    return summarise(k.listings("price", "manufacturer", "year"), [], PRICES, makes=F.count_distinct("manufacturer"),
                     first_year=F.min("year"), last_year=F.max("year"))


@query("state_demand", "AG39", f"""SELECT state, {m('total_listings avg_price median_price std_price')} FROM listings
WHERE model IS NOT NULL AND price IS NOT NULL AND state IS NOT NULL GROUP BY 1 HAVING count(*) >= 10""")
def _(k):
    df = k.listings("state", "model", "price").dropna()
    stats = summarise(df, ["state"], ["total_listings", "avg_price", "std_price"], min_count=10)
    return with_medians(stats, df, ["state"], median_price="price")


# No city among the given columns: supplier stands in for the place below the state.
@query("city_demand", "AG40", f"""SELECT l_suppkey AS city, {n()} AS total_listings, {r('avg(l_extendedprice)')} AS avg_price,
{r('median(l_extendedprice)')} AS median_price FROM lineitem GROUP BY 1 HAVING count(*) >= 5
ORDER BY total_listings DESC, city LIMIT 20""")
def _(k):
    df = k.table("lineitem").select(F.col("l_suppkey").alias("city"), F.col("l_extendedprice").alias("price"))
    best = summarise(df, ["city"], ["total_listings", "avg_price"], min_count=5, order="total_listings", top=20)
    return with_medians(best, join_on(df, best.select("city"), ["city"], "left_semi"), ["city"], median_price="price")


@query("regional_monthly_trend", "AG41", f"""WITH t AS (SELECT state, cast(date_trunc('month', posting_date) as date) AS month,
{m('total_listings avg_price median_price')} FROM listings WHERE model IS NOT NULL AND price IS NOT NULL AND state IS NOT NULL GROUP BY 1, 2)
SELECT * FROM t WHERE state IN (SELECT state FROM t GROUP BY 1 HAVING count(*) >= 2)""")
def _(k):
    df = k.listings("state", "posting_date", "model", "price").dropna().withColumn("month", F.trunc("posting_date", "month"))
    stats = with_medians(summarise(df, ["state", "month"], ["total_listings", "avg_price"]), df, ["state", "month"],
                         median_price="price")
    enough = stats.groupBy("state").agg(F.count("*").alias("c")).where("c >= 2").select("state")
    return join_on(stats, enough, ["state"], "left_semi")


@query("model_by_state_prices", "AG42", f"""WITH best AS (SELECT model FROM listings WHERE model IS NOT NULL AND price IS NOT NULL
GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 20),
cells AS (SELECT DISTINCT b.model, s.state FROM best b, (SELECT DISTINCT state FROM listings) s)
SELECT c.model, c.state, {r('coalesce(avg(price), 0)')} AS avg_price FROM cells c LEFT JOIN listings l
ON c.model = l.model AND c.state = l.state GROUP BY 1, 2""")
def _(k):
    df = k.listings("model", "state", "price").where("price is not null")
    states = [x.state for x in df.select("state").distinct().orderBy("state").collect()]
    df = keep_frequent(df, "model", top=20)
    wide = pivot_means(df, "model", "state", states, "price")
    return wide.unpivot(["model"], states, "state", "avg_price")


@query("make_by_fuel_mileage", "AG43", f"""SELECT manufacturer, {', '.join(f"{r(f'''coalesce(avg(odometer) FILTER (WHERE fuel = '{f}'), 0)''')} AS {f}" for f in ('gas', 'diesel', 'electric'))}
FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1""")
def _(k):
    wide = pivot_means(k.listings("manufacturer", "fuel", "odometer"), "manufacturer", "fuel",
                       ["gas", "diesel", "electric"], "odometer")
    return wide.orderBy(F.desc("gas"), "manufacturer")


@query("type_by_fuel_share", "AG44", f"""SELECT type, fuel, {n()} AS total,
{r('100.0 * count(*) / sum(count(*)) OVER (PARTITION BY type)')} AS row_pct FROM listings GROUP BY 1, 2""")
def _(k):
    from pyspark.sql import Window

    counts = k.listings("type", "fuel").groupBy("type", "fuel").agg(F.count("*").alias("total"))
    return counts.withColumn("row_pct", half_up(F.col("total") * 100.0 / F.sum("total").over(Window.partitionBy("type"))))


@query("segment_concentration", "AG46", f"""WITH c AS (SELECT type, manufacturer, count(*) AS q,
row_number() OVER (PARTITION BY type ORDER BY count(*) DESC, manufacturer) AS rn FROM listings
WHERE manufacturer IS NOT NULL GROUP BY 1, 2), t AS (SELECT type, sum(q) AS top3 FROM c WHERE rn <= 3 GROUP BY 1)
SELECT type, {m('total_listings')}, {n('DISTINCT manufacturer')} AS distinct_makes, {n('DISTINCT model')} AS distinct_models,
{m('avg_price std_price min_price max_price')}, {r('any_value(top3) / count(*)', 3)} AS concentration FROM listings JOIN t USING (type) GROUP BY 1""")
def _(k):
    return mk.concentration(k.listings("type", "manufacturer", "model", "price"), "type", "manufacturer")


@query("competition_by_make", "AG47 JN10", f"""WITH b AS (SELECT manufacturer AS target, count(*) AS own, avg(price) AS p,
quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1)
SELECT target AS manufacturer, cast(own as bigint) AS total_listings, {r('own / (SELECT count(*) FROM listings)', 4)} AS market_share,
{r('p')} AS avg_price, {r('q1')} AS q1, {r('q3')} AS q3, {n('DISTINCT l.manufacturer')} AS direct_competitors,
{n('l.price')} AS competitor_listings, {r('avg(l.price)')} AS avg_competitor_price
FROM b LEFT JOIN listings l ON l.manufacturer != target AND l.price BETWEEN q1 AND q3 GROUP BY target, own, p, q1, q3""")
def _(k):
    return mk.competition(k.listings("manufacturer", "price"))


@query("closest_rivals", "AG47", """WITH b AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3
FROM listings WHERE manufacturer = 'brand#1')
SELECT manufacturer, cast(count(*) as bigint) AS listings FROM listings, b WHERE manufacturer != 'brand#1'
AND price BETWEEN q1 AND q3 GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5""")
def _(k):
    return mk.closest_rivals(k.listings("manufacturer", "price"), "brand#1")


@query("price_positioning", "SF17 ST10", f"""WITH s AS (SELECT manufacturer = 'brand#1' AS own, price FROM listings
WHERE manufacturer IS NOT NULL AND price IS NOT NULL), md AS (SELECT median(price) AS md FROM s WHERE own),
a AS (SELECT avg(price) FILTER (WHERE own) AS m1, avg(price) FILTER (WHERE NOT own) AS m2,
var_samp(price) FILTER (WHERE own) AS v1, var_samp(price) FILTER (WHERE NOT own) AS v2,
count(*) FILTER (WHERE own) AS n1, count(*) FILTER (WHERE NOT own) AS n2,
count(*) FILTER (WHERE NOT own AND price < md) AS below, count(*) FILTER (WHERE NOT own AND price <= md) AS upto FROM s, md),
z AS (SELECT *, (below + upto) * 50.0 / n2 AS spot, (m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) AS t FROM a)
SELECT 'brand#1' AS manufacturer, {r('m1 - m2')} AS price_difference, {r('(m1 - m2) / m2 * 100')} AS price_difference_pct,
{r('t', 4)} AS t_statistic, abs(t) > 1.96 AS is_significant,
cast(n1 + n2 - 2 as bigint) AS degrees_of_freedom, {r('spot', 4)} AS market_percentile,
CASE WHEN spot > 75 THEN 'premium' WHEN spot > 25 THEN 'competitive' ELSE 'economic' END AS positioning FROM z""")
def _(k):
    # SQL has no t distribution; with these many degrees of freedom 5 % lie beyond 1.96
    return mk.positioning(k.listings("manufacturer", "price"), "brand#1").drop("p_value")


@query("state_modes", "AG48", """WITH c AS (SELECT state, manufacturer, row_number() OVER (PARTITION BY state
ORDER BY count(*) DESC, manufacturer) AS rn FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1, 2),
d AS (SELECT state, model, row_number() OVER (PARTITION BY state ORDER BY count(*) DESC, model) AS rn FROM listings GROUP BY 1, 2)
SELECT c.state, c.manufacturer AS top_make, d.model AS top_model FROM c JOIN d ON c.state = d.state AND c.rn = 1 AND d.rn = 1""")
def _(k):
    df = k.listings("state", "manufacturer", "model")
    return join_on(group_mode(df, ["state"], "manufacturer", "top_make"),
                   group_mode(df, ["state"], "model", "top_model"), ["state"])


@query("bi_measures_by_year", "AG51", f"""SELECT year, {m('priced avg_price median_price min_price max_price')},
{r('stddev_pop(price)')} AS std_pop, {r('quantile_cont(price, 0.25)')} AS q1, {r('quantile_cont(price, 0.75)')} AS q3,
{r('quantile_cont(price, 0.75) - quantile_cont(price, 0.25)')} AS iqr, {r('stddev_pop(price) / avg(price)', 4)} AS cv,
{r('max(price) - min(price)')} AS price_spread FROM listings WHERE year IS NOT NULL GROUP BY 1""")
def _(k):
    df = k.listings("year", "price")
    stats = summarise(df, ["year"], ["priced", "avg_price", "min_price", "max_price"], drop_null_keys=True,
                      std_pop=half_up(F.stddev_pop("price")), cv=half_up(F.stddev_pop("price") / F.avg("price"), 4),
                      price_spread=half_up(F.max("price") - F.min("price")))
    q = quantiles(df, "price", {"q1": 0.25, "median_price": 0.5, "q3": 0.75}, ["year"])
    q = q.select("year", half_up("q1").alias("q1"), half_up("median_price").alias("median_price"),
                 half_up("q3").alias("q3"), half_up(F.col("q3") - F.col("q1")).alias("iqr"))
    return join_on(stats, q, ["year"], "left")


@query("year_over_year_price", "WN11", f"""WITH y AS (SELECT year, avg(price) AS p FROM listings WHERE year IS NOT NULL GROUP BY 1)
SELECT a.year, {r('a.p')} AS avg_price, {r('(a.p - b.p) / nullif(b.p, 0) * 100')} AS change_pct
FROM y a LEFT JOIN y b ON b.year = a.year - 1""")
def _(k):
    return mk.average_step(k.listings("year", "price"), AS_OF_YEAR)


@query("year_outlier_counts", "WN12", f"""WITH q AS (SELECT year, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3
FROM listings GROUP BY 1)
SELECT l.year, CASE WHEN price < q1 - 0.2 * (q3 - q1) OR price > q3 + 0.2 * (q3 - q1) THEN 'Outlier' ELSE 'Normal' END AS price_flag,
{n()} AS listings FROM listings l JOIN q ON l.year = q.year WHERE price IS NOT NULL GROUP BY 1, 2""")
def _(k):
    df = k.listings("year", "price").where("price is not null")
    # 1.5 leaves nothing outside on this near-uniform price column, so the fence is tighter here
    return mk.flag_against_year(df, 0.2).groupBy("year", "price_flag").agg(F.count("*").alias("listings"))
