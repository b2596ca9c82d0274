"""Feature table, scalar functions, bins."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.functions import bins
from forecourt.functions.calendar import calendar_parts, days_between, local_time, season_flags
from forecourt.functions.numbers import half_up, ratio
from forecourt.operators import features as ft
from forecourt.operators.aggregates import summarise
from forecourt.operators.joins import attach_group_stats
from forecourt.plans.registry import m, n, query, r

AS_OF_YEAR = 2002
_LOCAL = "timezone('America/New_York', timezone('UTC', cast(posting_date as timestamp)))"
_PARTS = f"""cast(year({_LOCAL}) as int) AS posting_year, cast(month({_LOCAL}) as int) AS posting_month, cast(day({_LOCAL}) as int) AS posting_day,
cast(isodow({_LOCAL}) - 1 as int) AS posting_dayofweek, cast(quarter({_LOCAL}) as int) AS posting_quarter, cast(week({_LOCAL}) as int) AS posting_week"""


def rounded(df, places: int = 4, keep: tuple = ()):
    """Doubles rounded for comparison with the oracle."""
    return df.withColumns({c: half_up(c, places) for c, t in df.dtypes if t == "double" and c not in keep})


@query("calendar_parts", "SF1 SF2", f"""WITH p AS (SELECT {_PARTS} FROM listings)
SELECT *, cast(posting_dayofweek IN (5, 6) as int) AS is_weekend, cast(posting_month IN (12, 1) as int) AS is_holiday,
cast(posting_month IN (6, 7, 8) as int) AS is_summer, cast(posting_month IN (12, 1, 2) as int) AS is_winter, {n()} AS listings
FROM p GROUP BY ALL""")
def _(k):
    parts = k.listings("posting_date").select(*[
        c.alias(a) for a, c in calendar_parts(local_time(F.col("posting_date"))).items()])
    rows = parts.withColumns(season_flags(F.col("posting_dayofweek"), F.col("posting_month")))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("listings"))


@query("event_calendar_parts", "SF1", f"""WITH l AS (SELECT timezone('America/New_York', timezone('UTC', ts)) AS t FROM events)
SELECT cast(t as date) AS local_day, cast(hour(t) as int) AS local_hour, cast(isodow(t) - 1 as int) AS dayofweek, {n()} AS events FROM l GROUP BY 1, 2, 3""")
def _(k):
    local = k.table("events").select(local_time(F.col("ts")).alias("t"))
    return local.groupBy(F.col("t").cast("date").alias("local_day"), F.hour("t").alias("local_hour"),
                         F.weekday("t").alias("dayofweek")).agg(F.count("*").alias("events"))


@query("vehicle_age_variants", "SF3 WN8", f"""SELECT year, cast(2024 - year as int) AS age_fixed, cast({AS_OF_YEAR} - year as int) AS age_as_of,
cast((SELECT max(year({_LOCAL})) FROM listings) - year as int) AS age_at_last_posting, {n()} AS listings FROM listings GROUP BY year""")
def _(k):
    df = k.listings("year", "posting_date")
    last = df.agg(F.max(F.year(local_time(F.col("posting_date"))))).scalar()
    return df.groupBy("year").agg(F.count("*").alias("listings")).select(
        "year", (2024 - F.col("year")).alias("age_fixed"), (F.lit(AS_OF_YEAR) - F.col("year")).alias("age_as_of"),
        (last - F.col("year")).alias("age_at_last_posting"), "listings")


@query("days_on_market", "SF4 WN8", """SELECT event_id, cast(floor(epoch((SELECT max(ts) FROM events) - ts) / 86400) as bigint) AS days FROM events""")
def _(k):
    df = k.table("events").select("event_id", "ts")
    last = df.agg(F.max("ts")).scalar()
    return df.select("event_id", days_between(last, F.col("ts")).alias("days"))


@query("guarded_ratios", "SF5", f"""WITH a AS (SELECT *, 2001 - year AS age FROM listings)
SELECT listing_id, {r('price / CASE WHEN age = 0 THEN 1 ELSE age END', 4)} AS price_per_year, {r('price / nullif(odometer, 0)', 6)} AS price_per_mile,
{r('odometer / CASE WHEN age = 0 THEN 1 ELSE age END', 4)} AS miles_per_year, {r('age / nullif(odometer, 0)', 8)} AS age_mileage_ratio FROM a""")
def _(k):
    df = k.listings("listing_id", "price", "odometer", "year").withColumn("age", F.lit(2001) - F.col("year"))
    aged = ft.one_for_zero(F.col("age"))
    return df.select("listing_id", half_up(F.col("price") / aged, 4).alias("price_per_year"),
                     half_up(ratio(F.col("price"), F.col("odometer")), 6).alias("price_per_mile"),
                     half_up(F.col("odometer") / aged, 4).alias("miles_per_year"),
                     half_up(ratio(F.col("age"), F.col("odometer")), 8).alias("age_mileage_ratio"))


_HAV = """2 * 6371 * asin(sqrt(pow(sin((radians(lat2) - radians(latitude)) / 2), 2) + cos(radians(latitude)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(longitude)) / 2), 2)))"""


@query("distance_to_state_centre", "SF6 JN7", f"""WITH c AS (SELECT state, avg(latitude) AS lat2, avg(longitude) AS lon2 FROM listings GROUP BY 1)
SELECT listing_id, {r(_HAV, 4)} AS distance_km FROM listings JOIN c USING (state)""")
def _(k):
    far = ft.state_distances(k.listings("listing_id", "state", "latitude", "longitude"))
    return far.select("listing_id", half_up("distance_km", 4).alias("distance_km"))


_CODE = "CASE condition WHEN 'new' THEN 5 WHEN 'like new' THEN 4 WHEN 'excellent' THEN 3 WHEN 'good' THEN 2 WHEN 'fair' THEN 1 WHEN 'salvage' THEN 0 END"


@query("condition_codes", "SF7 WN4", f"""WITH a AS (SELECT listing_id, manufacturer, model, {_CODE} AS code FROM listings),
g AS (SELECT manufacturer, model, avg(code) AS mean, stddev_samp(code) AS sd FROM a WHERE manufacturer IS NOT NULL GROUP BY 1, 2)
SELECT listing_id, code AS condition_numeric, {r('(code - mean) / nullif(sd, 0)', 6)} AS condition_relative FROM a LEFT JOIN g USING (manufacturer, model)""")
def _(k):
    df = k.listings("listing_id", "manufacturer", "model", "condition")
    df = df.withColumn("condition_numeric", ft.condition_code(F.col("condition")))
    df = attach_group_stats(df, ["manufacturer", "model"], mean=F.avg("condition_numeric"), sd=F.stddev_samp("condition_numeric"))
    return df.select("listing_id", "condition_numeric", half_up(
        ratio(F.col("condition_numeric") - F.col("mean"), F.col("sd")), 6).alias("condition_relative"))


@query("segment_flags", "SF8", f"""SELECT fuel, cast(coalesce(manufacturer IN ('bmw', 'mercedes-benz', 'audi', 'porsche', 'lexus'), false) as int) AS is_luxury,
cast(contains(fuel, 'electric') as int) AS is_electric, cast(contains(fuel, 'hybrid') as int) AS is_hybrid, {n()} AS listings FROM listings GROUP BY 1, 2, 3, 4""")
def _(k):
    flags = ft.segment_flags(F.col("manufacturer"), F.col("fuel"))
    rows = k.listings("manufacturer", "fuel").select("fuel", *[flags[f].alias(f) for f in ("is_luxury", "is_electric", "is_hybrid")])
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("listings"))


@query("price_categories", "SF9", f"""SELECT CASE WHEN price <= 0 THEN NULL WHEN price <= 10000 THEN '<10k' WHEN price <= 20000 THEN '10k-20k'
WHEN price <= 30000 THEN '20k-30k' WHEN price <= 50000 THEN '30k-50k' WHEN price > 50000 THEN '>50k' END AS price_category, {n()} AS listings FROM listings GROUP BY 1""")
def _(k):
    from forecourt.operators.cleaning import price_category
    return k.listings("price").groupBy(price_category(F.col("price")).alias("price_category")).agg(F.count("*").alias("listings"))


_LABELS = ["very low", "low", "medium", "high", "very high"]


@query("equal_width_price_segments", "SF10", f"""WITH s AS (SELECT min(price) AS lo, max(price) AS hi FROM listings)
SELECT CASE WHEN price <= lo + (hi - lo) / 5 THEN 'very low' WHEN price <= lo + (hi - lo) / 5 * 2 THEN 'low' WHEN price <= lo + (hi - lo) / 5 * 3 THEN 'medium'
WHEN price <= lo + (hi - lo) / 5 * 4 THEN 'high' ELSE 'very high' END AS segment, {m('priced avg_price avg_mileage')} FROM listings, s WHERE price IS NOT NULL GROUP BY 1""")
def _(k):
    rows = bins.equal_width(k.listings("price", "odometer"), "price", 5, _LABELS, "segment")
    return summarise(rows, ["segment"], ["priced", "avg_price", "avg_mileage"], drop_null_keys=True)


@query("quantile_price_segments", "SF11", f"""WITH q AS (SELECT quantile_cont(price, 0.2) AS a, quantile_cont(price, 0.4) AS b, quantile_cont(price, 0.6) AS c, quantile_cont(price, 0.8) AS d FROM listings)
SELECT CASE WHEN price <= a THEN 'very low' WHEN price <= b THEN 'low' WHEN price <= c THEN 'medium' WHEN price <= d THEN 'high' ELSE 'very high' END AS segment,
{m('priced avg_price avg_mileage')} FROM listings, q WHERE price IS NOT NULL GROUP BY 1""")
def _(k):
    rows = bins.by_quantile(k.listings("price", "odometer"), "price", _LABELS, "segment")
    return summarise(rows, ["segment"], ["priced", "avg_price", "avg_mileage"], drop_null_keys=True)


for _bins in (50, 40, 30):
    @query(f"price_histogram_{_bins}", "SF12 ST16", f"""WITH s AS (SELECT min(price) AS lo, max(price) AS hi FROM listings),
c AS (SELECT cast(least(floor((price - lo) / ((hi - lo) / {_bins})), {_bins} - 1) as int) AS bin, count(*) AS q FROM listings, s WHERE price IS NOT NULL GROUP BY 1)
SELECT cast(b.bin as int) AS bin, cast(coalesce(q, 0) as bigint) AS listings FROM range({_bins}) b(bin) LEFT JOIN c ON c.bin = b.bin""")
    def _(k, count=_bins):
        return bins.histogram(k.listings("price"), "price", count)


@query("log_counts", "SF13", f"""WITH d AS (SELECT posting_date, count(*) AS c FROM listings GROUP BY 1)
SELECT posting_date, {r('ln(1 + c)', 6)} AS log_count, {r('exp(ln(1 + c)) - 1', 4)} AS back FROM d""")
def _(k):
    daily = k.listings("posting_date").groupBy("posting_date").agg(F.count("*").alias("c"))
    return daily.select("posting_date", half_up(F.log1p("c"), 6).alias("log_count"), half_up(F.expm1(F.log1p("c")), 4).alias("back"))


@query("relative_positions", "WN2 WN3", f"""WITH a AS (SELECT manufacturer, avg(price) AS pm FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1),
b AS (SELECT manufacturer, model, avg(price) AS pb, avg(odometer) AS km FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1, 2),
c AS (SELECT type, avg(price) AS pt FROM listings GROUP BY 1)
SELECT listing_id, {r('(price - pm) / nullif(pm, 0)', 6)} AS price_position_manufacturer, {r('(price - pb) / nullif(pb, 0)', 6)} AS price_position_model,
{r('(price - pt) / nullif(pt, 0)', 6)} AS price_position_type, {r('(odometer - km) / nullif(km, 0)', 6)} AS miles_position
FROM listings LEFT JOIN a USING (manufacturer) LEFT JOIN b USING (manufacturer, model) LEFT JOIN c USING (type)""")
def _(k):
    df = k.listings("listing_id", "manufacturer", "model", "type", "price", "odometer")
    df = attach_group_stats(df, ["manufacturer"], pm=F.avg("price"))
    df = attach_group_stats(df, ["manufacturer", "model"], pb=F.avg("price"), km=F.avg("odometer"))
    df = attach_group_stats(df, ["type"], pt=F.avg("price"))
    place = lambda v, mean: half_up(ratio(F.col(v) - F.col(mean), F.col(mean)), 6)
    return df.select("listing_id", place("price", "pm").alias("price_position_manufacturer"),
                     place("price", "pb").alias("price_position_model"), place("price", "pt").alias("price_position_type"),
                     place("odometer", "km").alias("miles_position"))


@query("group_counts_and_shares", "WN5 WN6", f"""WITH a AS (SELECT manufacturer, count(*) AS q FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1),
b AS (SELECT manufacturer, model, count(*) AS q FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1, 2), s AS (SELECT state, count(*) AS q FROM listings GROUP BY 1)
SELECT listing_id, cast(a.q as bigint) AS listings_by_manufacturer, cast(b.q as bigint) AS listings_by_model, cast(s.q as bigint) AS listings_by_state,
{r('a.q / (SELECT count(*) FROM listings)', 8)} AS market_share_manufacturer, {r('b.q / s.q', 8)} AS competition_density
FROM listings l LEFT JOIN a USING (manufacturer) LEFT JOIN b USING (manufacturer, model) LEFT JOIN s USING (state)""")
def _(k):
    df = k.listings("listing_id", "manufacturer", "model", "state")
    total = df.agg(F.count("*")).scalar()
    df = attach_group_stats(df, ["manufacturer"], listings_by_manufacturer=F.count("listing_id"))
    df = attach_group_stats(df, ["manufacturer", "model"], listings_by_model=F.count("listing_id"))
    df = attach_group_stats(df, ["state"], listings_by_state=F.count("listing_id"))
    return df.select("listing_id", "listings_by_manufacturer", "listings_by_model", "listings_by_state",
                     half_up(F.col("listings_by_manufacturer") / total, 8).alias("market_share_manufacturer"),
                     half_up(F.col("listings_by_model") / F.col("listings_by_state"), 8).alias("competition_density"))


@query("weekly_model_prices", "WN7", f"""WITH p AS (SELECT manufacturer, model, price, cast(year({_LOCAL}) as int) AS posting_year, cast(week({_LOCAL}) as int) AS posting_week
FROM listings WHERE manufacturer IS NOT NULL)
SELECT manufacturer, model, posting_year, posting_week, {r('avg(price)', 4)} AS price_avg_by_week, {r('stddev_samp(price)', 4)} AS price_std_by_week, {n()} AS listings FROM p GROUP BY 1, 2, 3, 4""")
def _(k):
    df = k.listings("manufacturer", "model", "price", "posting_date").where("manufacturer is not null")
    parts = calendar_parts(local_time(F.col("posting_date")))
    df = df.withColumns({c: parts[c] for c in ("posting_year", "posting_week")})
    return df.groupBy("manufacturer", "model", "posting_year", "posting_week").agg(
        half_up(F.avg("price"), 4).alias("price_avg_by_week"), half_up(F.stddev_samp("price"), 4).alias("price_std_by_week"),
        F.count("*").alias("listings"))


_BASE = f"""WITH b AS (SELECT *, {_PARTS}, {_CODE} AS condition_numeric FROM listings WHERE price > 0 AND year >= 1990 AND posting_date IS NOT NULL AND state IS NOT NULL),
a AS (SELECT *, (SELECT max(posting_year) FROM b) - year AS vehicle_age, cast((SELECT max(posting_date) FROM b) - posting_date as bigint) AS days_on_market,
(SELECT count(*) FROM b) AS total FROM b),
mk AS (SELECT manufacturer, avg(price) AS p, avg(odometer) AS km, count(*) AS q FROM b WHERE manufacturer IS NOT NULL GROUP BY 1),
md AS (SELECT manufacturer, model, avg(price) AS p, avg(odometer) AS km, count(*) AS q, avg(condition_numeric) AS ca, stddev_samp(condition_numeric) AS cs FROM b WHERE manufacturer IS NOT NULL GROUP BY 1, 2),
ty AS (SELECT type, avg(price) AS p, count(*) AS q FROM b GROUP BY 1), st AS (SELECT state, avg(price) AS p, count(*) AS q, avg(latitude) AS lat2, avg(longitude) AS lon2 FROM b GROUP BY 1),
wk AS (SELECT manufacturer, model, posting_year, posting_week, avg(price) AS p, stddev_samp(price) AS s FROM b WHERE manufacturer IS NOT NULL GROUP BY 1, 2, 3, 4),
mo AS (SELECT manufacturer, model, posting_year, posting_month, avg(price) AS p, stddev_samp(price) AS s FROM b WHERE manufacturer IS NOT NULL GROUP BY 1, 2, 3, 4)"""
_PLAIN = ["listing_id", "price", "manufacturer", "model", "type", "fuel", "transmission", "condition", "state", "region",
          "year", "odometer", "latitude", "longitude", "posting_year", "posting_month", "posting_day", "posting_dayofweek",
          "posting_quarter", "posting_week", "condition_numeric", "vehicle_age", "days_on_market"]
_AGE = "CASE WHEN vehicle_age = 0 THEN 1 ELSE vehicle_age END"
_FEATURES = {
    "avg_price_by_manufacturer": r("mk.p", 4), "avg_price_by_model": r("md.p", 4), "avg_price_by_type": r("ty.p", 4),
    "avg_price_by_state": r("st.p", 4), "avg_miles_by_manufacturer": r("mk.km", 4), "avg_miles_by_model": r("md.km", 4),
    "price_avg_by_week": r("wk.p", 4), "price_std_by_week": r("wk.s", 4), "price_avg_by_month": r("mo.p", 4), "price_std_by_month": r("mo.s", 4),
    "price_per_year": r(f"price / {_AGE}", 4), "price_per_mile": r("price / nullif(odometer, 0)", 4),
    "price_position_manufacturer": r("(price - mk.p) / nullif(mk.p, 0)", 4), "price_position_model": r("(price - md.p) / nullif(md.p, 0)", 4),
    "price_position_type": r("(price - ty.p) / nullif(ty.p, 0)", 4), "miles_per_year": r(f"odometer / {_AGE}", 4),
    "miles_position": r("(odometer - md.km) / nullif(md.km, 0)", 4), "condition_relative": r("(condition_numeric - md.ca) / nullif(md.cs, 0)", 4),
    "listings_by_manufacturer": "cast(mk.q as bigint)", "listings_by_model": "cast(md.q as bigint)", "listings_by_type": "cast(ty.q as bigint)",
    "listings_by_state": "cast(st.q as bigint)", "competitors_same_model": "cast(md.q as bigint)", "competitors_same_type": "cast(ty.q as bigint)",
    "competitors_same_state": "cast(st.q as bigint)", "market_share_manufacturer": r("mk.q / total", 4), "market_share_model": r("md.q / total", 4),
    "is_weekend": "cast(a.posting_dayofweek IN (5, 6) as int)", "is_holiday": "cast(a.posting_month IN (12, 1) as int)",
    "is_summer": "cast(a.posting_month IN (6, 7, 8) as int)", "is_winter": "cast(a.posting_month IN (12, 1, 2) as int)",
    "age_mileage_ratio": r("vehicle_age / nullif(odometer, 0)", 4), "price_mileage_ratio": r("price / nullif(odometer, 0)", 4),
    "price_age_ratio": r(f"price / {_AGE}", 4), "competition_density": r("md.q / st.q", 4),
    "is_luxury": "0", "is_economy": "0", "is_american": "0", "is_electric": "cast(fuel = 'electric' as int)", "is_hybrid": "0",
    "description_length": "cast(length(description) as int)", "has_description": "cast(description IS NOT NULL as int)",
    "description_mentions_new": "cast(coalesce(contains(lower(description), 'new'), false) as int)",
    "description_mentions_warranty": "cast(coalesce(contains(lower(description), 'warranty'), false) as int)",
    "description_mentions_clean": "cast(coalesce(contains(lower(description), 'clean'), false) as int)",
    "distance_to_state_center": r(_HAV, 4),
}


@query("feature_table", "FT1 WN2 WN3 WN4 WN5 WN6 WN7 WN8", f"""{_BASE} SELECT {', '.join('a.' + c for c in _PLAIN)}, has_installments, installments, down_payment, monthly_payment,
{', '.join(f'{x} AS {c}' for c, x in _FEATURES.items())} FROM a LEFT JOIN mk ON a.manufacturer = mk.manufacturer
LEFT JOIN md ON a.manufacturer = md.manufacturer AND a.model = md.model LEFT JOIN ty ON a.type = ty.type LEFT JOIN st ON a.state = st.state
LEFT JOIN wk ON a.manufacturer = wk.manufacturer AND a.model = wk.model AND a.posting_year = wk.posting_year AND a.posting_week = wk.posting_week
LEFT JOIN mo ON a.manufacturer = mo.manufacturer AND a.model = mo.model AND a.posting_year = mo.posting_year AND a.posting_month = mo.posting_month""")
def _(k):
    wide = ft.feature_table(k.listings(), "listing_id")
    return rounded(wide, 4, ("price", "odometer", "latitude", "longitude", "down_payment", "monthly_payment"))


@query("short_features", "FT3 JN8", f"""WITH a AS (SELECT manufacturer, avg(price) AS p FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1)
SELECT listing_id, {AS_OF_YEAR} - year AS vehicle_age, {r(f'price / CASE WHEN year = {AS_OF_YEAR} THEN 1 ELSE {AS_OF_YEAR} - year END', 4)} AS price_per_year,
{r('price / nullif(odometer, 0)', 4)} AS price_per_mile, cast(coalesce(length(description), 0) as int) AS description_length, {r('p', 4)} AS make_avg_price
FROM listings LEFT JOIN a USING (manufacturer)""")
def _(k):
    rows = ft.notebook_features(k.listings("listing_id", "manufacturer", "price", "odometer", "year", "description"), AS_OF_YEAR)
    return rounded(rows.select("listing_id", "vehicle_age", "price_per_year", "price_per_mile", "description_length", "make_avg_price"))


@query("price_outside_quantiles", "JN4", f"""WITH q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM listings WHERE price BETWEEN 5000 AND 1000000)
SELECT fuel, {n()} AS listings, {n('CASE WHEN price < a THEN 1 END')} AS below, {n('CASE WHEN price > b THEN 1 END')} AS above FROM listings, q WHERE price BETWEEN 5000 AND 1000000 GROUP BY 1""")
def _(k):
    from forecourt.operators.quantiles import quantile_values
    rows = k.listings("fuel", "price").where("price between 5000 and 1000000")
    q = quantile_values(rows, "price", {"a": 0.25, "b": 0.75})
    return rows.withColumn("q", q).groupBy("fuel").agg(
        F.count("*").alias("listings"), F.count_if(F.col("price") < F.col("q.a")).alias("below"),
        F.count_if(F.col("price") > F.col("q.b")).alias("above"))
