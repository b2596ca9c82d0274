"""Time series and sampling questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.functions.numbers import half_up
from forecourt.operators import sampling as sm
from forecourt.operators import series as se
from forecourt.plans.registry import m, n, query, r

_DAILY = "daily AS (SELECT posting_date AS period, avg(price) AS price_mean, count(*) AS listing_count FROM listings GROUP BY 1)"


def daily(k):
    return se.resample(k.listings("posting_date", "price"), "posting_date", "day",
                       price_mean=F.avg("price"), listing_count=F.count("*"))


def monthly(k):
    return se.resample(k.listings("posting_date", "price"), "posting_date", "month", price_mean=F.avg("price"))


@query("daily_series", "ML24", f"WITH {_DAILY} SELECT period, {r('price_mean', 4)} AS price_mean, cast(listing_count as bigint) AS listing_count FROM daily")
def _(k):
    return daily(k).withColumn("price_mean", half_up("price_mean", 4))


@query("event_daily_series", "ML24", f"SELECT cast(ts as date) AS period, {r('avg(value)', 4)} AS value_mean, {n()} AS events FROM events GROUP BY 1")
def _(k):
    return se.resample(k.table("events"), "ts", "day", value_mean=half_up(F.avg("value"), 4), events=F.count("*"))


@query("monthly_series", "ML24", f"""SELECT cast(date_trunc('month', posting_date) as date) AS period, {r('avg(price)', 4)} AS price_mean, {n()} AS listing_count,
{r('avg(odometer)', 4)} AS mileage_mean FROM listings GROUP BY 1""")
def _(k):
    return se.resample(k.listings("posting_date", "price", "odometer"), "posting_date", "month", price_mean=half_up(F.avg("price"), 4),
                       listing_count=F.count("*"), mileage_mean=half_up(F.avg("odometer"), 4))


for _value in ("price_mean", "listing_count"):
    @query(f"rolling_events_{_value}", "WN9", f"""WITH {_DAILY}, z AS (SELECT period, CASE WHEN count({_value}) OVER w = 30 THEN
({_value} - avg({_value}) OVER w) / nullif(stddev_samp({_value}) OVER w, 0) END AS z FROM daily WINDOW w AS (ORDER BY period ROWS BETWEEN 29 PRECEDING AND CURRENT ROW))
SELECT period, {r('z', 6)} AS z_score FROM z WHERE abs(z) > 2""")
    def _(k, value=_value):
        return se.rolling_events(daily(k), value).where("is_event").select("period", half_up("z_score", 6).alias("z_score"))


@query("trailing_mean", "WN10", f"""WITH {_DAILY} SELECT {r('avg(listing_count)', 4)} AS last_week_mean, {r('(SELECT median(listing_count) FROM daily)', 4)} AS median_count
FROM (SELECT listing_count FROM daily ORDER BY period DESC LIMIT 7)""")
def _(k):
    d = daily(k)
    return d.agg(half_up(F.median("listing_count"), 4).alias("median_count")).withColumn(
        "last_week_mean", half_up(se.trailing_mean(d, "listing_count"), 4))


_DECOMPOSE = """WITH s AS (SELECT cast(date_trunc('month', posting_date) as date) AS period, avg(price) AS y, row_number() OVER (ORDER BY date_trunc('month', posting_date)) - 1 AS i FROM listings GROUP BY date_trunc('month', posting_date)),
t AS (SELECT *, CASE WHEN count(y) OVER (ORDER BY i ROWS BETWEEN 6 PRECEDING AND 6 FOLLOWING) = 13 THEN
(sum(y) OVER (ORDER BY i ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING) + (lag(y, 6) OVER (ORDER BY i) + lead(y, 6) OVER (ORDER BY i)) / 2) / 12 END AS tr FROM s),
e AS (SELECT min(i) AS a, max(i) AS b FROM t WHERE tr IS NOT NULL),
f AS (SELECT regr_slope(tr, i) AS fs, regr_intercept(tr, i) AS fi FROM t, e WHERE tr IS NOT NULL AND i < least(a + 12, b)),
g AS (SELECT regr_slope(tr, i) AS bs, regr_intercept(tr, i) AS bi FROM t, e WHERE tr IS NOT NULL AND i >= greatest(a, b - 12) AND i < b),
u AS (SELECT period, i, y, CASE WHEN i < a THEN fs * i + fi WHEN i > b THEN bs * i + bi ELSE tr END AS trend FROM t, e, f, g),
p AS (SELECT i % 12 AS ph, avg(y - trend) AS mu FROM u GROUP BY 1), q AS (SELECT ph, mu - avg(mu) OVER () AS seasonal FROM p)"""


@query("seasonal_decomposition", "WN13", f"""{_DECOMPOSE} SELECT period, {r('y', 4)} AS price_mean, {r('trend', 4)} AS trend, {r('seasonal', 4)} AS seasonal,
{r('y - trend - seasonal', 4)} AS residual FROM u JOIN q ON u.i % 12 = ph""")
def _(k):
    out = se.decompose(monthly(k), "price_mean")
    return out.select("period", *[half_up(c, 4).alias(c) for c in ("price_mean", "trend", "seasonal", "residual")])


@query("season_extremes", "ML23", f"""WITH {_DAILY}, c AS (SELECT period, price_mean - avg(price_mean) OVER () AS s FROM daily),
y AS (SELECT 'yearly' AS component, cast(month(period) as int) AS unit, avg(s) AS level FROM c GROUP BY 2 UNION ALL SELECT 'weekly', cast(isodow(period) - 1 as int), avg(s) FROM c GROUP BY 2)
SELECT component, arg_max(unit, level) AS peak, arg_min(unit, level) AS trough, {r('max(level) - min(level)', 4)} AS amplitude FROM y GROUP BY 1""")
def _(k):
    from pyspark.sql import Window
    d = daily(k)
    centred = d.withColumn("s", F.col("price_mean") - F.avg("price_mean").over(Window.partitionBy()))
    return se.season_extremes(centred, "period", "s")


_ROBUST = """g AS (SELECT posting_date AS period, price FROM listings WHERE price > 100 AND price < (SELECT quantile_cont(price, 0.99) FROM listings)),
d AS (SELECT period, avg(price) AS price_mean, median(price) AS price_median, stddev_samp(price) AS price_std, count(*) AS listing_count FROM g GROUP BY 1),
q AS (SELECT quantile_cont(price_median, 0.1) AS a, quantile_cont(price_median, 0.9) AS b FROM d)"""


@query("robust_daily_series", "ML20", f"""WITH {_ROBUST} SELECT period, {r('price_mean', 4)} AS price_mean, {r('price_median', 4)} AS price_median, {r('price_std', 4)} AS price_std,
cast(listing_count as bigint) AS listing_count FROM d, q WHERE price_median BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""")
def _(k):
    out = se.robust_daily(k.listings("posting_date", "price"), "posting_date")
    return out.withColumns({c: half_up(c, 4) for c in ("price_mean", "price_median", "price_std")})


@query("forecast_metrics", "ML22", f"""WITH {_DAILY}, p AS (SELECT price_mean AS y, avg(price_mean) OVER (ORDER BY period ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS h FROM daily),
f AS (SELECT * FROM p WHERE y IS NOT NULL AND h IS NOT NULL), mu AS (SELECT avg(y) AS my, avg(h) AS mh FROM f)
SELECT {r('avg(abs(y - h))', 4)} AS mae, {r('avg(pow(y - h, 2))', 2)} AS mse, {r('sqrt(avg(pow(y - h, 2)))', 4)} AS rmse, {r('avg(abs((y - h) / nullif(y, 0))) * 100', 4)} AS mape,
{r('avg(abs((y / my - h / mh) / nullif(y / my, 0))) * 100', 4)} AS normalised_mape FROM f, mu""")
def _(k):
    from pyspark.sql import Window
    before = Window.orderBy("period").rowsBetween(-7, -1)
    rows = daily(k).withColumn("naive", F.avg("price_mean").over(before))
    plain = se.forecast_metrics(rows, "price_mean", "naive")
    scaled = se.forecast_metrics(rows, "price_mean", "naive", normalised=True)
    out = plain.withColumn("normalised_mape", half_up(scaled.select("mape").scalar(), 4))
    return out.withColumns({"mae": half_up("mae", 4), "mse": half_up("mse", 2), "rmse": half_up("rmse", 4), "mape": half_up("mape", 4)})


_STRATA = ["manufacturer", "year", "fuel", "state"]


_QUOTAS = f"""WITH c AS (SELECT manufacturer, year, count(*) AS q, row_number() OVER (ORDER BY count(*) DESC, manufacturer NULLS FIRST, year) AS o FROM listings GROUP BY 1, 2),
z AS (SELECT *, cast(round_even(q / (SELECT sum(q) FROM c) * 1003, 0) as bigint) AS s FROM c),
lv AS (SELECT s - j AS h, o, manufacturer, year, row_number() OVER (ORDER BY s - j DESC, o) AS rn FROM z, range(0, 200) t(j) WHERE j < s)
SELECT z.manufacturer, z.year, cast(z.q as bigint) AS listings, cast(z.s - count(lv.o) as bigint) AS quota FROM z LEFT JOIN lv ON lv.o = z.o AND lv.rn <= (SELECT sum(s) FROM z) - 1003 GROUP BY z.manufacturer, z.year, z.q, z.s"""


@query("sample_quotas", "WN14 SL4", _QUOTAS)
def _(k):
    counts = k.listings("manufacturer", "year").groupBy("manufacturer", "year").agg(F.count("*").alias("listings"))
    return sm.quotas(counts, 1003, "listings")


@query("stratified_sample_sizes", "SL4", f"SELECT manufacturer, year, quota AS drawn FROM ({_QUOTAS}) WHERE quota > 0")
def _(k):
    # every stratum gives as many rows as its quota asks for
    rows = sm.stratified_sample(k.listings("listing_id", "manufacturer", "year"), ["manufacturer", "year"], "listing_id", 1003)
    return rows.groupBy("manufacturer", "year").agg(F.count("*").alias("drawn"))


@query("stratified_sample", "SL4")
def _(k):
    return sm.stratified_sample(k.listings("listing_id", "price", *_STRATA), _STRATA, "listing_id")


@query("bounded_sample", "SL5")
def _(k):
    return sm.bounded_sample(k.listings("listing_id", "price", "latitude", "longitude"), "listing_id")


@query("bounded_sample_size", "SL5", """SELECT least(count(*), 5000) AS listings FROM listings""")
def _(k):
    return sm.bounded_sample(k.listings("listing_id", "price"), "listing_id").agg(F.count("*").alias("listings"))


@query("train_test_rows", "SL6", """SELECT count(*) AS listings, cast(0 as bigint) AS in_both FROM listings""")
def _(k):
    train, test = sm.split(k.listings("listing_id", "price"), "listing_id")
    both = train.select("listing_id").intersect(test.select("listing_id"))
    sizes = train.unionByName(test).agg(F.count("*").alias("listings"))
    return sizes.withColumn("in_both", both.agg(F.count("*")).scalar())


@query("train_test_sizes", "SL6")
def _(k):
    train, test = sm.split(k.listings("listing_id", "price"), "listing_id")
    sizes = [d.agg(F.lit(name).alias("part"), F.count("*").alias("listings"), half_up(F.avg("price")).alias("avg_price"))
             for name, d in (("train", train), ("test", test))]
    return sizes[0].unionByName(sizes[1])
