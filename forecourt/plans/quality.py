"""Data quality, statistics and drift questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.functions.numbers import half_up
from forecourt.operators import drift as dr
from forecourt.operators import quality as qu
from forecourt.operators import statistics as st
from forecourt.plans.registry import n, query, r

AS_OF_YEAR = 2002
NUMERIC = ["price", "year", "odometer"]
TEXTS = ["manufacturer", "condition", "fuel", "transmission"]
CUT = "1999-01-01"


def _sides(k, *columns):
    df = k.listings(*columns, "posting_date")
    late = F.col("posting_date") >= F.lit(CUT).cast("date")
    return df.where(~late), df.where(late)


def _checks(pairs):
    return " UNION ALL ".join(f"""SELECT '{name}' AS "check", cast({x} as bigint) AS listings FROM listings""" for name, x in pairs)


_REQ = ["manufacturer", "model", "year", "price", "odometer", "fuel", "transmission", "state", "posting_date"]


@query("raw_checks", "DQ1", _checks(
    [(f"missing_column:{c}", "max(0)") for c in _REQ] + [(f"nulls:{c}", f"count(*) FILTER (WHERE {c} IS NULL)") for c in _REQ]
    + [("out_of_range:year", f"count(*) FILTER (WHERE year < 1900 OR year > {AS_OF_YEAR + 1})"),
       ("out_of_range:price", "count(*) FILTER (WHERE price < 0)"), ("out_of_range:odometer", "count(*) FILTER (WHERE odometer < 0)")]))
def _(k):
    return qu.raw_checks(k.listings(*_REQ), AS_OF_YEAR)


def _suite_sql(suite, columns):
    parts = []
    for i, e in enumerate(suite):
        if e.kind == "exists":
            seen = "1.0" if e.column in columns else "0.0"
        elif e.kind == "row_count":
            seen = "count(*)"
        elif e.kind == "not_null":
            seen = f"count({e.column}) / count(*)"
        elif e.kind == "between":
            seen = f"coalesce(count(*) FILTER (WHERE {e.column} BETWEEN {e.low} AND {e.high}) / nullif(count({e.column}), 0), 1)"
        else:
            seen = f"coalesce(count(*) FILTER (WHERE {e.column} IN {e.values}) / nullif(count({e.column}), 0), 1)"
        if e.kind == "exists":
            seen = f"max({seen})"
        ok = f"{seen} >= {e.low if e.kind == 'row_count' else e.mostly}"
        name = f"'{e.column}'" if e.column else "cast(NULL as varchar)"
        parts.append(f"SELECT {i} AS position, '{e.kind}' AS expectation, {name} AS column_name, {r(f'cast({seen} as double)', 6)} AS observed, {ok} AS success FROM listings")
    return " UNION ALL ".join(parts)


_SUITE_COLUMNS = ["price", "year", "odometer", "manufacturer", "state", "fuel", "transmission"]


@query("raw_expectations", "DQ2", _suite_sql(qu.raw_suite(AS_OF_YEAR), _SUITE_COLUMNS))
def _(k):
    return qu.validate(k.listings(*_SUITE_COLUMNS), qu.raw_suite(AS_OF_YEAR)).withColumn("observed", half_up("observed", 6))


@query("clean_expectations", "DQ2", _suite_sql(qu.clean_suite(AS_OF_YEAR), [*_SUITE_COLUMNS, "vehicle_age"]))
def _(k):
    df = k.listings(*_SUITE_COLUMNS).withColumn("vehicle_age", F.lit(AS_OF_YEAR) - F.col("year"))
    return qu.validate(df, qu.clean_suite(AS_OF_YEAR)).withColumn("observed", half_up("observed", 6))


@query("failed_gate_lines", "DQ3", f"SELECT expectation, column_name FROM ({_suite_sql(qu.clean_suite(AS_OF_YEAR), _SUITE_COLUMNS)}) WHERE NOT success")
def _(k):
    return qu.validate(k.listings(*_SUITE_COLUMNS), qu.clean_suite(AS_OF_YEAR)).where("not success").select("expectation", "column_name")


_PROFILE = {"price": "double", "year": "int", "odometer": "double", "manufacturer": "string", "posting_date": "date"}


@query("column_profile", "DQ4", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, '{t}' AS type, {n()} AS total_rows, cast(count(*) FILTER (WHERE {c} IS NULL) as bigint) AS nulls, """
    + (f"{r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, cast(min({c}) as double) AS min, cast(max({c}) as double) AS max"
       if t in ("double", "int") else "cast(NULL as double) AS mean, cast(NULL as double) AS std, cast(NULL as double) AS min, cast(NULL as double) AS max")
    + " FROM listings" for c, t in _PROFILE.items()))
def _(k):
    return qu.profile(k.listings(*_PROFILE))


@query("top_values", "DQ4 DQ6", " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{c}' AS column_name, {c} AS value, {n()} AS total, cast(row_number() OVER (ORDER BY count(*) DESC, {c}) as int) AS place
FROM listings WHERE {c} IS NOT NULL GROUP BY 2) WHERE place <= 5""" for c in TEXTS))
def _(k):
    return qu.top_values(k.listings(*TEXTS), TEXTS)


@query("numeric_metrics", "DQ5", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {r(f'avg({c})', 4)} AS mean, {r(f'stddev_samp({c})', 4)} AS std, cast(min({c}) as double) AS min, cast(max({c}) as double) AS max,
{r('any_value(a)')} AS q1, {r(f'median({c})')} AS median, {r('any_value(b)')} AS q3, {r(f'count(*) FILTER (WHERE {c} IS NULL) / count(*)', 6)} AS missing_rate,
{n(f'DISTINCT {c}')} AS unique_count, cast(count(*) FILTER (WHERE {c} < a - 1.5 * (b - a) OR {c} > b + 1.5 * (b - a)) as bigint) AS outliers_count
FROM listings, (SELECT quantile_cont({c}, 0.25) AS a, quantile_cont({c}, 0.75) AS b FROM listings) q""" for c in NUMERIC))
def _(k):
    return qu.numeric_metrics(k.listings(*NUMERIC), NUMERIC)


@query("category_metrics", "DQ6", " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {n('v')} AS unique_count, {r('coalesce(sum(q) FILTER (WHERE v IS NULL), 0) / sum(q)', 6)} AS missing_rate,
(SELECT {c} FROM listings WHERE {c} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode,
{r('-sum(p * ln(p)) FILTER (WHERE v IS NOT NULL)', 6)} AS entropy FROM (SELECT {c} AS v, count(*) AS q, count(*) / sum(count({c})) OVER () AS p FROM listings GROUP BY 1)"""
    for c in TEXTS))
def _(k):
    return qu.category_metrics(k.listings(*TEXTS), TEXTS)


_KS_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name, {r('max(abs(a - b))', 6)} AS statistic, cast(max(na) as bigint) AS reference_rows, cast(max(nb) as bigint) AS current_rows FROM (
SELECT {c}, sum(sum(cast(posting_date < DATE '1999-01-01' as int))) OVER w / sum(sum(cast(posting_date < DATE '1999-01-01' as int))) OVER () AS a,
sum(sum(cast(posting_date >= DATE '1999-01-01' as int))) OVER w / sum(sum(cast(posting_date >= DATE '1999-01-01' as int))) OVER () AS b,
sum(sum(cast(posting_date < DATE '1999-01-01' as int))) OVER () AS na, sum(sum(cast(posting_date >= DATE '1999-01-01' as int))) OVER () AS nb
FROM listings WHERE {c} IS NOT NULL GROUP BY {c} WINDOW w AS (ORDER BY {c}))""" for c in NUMERIC)


@query("numeric_drift", "DQ7", _KS_SQL)
def _(k):
    return dr.numeric_drift(*_sides(k, *NUMERIC), NUMERIC).withColumn("statistic", half_up("statistic", 6))


_SIDE = "CASE WHEN posting_date < DATE '1999-01-01' THEN 'r' ELSE 'c' END"


def _chi_sql(c, row_expr, label, fill=False):
    v = f"coalesce(cast({c} as varchar), 'MISSING')" if fill else c
    keep = "" if fill else f" WHERE {c} IS NOT NULL"
    return f"""SELECT '{label}' AS column_name, {r('CASE WHEN any_value(f) = 1 THEN sum(pow(abs(o - e) - least(abs(o - e), 0.5), 2) / e) ELSE sum(pow(o - e, 2) / e) END', 4)} AS statistic,
cast(any_value(f) as bigint) AS degrees_of_freedom FROM (SELECT coalesce(q, 0) AS o, rt * ct / t AS e, (count(DISTINCT a.x) OVER () - 1) * (count(DISTINCT b.v) OVER () - 1) AS f FROM
(SELECT {row_expr} AS x, count(*) AS rt, sum(count(*)) OVER () AS t FROM listings{keep} GROUP BY 1) a CROSS JOIN
(SELECT {v} AS v, count(*) AS ct FROM listings{keep} GROUP BY 1) b LEFT JOIN
(SELECT {row_expr} AS x, {v} AS v, count(*) AS q FROM listings{keep} GROUP BY 1, 2) c ON c.x = a.x AND c.v = b.v)"""


@query("category_drift", "DQ8 JN14", " UNION ALL ".join(_chi_sql(c, _SIDE, c) for c in TEXTS))
def _(k):
    return dr.category_drift(*_sides(k, *TEXTS), TEXTS).withColumn("statistic", half_up("statistic", 4))


@query("aligned_categories", "JN14", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, {c} AS value, cast(count(*) FILTER (WHERE year <= 1996) as bigint) AS reference,
cast(count(*) FILTER (WHERE year >= 2001) as bigint) AS current FROM listings WHERE {c} IS NOT NULL AND (year <= 1996 OR year >= 2001) GROUP BY 2""" for c in ("manufacturer", "fuel", "year")).replace(
    "year AS value", "cast(year as varchar) AS value"))
def _(k):
    df = k.listings("manufacturer", "fuel", "year")
    return dr.aligned_counts(df.where("year <= 1996"), df.where("year >= 2001"), ["manufacturer", "fuel", "year"])


@query("drift_statistics", "DQ7 DQ8", f"""SELECT column_name, 'ks' AS test, statistic FROM ({_KS_SQL})
UNION ALL SELECT column_name, 'chi_square', statistic FROM ({' UNION ALL '.join(_chi_sql(c, _SIDE, c) for c in TEXTS)})""")
def _(k):
    # the report's statistics; SQL has none of its probabilities
    found = dr.drift_report(*_sides(k, *NUMERIC, *TEXTS), NUMERIC, TEXTS)
    return found.select("column_name", "test", F.when(F.col("test") == "ks", half_up("statistic", 6)).otherwise(half_up("statistic", 4)).alias("statistic"))


@query("drift_report", "DQ7 DQ8")
def _(k):
    return dr.drift_report(*_sides(k, *NUMERIC, *TEXTS), NUMERIC, TEXTS)


_MONEY = ["price", "monthly_payment", "down_payment"]


@query("invalid_values", "DQ10", _checks(
    [(f"overflow:{c}", f"count(*) FILTER (WHERE {c} > 99999999.99)") for c in _MONEY]
    + [(f"negative:{c}", f"count(*) FILTER (WHERE {c} < 0)") for c in _MONEY]
    + [(f"missing:{c}", f"count(*) FILTER (WHERE {c} IS NULL)") for c in ("manufacturer", "model", "year", "price")]
    + [("bad_year", "count(*) FILTER (WHERE year < 1900 OR year > 2024)")]))
def _(k):
    return qu.invalid_values(k.listings("manufacturer", "model", "year", *_MONEY))


@query("make_anomalies", "DQ11", f"""WITH s AS (SELECT manufacturer, avg(price) AS mean, stddev_samp(price) AS sd FROM listings GROUP BY 1),
f AS (SELECT l.manufacturer, CASE WHEN price < mean * 0.1 THEN 'too_low' WHEN price > mean + 1.5 * sd THEN 'too_high' END AS price_anomaly FROM listings l JOIN s ON l.manufacturer = s.manufacturer)
SELECT manufacturer, price_anomaly, {n()} AS listings FROM f WHERE price_anomaly IS NOT NULL GROUP BY 1, 2""")
def _(k):
    # 3 standard deviations leave no price out in these tables
    odd = qu.make_anomalies(k.listings("manufacturer", "price"), spread=1.5)
    return odd.groupBy("manufacturer", "price_anomaly").agg(F.count("*").alias("listings"))


@query("price_distribution", "ST1", f"""SELECT {r('avg(price)')} AS mean, {r('median(price)')} AS median,
(SELECT price FROM listings WHERE price IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS mode, {r('stddev_samp(price)')} AS std,
{r('var_samp(price)', 0)} AS variance, {r('skewness(price)', 6)} AS skewness, {r('kurtosis(price)', 6)} AS kurtosis FROM listings""")
def _(k):
    return st.distribution(k.listings("price"), "price")


@query("quartile_summary", "ST2", f"""WITH s AS (SELECT {n()} AS total_count, {r('avg(price)')} AS mean_price, {r('stddev_samp(price)')} AS std_price, min(price) AS min_price,
max(price) AS max_price, {r('quantile_cont(price, 0.25)')} AS q1, {r('median(price)')} AS median, {r('quantile_cont(price, 0.75)')} AS q3 FROM listings WHERE price BETWEEN 5000 AND 1000000)
SELECT *, {r('(mean_price - median) / std_price', 4)} AS skewness, {r('(q3 - q1) / median', 4)} AS relative_iqr FROM s""")
def _(k):
    return st.quartile_summary(k.listings("price").where("price between 5000 and 1000000"), "price")


@query("robust_distributions", "ST3", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, {r(f'median({c})')} AS median, {r(f'mad({c})')} AS mad,
{r(f'quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)')} AS iqr, {r(f'avg(pow({c} - mu, 3)) / pow(var_pop({c}), 1.5)', 6)} AS skewness, {r(f'kurtosis_pop({c})', 6)} AS kurtosis
FROM listings, (SELECT avg({c}) AS mu FROM listings)""" for c in ("price", "odometer", "latitude")))
def _(k):
    return st.robust_distributions(k.listings("price", "odometer", "latitude"), ["price", "odometer", "latitude"])


def _robust_sql(label, value, where):
    return f"""SELECT '{label}' AS group_column, {value} AS group_value, {n()} AS count, {r('median(price)')} AS median, {r('mad(price)')} AS mad,
{r('quantile_cont(price, 0.75) - quantile_cont(price, 0.25)')} AS iqr FROM listings WHERE price IS NOT NULL{where} GROUP BY 2"""


@query("robust_prices", "ST4", " UNION ALL ".join([_robust_sql("overall", "'all'", "")] + [
    _robust_sql(c, f"cast({c} as varchar)", f" AND {c} IS NOT NULL") for c in ("manufacturer", "fuel", "year")]))
def _(k):
    return st.robust_prices(k.listings("manufacturer", "fuel", "year", "price"), ["manufacturer", "fuel", "year"])


@query("median_confidence", "ST5")
def _(k):
    return st.bootstrap_median(k.listings("price"), "price")


@query("correlations", "ST6", " UNION ALL ".join(f"""SELECT '{a}' AS x, '{b}' AS y, cast(count(*) FILTER (WHERE {a} IS NOT NULL AND {b} IS NOT NULL) as bigint) AS pairs,
{r(f'corr({a}, {b})', 6)} AS correlation FROM listings""" for a, b in (("price", "odometer"), ("price", "year"), ("odometer", "year"))))
def _(k):
    out = st.correlations(k.listings("price", "odometer", "year"), ["price", "odometer", "year"])
    return out.select("x", "y", "pairs", half_up("correlation", 6).alias("correlation"))


@query("correlation_significance", "ST6")
def _(k):
    return st.correlations(k.listings("price", "odometer", "year"), ["price", "odometer", "year"])


@query("largest_outliers", "SL2", """WITH q AS (SELECT quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM listings)
SELECT listing_id, manufacturer, price FROM listings, q WHERE price > q3 + (q3 - q1) * 0.25 ORDER BY price DESC, listing_id LIMIT 5""")
def _(k):
    # no price lies beyond the usual fence of 1.5 here
    return st.largest_outliers(k.listings("listing_id", "manufacturer", "price"), "price", "listing_id", fence=0.25)


@query("iqr_outliers", "ST7", f"""WITH q AS (SELECT quantile_cont(price, 0.25) AS a, quantile_cont(price, 0.75) AS b FROM listings), f AS (SELECT a, b, a - 0.3 * (b - a) AS lo, b + 0.3 * (b - a) AS hi FROM q)
SELECT {r('max(a)')} AS q1, {r('max(b)')} AS q3, {r('max(b - a)')} AS iqr, {r('max(lo)')} AS lower_bound, {r('max(hi)')} AS upper_bound,
cast(count(*) FILTER (WHERE price < lo) as bigint) AS low_outliers, cast(count(*) FILTER (WHERE price > hi) as bigint) AS high_outliers,
{r('count(*) FILTER (WHERE price < lo OR price > hi) * 100.0 / count(*)', 4)} AS outliers_percentage, {r('avg(price) FILTER (WHERE price BETWEEN lo AND hi)')} AS avg_normal FROM listings, f""")
def _(k):
    # the default fence of 1.5 holds every price of these tables
    return st.iqr_outliers(k.listings("price"), "price", fence=0.3)


@query("price_boxes_by_fuel", "ST16", f"""WITH q AS (SELECT fuel, quantile_cont(odometer, 0.25) AS a, quantile_cont(odometer, 0.75) AS b, median(odometer) AS c FROM listings GROUP BY 1)
SELECT fuel, {n()} AS listings, {r('max(a)')} AS q1, {r('max(c)')} AS median, {r('max(b)')} AS q3, min(odometer) FILTER (WHERE odometer BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS lower_whisker,
max(odometer) FILTER (WHERE odometer BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) AS upper_whisker,
cast(count(*) FILTER (WHERE NOT odometer BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)) as bigint) AS outliers FROM listings JOIN q USING (fuel) WHERE odometer IS NOT NULL GROUP BY 1""")
def _(k):
    return st.box_figures(k.listings("fuel", "odometer"), "fuel", "odometer")


@query("mahalanobis_price_mileage", "ST8", f"""WITH q AS (SELECT median(price) AS pm, quantile_cont(price, 0.75) - quantile_cont(price, 0.25) AS ps, median(odometer) AS om,
quantile_cont(odometer, 0.75) - quantile_cont(odometer, 0.25) AS os FROM listings), z AS (SELECT (coalesce(price, pm) - pm) / ps AS a, (coalesce(odometer, om) - om) / os AS b FROM listings, q),
c AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS ab FROM z),
d AS (SELECT sqrt(((a - ma) * (a - ma) * vb - 2 * (a - ma) * (b - mb) * ab + (b - mb) * (b - mb) * va) / (va * vb - ab * ab)) AS d FROM z, c)
SELECT d > sqrt(-2 * ln(0.25)) AS is_outlier, {n()} AS listings, {r('avg(d)', 4)} AS avg_distance FROM d GROUP BY 1""")
def _(k):
    # with two columns the cut at a share s is sqrt(-2 ln(1 - s)); three in four are inside here, so that both sides are filled
    rows = st.mahalanobis_outliers(k.listings("price", "odometer"), ["price", "odometer"], 0.75)
    return rows.groupBy("is_outlier").agg(F.count("*").alias("listings"), half_up(F.avg("distance"), 4).alias("avg_distance"))


@query("mahalanobis_outliers", "ST8")
def _(k):
    rows = st.mahalanobis_outliers(k.listings("price", "year", "odometer", "latitude", "longitude"),
                                   ["price", "year", "odometer", "latitude", "longitude"])
    return rows.groupBy("is_outlier").agg(F.count("*").alias("listings"), half_up(F.avg("distance"), 4).alias("avg_distance"))


@query("price_mad_anomalies", "ST9", f"""WITH s AS (SELECT median(price) AS md, mad(price) AS mad FROM listings)
SELECT manufacturer, coalesce(abs(price - md) > 1.8 * mad, false) AS is_anomaly, {n()} AS listings FROM listings, s GROUP BY 1, 2""")
def _(k):
    # 3 deviations hold every price of these tables
    rows = st.mad_anomalies(k.listings("manufacturer", "price"), "price", times=1.8)
    return rows.groupBy("manufacturer", "is_anomaly").agg(F.count("*").alias("listings"))


@query("category_associations", "ST11", " UNION ALL ".join(_chi_sql(c, "coalesce(manufacturer, 'MISSING')", c, True) for c in ("fuel", "condition", "state", "transmission")))
def _(k):
    out = dr.associations(k.listings("manufacturer", "fuel", "condition", "state", "transmission"), "manufacturer",
                          ["fuel", "condition", "state", "transmission"])
    return out.select("column_name", half_up("statistic", 4).alias("statistic"), "degrees_of_freedom")


@query("conditional_mode_fill", "ST12", f"""WITH c AS (SELECT state, type, manufacturer, row_number() OVER (PARTITION BY state, type ORDER BY count(*) DESC, manufacturer) AS rn
FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1, 2, 3)
SELECT coalesce(l.manufacturer, c.manufacturer, (SELECT manufacturer FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS manufacturer, l.state, {n()} AS listings
FROM listings l LEFT JOIN c ON l.state = c.state AND l.type = c.type AND rn = 1 GROUP BY 1, 2""")
def _(k):
    rows = st.fill_conditional_modes(k.listings("manufacturer", "state", "type"), "manufacturer", ["state", "type"])
    return rows.groupBy("manufacturer", "state").agg(F.count("*").alias("listings"))


@query("mode_fill", "ST13", f"""SELECT coalesce(manufacturer, (SELECT manufacturer FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS manufacturer, {n()} AS listings FROM listings GROUP BY 1""")
def _(k):
    return st.fill_modes(k.listings("manufacturer"), ["manufacturer"]).groupBy("manufacturer").agg(F.count("*").alias("listings"))


@query("imputation_report", "ST15", " UNION ALL ".join(f"""SELECT '{c}' AS column_name, {n(f'CASE WHEN {c} IS NULL THEN 1 END')} AS missing_before, {r(f'avg({c})', 4)} AS mean_before,
{r(f'stddev_samp({c})', 4)} AS std_before, cast(0 as bigint) AS missing_after, {r(f'avg(coalesce({c}, md))', 4)} AS mean_after, {r(f'stddev_samp(coalesce({c}, md))', 4)} AS std_after,
(SELECT {r('max(abs(a - b))', 6)} FROM (SELECT v, sum(sum(s)) OVER w / sum(sum(s)) OVER () AS a, sum(sum(1 - s)) OVER w / sum(sum(1 - s)) OVER () AS b FROM
(SELECT {c} AS v, 1 AS s FROM listings WHERE {c} IS NOT NULL UNION ALL SELECT coalesce({c}, (SELECT median({c}) FROM listings)), 0 FROM listings) GROUP BY v WINDOW w AS (ORDER BY v))) AS ks_statistic
FROM listings, (SELECT median({c}) AS md FROM listings)""" for c in ("price", "odometer")))
def _(k):
    from forecourt.operators.cleaning import fill_medians
    df = k.listings("price", "odometer")
    return st.imputation_report(df, fill_medians(df, ["price", "odometer"]), ["price", "odometer"])


@query("category_change", "ST15", f"""WITH md AS (SELECT manufacturer AS m FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
b AS (SELECT manufacturer AS value, count(*) / sum(count(*)) OVER () AS p FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1),
a AS (SELECT coalesce(manufacturer, m) AS value, count(*) / sum(count(*)) OVER () AS p FROM listings, md GROUP BY 1)
SELECT 'manufacturer' AS column_name, value, {r('b.p - a.p', 6)} AS change FROM a JOIN b USING (value)""")
def _(k):
    df = k.listings("manufacturer")
    return st.category_change(df, st.fill_modes(df, ["manufacturer"]), ["manufacturer"])
