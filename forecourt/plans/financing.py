"""Financing questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.functions.numbers import half_up
from forecourt.operators import financing as fin
from forecourt.operators.aggregates import summarise
from forecourt.operators.cleaning import price_category, search
from forecourt.operators.joins import known_size, upsert
from forecourt.operators.quantiles import quantiles
from forecourt.plans.registry import m, n, query, r

TERMS = ["has_installments", "monthly_payment", "down_payment", "installments"]
COND = "avg_monthly_payment avg_down_payment avg_installments"


def zeros(names):
    from forecourt.plans.registry import SQL_METRICS
    return ", ".join(f"coalesce({SQL_METRICS[x]}, 0) AS {x}" for x in names.split())


_SERVED = ["total_listings", "avg_price", "min_price", "max_price", "total_financed", *COND.split()]


@query("make_stats_filtered", "AG15 AG18", f"""SELECT manufacturer, {m('total_listings')}, {zeros('avg_price min_price max_price avg_year')},
{m('total_financed')}, {zeros(COND)} FROM listings WHERE year >= 1996 AND year <= 2000 AND price >= 5000 AND price <= 80000 GROUP BY 1""")
def _(k):
    rows = search(k.listings("manufacturer", "year", "price", *TERMS), min_year=1996, max_year=2000,
                  min_price=5000, max_price=80000)
    return fin.zero_averages(summarise(rows, ["manufacturer"], [*_SERVED, "avg_year"]))


@query("make_stats_stored", "AG18", f"""SELECT manufacturer, {m('total_listings')}, {zeros('avg_price min_price max_price')},
{m('total_financed')}, {zeros(COND)} FROM listings GROUP BY 1""")
def _(k):
    listings = k.listings("manufacturer", "year", "price", *TERMS)
    stored = known_size(fin.zero_averages(summarise(listings, ["manufacturer"], _SERVED)))
    return fin.served_stats(listings, stored, ["manufacturer"], _SERVED, min_year=None, max_price=None)


@query("state_stats_filtered", "AG16", f"""SELECT state, {m('total_listings')}, {zeros('avg_price min_price max_price')},
{m('total_financed')}, {zeros(COND)} FROM listings WHERE year >= 1996 AND manufacturer ILIKE '%brand#1%' GROUP BY 1""")
def _(k):
    rows = search(k.listings("state", "manufacturer", "year", "price", *TERMS), min_year=1996, manufacturer="brand#1")
    return fin.zero_averages(summarise(rows, ["state"], _SERVED))


@query("year_stats_filtered", "AG17", f"""SELECT year, {m('total_listings')}, {zeros('avg_price min_price max_price')},
{m('total_financed')}, {zeros(COND)} FROM listings WHERE manufacturer ILIKE '%brand#2%' AND state ILIKE '%nation_1%' GROUP BY 1 ORDER BY 1 DESC""")
def _(k):
    rows = search(k.listings("year", "state", "manufacturer", "price", *TERMS), manufacturer="brand#2", state="nation_1")
    return fin.zero_averages(summarise(rows, ["year"], _SERVED)).orderBy(F.desc("year"))


@query("financing_overview", "AG20", f"""SELECT {m('total_listings total_financed financing_percentage ' + COND + ' avg_price')}
FROM listings WHERE price IS NOT NULL""")
def _(k):
    return summarise(k.listings("price", *TERMS).where("price is not null"), [], [*fin.FINANCE, "avg_price"])


@query("financing_overview_filtered", "AG20", f"""SELECT {m('total_listings total_financed financing_percentage')}, {zeros(COND)}
FROM listings WHERE manufacturer ILIKE '%brand#1%' AND state ILIKE '%nation_2%'""")
def _(k):
    rows = search(k.listings("manufacturer", "state", *TERMS), manufacturer="brand#1", state="nation_2")
    return fin.zero_averages(summarise(rows, [], fin.FINANCE))


@query("financed_terms_distribution", "AG20", " UNION ALL ".join(f"""SELECT '{c}' AS term, {r(f'avg({c})')} AS mean,
{r(f'median({c})')} AS median, cast(min({c}) as double) AS minimum, cast(max({c}) as double) AS maximum FROM listings WHERE has_installments"""
    for c in ("monthly_payment", "down_payment", "installments")))
def _(k):
    names = ["monthly_payment", "down_payment", "installments"]
    rows = k.listings(*TERMS).where("has_installments").select(*[F.col(c).cast("double") for c in names])
    long = rows.unpivot([], names, "term", "amount")
    stats = long.groupBy("term").agg(half_up(F.avg("amount")).alias("mean"),
                                     F.min("amount").alias("minimum"), F.max("amount").alias("maximum"))
    mid = quantiles(long, "amount", {"median": 0.5}, ["term"]).withColumn("median", half_up("median"))
    return stats.join(mid, "term")


@query("installment_analysis", "AG21", ("SELECT " + ", ".join(
    f"coalesce({r(f'avg({c})')}, 0) AS avg_{a}, coalesce(min({c}), 0) AS min_{a}, coalesce(max({c}), 0) AS max_{a}"
    for a, c in (("monthly", "monthly_payment"), ("down", "down_payment"), ("term", "installments")))
    + " FROM listings WHERE has_installments AND price >= 10000 AND price <= 90000 AND manufacturer ILIKE '%brand%'"))
def _(k):
    return fin.terms_summary(search(k.listings("price", "manufacturer", *TERMS), min_price=10000, max_price=90000,
                                    manufacturer="brand"))


@query("make_financing_comparison", "AG22", f"""SELECT manufacturer, {m('total_listings total_financed financing_percentage')}, {zeros(COND)}
FROM listings WHERE manufacturer IN ('brand#1', 'brand#2', 'brand#3') AND year BETWEEN 1996 AND 2000 GROUP BY 1""")
def _(k):
    rows = search(k.listings("manufacturer", "year", *TERMS), min_year=1996, max_year=2000)
    rows = rows.where(F.col("manufacturer").isin("brand#1", "brand#2", "brand#3"))
    return fin.zero_averages(summarise(rows, ["manufacturer"], fin.FINANCE))


_DOLLAR = "CASE " + " ".join(f"WHEN price >= {lo} AND price < {hi if hi != float('inf') else '1e300'} THEN '{label}'"
                             for label, lo, hi in fin.DOLLAR_RANGES) + " END"


@query("financing_by_dollar_range", "AG23", f"""SELECT {_DOLLAR} AS price_range,
{m('total_listings total_financed financing_percentage')}, {zeros(COND)} FROM listings WHERE price >= 0 GROUP BY 1""")
def _(k):
    rows = k.listings("price", *TERMS).withColumn("price_range", fin.dollar_range(F.col("price")))
    return fin.zero_averages(summarise(rows, ["price_range"], fin.FINANCE, drop_null_keys=True))


@query("financing_by_make", "AG24", f"""SELECT manufacturer, {m('total_listings total_financed ' + COND + ' avg_price')} FROM listings
WHERE price IS NOT NULL GROUP BY 1 HAVING count(*) >= 100 ORDER BY total_listings DESC, manufacturer NULLS FIRST LIMIT 10""")
def _(k):
    rows = k.listings("manufacturer", "price", *TERMS).where("price is not null")
    return summarise(rows, ["manufacturer"], ["total_listings", "total_financed", *COND.split(), "avg_price"],
                     min_count=100, order="total_listings", top=10)


_REAL = "CASE " + " ".join(f"WHEN price <= {top} THEN '{label}'" for label, top in fin.REAL_RANGES) + f" ELSE '{fin.REAL_ABOVE}' END"


@query("financing_by_real_range", "AG25", f"""SELECT {_REAL} AS price_range, {m('total_listings total_financed ' + COND + ' avg_price')}
FROM listings WHERE price IS NOT NULL GROUP BY 1 ORDER BY min(price)""")
def _(k):
    rows = k.listings("price", *TERMS).where("price is not null").withColumn("price_range", fin.real_range(F.col("price")))
    out = summarise(rows, ["price_range"], ["total_listings", "total_financed", *COND.split(), "avg_price", "min_price"])
    return out.orderBy("min_price").drop("min_price")


_CUT = "CASE WHEN price <= 0 THEN NULL WHEN price <= 10000 THEN '<10k' WHEN price <= 20000 THEN '10k-20k' WHEN price <= 30000 THEN '20k-30k' WHEN price <= 50000 THEN '30k-50k' WHEN price > 50000 THEN '>50k' END"


@query("financing_by_price_category", "AG25 SF9", f"""SELECT {_CUT} AS price_category, {m('total_listings total_financed')},
{m('mean_monthly_payment mean_down_payment mean_installments financing_percentage')} FROM listings WHERE {_CUT} IS NOT NULL GROUP BY 1""")
def _(k):
    rows = k.listings("price", *TERMS).withColumn("price_category", price_category(F.col("price")))
    return summarise(rows, ["price_category"], ["total_listings", "total_financed", "mean_monthly_payment",
                     "mean_down_payment", "mean_installments", "financing_percentage"], drop_null_keys=True)


_STATS = f"""SELECT manufacturer, model, year, {m('total_listings total_financed ' + COND)}, {r('avg(price)')} AS avg_total_price,
{r('avg(price - down_payment)')} AS avg_original_price, CASE WHEN avg(price - down_payment) > 0 THEN
{r('(avg(price) - avg(price - down_payment)) / avg(price - down_payment) * 100')} ELSE 0 END AS price_difference_percent FROM listings"""


def _with_original(k, *more):
    df = k.listings("manufacturer", "model", "year", "price", *TERMS, *more)
    return df.withColumn("price_original", F.col("price") - F.col("down_payment"))


@query("installment_stats", "AG26", f"{_STATS} GROUP BY 1, 2, 3")
def _(k):
    return fin.installment_stats(_with_original(k))


_VALUES = "total_listings total_financed avg_monthly_payment avg_down_payment avg_installments avg_total_price avg_original_price price_difference_percent".split()


@query("installment_stats_upsert", "JN13", f"""WITH stored AS ({_STATS} WHERE posting_date < DATE '1999-01-01' GROUP BY 1, 2, 3),
fresh AS (SELECT *, true AS is_new FROM ({_STATS} WHERE posting_date >= DATE '1999-01-01' GROUP BY 1, 2, 3))
SELECT coalesce(s.manufacturer, f.manufacturer) AS manufacturer, coalesce(s.model, f.model) AS model, coalesce(s.year, f.year) AS year,
{', '.join(f'CASE WHEN is_new THEN f.{v} ELSE s.{v} END AS {v}' for v in _VALUES)}
FROM stored s FULL OUTER JOIN fresh f ON s.manufacturer IS NOT DISTINCT FROM f.manufacturer AND s.model = f.model AND s.year = f.year""")
def _(k):
    df = _with_original(k, "posting_date")
    cut = F.lit("1999-01-01").cast("date")
    return upsert(fin.installment_stats(df.where(F.col("posting_date") < cut)),
                  fin.installment_stats(df.where(F.col("posting_date") >= cut)), ["manufacturer", "model", "year"])


for _key in ("manufacturer", "state", "year"):
    @query(f"refreshed_stats_by_{_key}", "JN12", f"""WITH stored AS (SELECT {_key}, {n()} AS total_listings FROM listings
WHERE posting_date < DATE '1997-01-01' AND {_key} IS NOT NULL GROUP BY 1)
SELECT s.{_key}, total_listings, (SELECT {n()} FROM listings c WHERE c.{_key} = s.{_key} AND has_installments) AS total_installment_cars,
(SELECT {r('avg(monthly_payment)')} FROM listings c WHERE c.{_key} = s.{_key} AND has_installments) AS avg_monthly_payment,
(SELECT {r('avg(down_payment)')} FROM listings c WHERE c.{_key} = s.{_key} AND has_installments) AS avg_down_payment,
(SELECT {r('avg(installments)')} FROM listings c WHERE c.{_key} = s.{_key} AND has_installments) AS avg_installments FROM stored s""")
    def _(k, key=_key):
        df = k.listings(key, "posting_date", *TERMS)
        stored = summarise(df.where(F.col("posting_date") < F.lit("1997-01-01").cast("date")), [key],
                           ["total_listings"], drop_null_keys=True)
        return fin.refreshed_stats(stored, df, key)


_FLAG = "coalesce(monthly_payment > 0 AND monthly_payment < price, false)"
_TERM = "least(greatest(coalesce(term, 48), 12), 60)"


@query("repaired_installments", "PF26", f"""WITH raw AS (SELECT listing_id, price, monthly_payment * 3 AS monthly_payment,
nullif(down_payment, 0) AS down_payment, cast(CASE WHEN installments = 24 THEN NULL WHEN installments = 12 THEN 6 ELSE installments * 1.5 END as double) AS term FROM listings),
f AS (SELECT *, {_FLAG} AS flag, coalesce(down_payment, price * 0.2) AS down, price - coalesce(down_payment, price * 0.2) AS owed FROM raw)
SELECT listing_id, price, flag AS has_installments, CASE WHEN flag THEN {r(f'CASE WHEN monthly_payment > owed / 12 THEN owed / {_TERM} ELSE monthly_payment END', 4)} END AS monthly_payment,
CASE WHEN flag THEN {r('down', 4)} END AS down_payment, CASE WHEN flag THEN cast({_TERM} as int) END AS installments FROM f""")
def _(k):
    df = k.listings("listing_id", "price", "monthly_payment", "down_payment", "installments")
    rough = df.withColumns({
        "monthly_payment": F.col("monthly_payment") * 3,
        "down_payment": F.nullif("down_payment", F.lit(0.0)),
        "installments": F.when(F.col("installments") == 12, 6.0).when(
            F.col("installments") != 24, F.col("installments") * 1.5)})
    fixed = fin.repair_installments(rough)
    return fixed.withColumns({c: half_up(c, 4) for c in ("monthly_payment", "down_payment")})


@query("stored_terms", "PF27", """SELECT listing_id, CASE WHEN has_installments THEN coalesce(monthly_payment, 0) ELSE 0 END AS monthly_payment,
CASE WHEN has_installments THEN coalesce(nullif(down_payment, 0), 0) ELSE 0 END AS down_payment,
cast(CASE WHEN has_installments THEN coalesce(nullif(installments, 24), 48) ELSE 0 END as int) AS installments FROM listings""")
def _(k):
    df = k.listings("listing_id", *TERMS).withColumns({
        "down_payment": F.nullif("down_payment", F.lit(0.0)), "installments": F.nullif("installments", F.lit(24))})
    return fin.zero_unfinanced(df).drop("has_installments")


@query("financing_consistency", "DQ9", f"""SELECT problem AS financing_problem, {n()} AS listings, min(listing_id) AS example FROM (
SELECT listing_id, CASE WHEN has_installments AND (coalesce(monthly_payment, 0) = 0 OR coalesce(installments, 0) = 0) THEN 'missing_terms'
WHEN has_installments AND abs(price - (monthly_payment * installments + down_payment)) > 0.01 THEN 'price_mismatch' END AS problem FROM listings)
WHERE problem IS NOT NULL GROUP BY 1""")
def _(k):
    marked = fin.consistency(k.listings("listing_id", "price", *TERMS)).where("financing_problem is not null")
    return marked.groupBy("financing_problem").agg(F.count("*").alias("listings"), F.min("listing_id").alias("example"))
