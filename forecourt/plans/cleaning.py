"""Filters, cleaning, rejection and text questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from forecourt.functions import text as tx
from forecourt.functions.numbers import half_up
from forecourt.operators import cleaning as cl
from forecourt.operators import words as wd
from forecourt.operators.aggregates import share_of_total, summarise, top_counts, top_per_group, with_medians
from forecourt.operators.joins import attach_group_stats, first_price_by_key
from forecourt.operators.quantiles import quantiles
from forecourt.plans.registry import m, n, query, r
from forecourt.sources import canonical

AS_OF_YEAR = 2002


@query("canonical_names", "PF1", "SELECT listing_id AS original_id, latitude, longitude FROM listings")
def _(k):
    raw = k.listings("listing_id", "latitude", "longitude").toDF("id", "lat", "long")
    return canonical(raw)


@query("base_view_by_age", "PF2 SF3", f"""SELECT {AS_OF_YEAR} - year AS vehicle_age, {m('total_listings avg_price')} FROM listings
WHERE price > 0 AND year >= 1990 AND posting_date IS NOT NULL GROUP BY 1""")
def _(k):
    return summarise(cl.base_view(k.listings("price", "year", "posting_date"), AS_OF_YEAR), ["vehicle_age"],
                     ["total_listings", "avg_price"])


@query("listing_search_page", "PF3 SL3", """SELECT listing_id, manufacturer, state, price, year FROM listings
WHERE manufacturer ILIKE '%brand#1%' AND state ILIKE '%Nation_1%' AND price BETWEEN 20000 AND 80000 AND year >= 1997
AND has_installments ORDER BY listing_id LIMIT 100 OFFSET 20""")
def _(k):
    found = cl.search(k.listings("listing_id", "manufacturer", "state", "price", "year", "has_installments"),
                      manufacturer="brand#1", state="Nation_1", min_price=20000, max_price=80000, min_year=1997,
                      has_installments=True)
    return cl.page(found, "listing_id", skip=20).drop("has_installments")


@query("listing_by_id", "PF4", """SELECT listing_id, manufacturer, model, price FROM listings
WHERE listing_id = (SELECT min(listing_id) FROM listings)""")
def _(k):
    df = k.listings("listing_id", "manufacturer", "model", "price")
    return df.where(F.col("listing_id") == df.agg(F.min("listing_id")).scalar())


_BUYER = """manufacturer = 'brand#1' AND fuel = 'gas' AND transmission = 'manual' AND condition = 'good'
AND price BETWEEN 5000 AND 90000 AND year BETWEEN 1996 AND 2000 AND odometer BETWEEN 1000 AND 45000"""


@query("buyer_filter", "PF5", f"SELECT listing_id, price, year, odometer FROM listings WHERE {_BUYER} ORDER BY price, listing_id")
def _(k):
    df = k.listings("listing_id", "price", "year", "odometer", "manufacturer", "fuel", "transmission", "condition")
    return df.where(_BUYER).select("listing_id", "price", "year", "odometer").orderBy("price", "listing_id")


@query("buyer_summary", "PF5", f"SELECT {m('total_listings avg_price avg_year avg_mileage')} FROM listings WHERE {_BUYER}")
def _(k):
    df = k.listings("price", "year", "odometer", "manufacturer", "fuel", "transmission", "condition")
    return summarise(df.where(_BUYER), [], ["total_listings", "avg_price", "avg_year", "avg_mileage"])


@query("sidebar_filter", "PF6", f"""SELECT region, {m('total_listings avg_price max_price')} FROM listings
WHERE year BETWEEN 1996 AND 2000 AND manufacturer IN ('brand#1', 'brand#2') AND region IN ('ASIA', 'EUROPE')
AND price <= (SELECT quantile_cont(price, 0.99) FROM listings WHERE year BETWEEN 1996 AND 2000) GROUP BY 1""")
def _(k):
    rows = cl.sidebar_filter(k.listings("region", "year", "manufacturer", "price"), (1996, 2000),
                             ["brand#1", "brand#2"], ["ASIA", "EUROPE"])
    return summarise(rows, ["region"], ["total_listings", "avg_price", "max_price"])


_FIG = "total_listings priced avg_price min_price max_price std_price median_price"


@query("comparable_listings", "PF7", f"""WITH asked AS (SELECT DISTINCT manufacturer, model, year + 4 AS year FROM listings
WHERE manufacturer IS NOT NULL), near AS (SELECT a.manufacturer, a.model, a.year, {m(_FIG)} FROM asked a JOIN listings l
ON l.manufacturer = a.manufacturer AND l.model = a.model AND l.year BETWEEN a.year - 2 AND a.year + 2 GROUP BY 1, 2, 3),
make AS (SELECT manufacturer, {m(_FIG)} FROM listings GROUP BY 1)
SELECT a.manufacturer, a.model, a.year, CASE WHEN n.total_listings IS NULL THEN 'make' ELSE 'model' END AS basis,
{', '.join(f'CASE WHEN n.total_listings IS NULL THEN k.{c} ELSE n.{c} END AS {c}' for c in _FIG.split())}
FROM asked a LEFT JOIN near n USING (manufacturer, model, year) LEFT JOIN make k ON k.manufacturer = a.manufacturer""")
def _(k):
    df = k.listings("manufacturer", "model", "year", "price")
    asked = df.where("manufacturer is not null").select("manufacturer", "model", (F.col("year") + 4).alias("year")).distinct()
    return cl.comparables(df, asked)


_TEXT_QTY = "CASE WHEN l_linenumber % 3 = 0 THEN concat('$', cast(l_quantity as varchar)) ELSE cast(l_quantity as varchar) END"


@query("coerced_numbers", "PF8", f"""SELECT l_linenumber, {n()} AS total, {n(f'try_cast({_TEXT_QTY} as double)')} AS readable,
{r(f'sum(try_cast({_TEXT_QTY} as double))')} AS total_quantity FROM lineitem GROUP BY 1""")
def _(k):
    line = k.table("lineitem").select("l_linenumber", F.when(
        F.col("l_linenumber") % 3 == 0, F.concat(F.lit("$"), F.col("l_quantity").cast("string"))).otherwise(
        F.col("l_quantity").cast("string")).alias("quantity"))
    return cl.coerce_numbers(line, ["quantity"]).groupBy("l_linenumber").agg(
        F.count("*").alias("total"), F.count("quantity").alias("readable"), half_up(F.sum("quantity")).alias("total_quantity"))


@query("nulled_out_of_range", "PF9", f"""SELECT manufacturer, {n()} AS total, {n('CASE WHEN price BETWEEN 5000 AND 90000 THEN 1 END')} AS prices,
{n('CASE WHEN year BETWEEN 1996 AND 2000 THEN 1 END')} AS years, {n('CASE WHEN odometer BETWEEN 5000 AND 45000 THEN 1 END')} AS odometers
FROM listings GROUP BY 1""")
def _(k):
    df = cl.null_outside(k.listings("manufacturer", "price", "year", "odometer"),
                         {"price": (5000, 90000), "year": (1996, 2000), "odometer": (5000, 45000)})
    return df.groupBy("manufacturer").agg(F.count("*").alias("total"), F.count("price").alias("prices"),
                                          F.count("year").alias("years"), F.count("odometer").alias("odometers"))


_RAGGED = "CASE l_linenumber % 7 WHEN 0 THEN ' None ' WHEN 1 THEN '' WHEN 2 THEN ' NaN' ELSE concat('  ', l_returnflag, 'X ') END"


@query("normalised_text", "PF10", f"""SELECT CASE WHEN lower(trim({_RAGGED})) IN ('nan', 'none', '') THEN NULL ELSE lower(trim({_RAGGED})) END AS flag,
{n()} AS total FROM lineitem GROUP BY 1""")
def _(k):
    rest = F.col("l_linenumber") % 7
    ragged = F.when(rest == 0, " None ").when(rest == 1, "").when(rest == 2, " NaN").otherwise(
        F.concat(F.lit("  "), "l_returnflag", F.lit("X ")))
    rows = cl.normalise_text(k.table("lineitem").select(ragged.alias("flag")), ["flag"])
    return rows.groupBy("flag").agg(F.count("*").alias("total"))


@query("filled_unknown", "PF11", f"""SELECT coalesce(lower(trim(manufacturer)), 'unknown') AS manufacturer, lower(trim(fuel)) AS fuel, {n()} AS total
FROM listings GROUP BY 1, 2""")
def _(k):
    return cl.fill_unknown(k.listings("manufacturer", "fuel")).groupBy("manufacturer", "fuel").agg(F.count("*").alias("total"))


@query("standard_values", "PF12", f"""SELECT coalesce(manufacturer, 'unknown') AS manufacturer, CASE fuel WHEN 'gas' THEN 'gasoline' ELSE fuel END AS fuel, transmission,
upper(trim(state)) AS state, {n()} AS total FROM listings GROUP BY 1, 2, 3, 4""")
def _(k):
    rows = cl.standard_values(k.listings("manufacturer", "model", "fuel", "transmission", "state"))
    return rows.groupBy("manufacturer", "fuel", "transmission", "state").agg(F.count("*").alias("total"))


@query("aliased_makes", "PF13", f"""SELECT CASE manufacturer WHEN 'brand#2' THEN 'brand#20' WHEN 'brand#3' THEN 'brand#13' ELSE manufacturer END AS manufacturer,
CASE WHEN fuel IN ('gas', 'diesel') THEN fuel END AS fuel, {n()} AS total FROM listings GROUP BY 1, 2""")
def _(k):
    rows = cl.apply_aliases(k.listings("manufacturer", "fuel"), {"brand#2": "brand#20", "brand#3": "brand#13"},
                            {"fuel": ["gas", "diesel"]})
    return rows.groupBy("manufacturer", "fuel").agg(F.count("*").alias("total"))


@query("median_filled", "PF14", f"""WITH md AS (SELECT median(odometer) AS km, median(latitude) AS lat FROM listings)
SELECT state, {r('avg(coalesce(odometer, km))')} AS avg_mileage, {r('avg(coalesce(latitude, lat))')} AS avg_latitude,
{n('coalesce(odometer, km)')} AS filled FROM listings, md GROUP BY 1""")
def _(k):
    rows = cl.fill_medians(k.listings("state", "odometer", "latitude"), ["odometer", "latitude"])
    return rows.groupBy("state").agg(half_up(F.avg("odometer")).alias("avg_mileage"),
                                     half_up(F.avg("latitude")).alias("avg_latitude"), F.count("odometer").alias("filled"))


@query("ascii_text", "PF15", r"""SELECT doc_id, md5(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) AS digest,
cast(length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) as bigint) AS characters FROM documents""")
def _(k):
    clean = tx.ascii_only(F.col("text"))
    return k.table("documents").select("doc_id", F.md5(clean).alias("digest"), F.length(clean).cast("bigint").alias("characters"))


@query("plausible_years", "PF16", f"""SELECT year, {n()} AS total FROM listings WHERE year BETWEEN 1996 AND 1999 + 1 GROUP BY 1""")
def _(k):
    return plausible_years(k.listings("year"), 1996, 1999).groupBy("year").agg(F.count("*").alias("total"))


def plausible_years(df, first: int = 1950, as_of_year: int = AS_OF_YEAR):
    return df.where(F.col("year").between(first, as_of_year + 1))


@query("exact_dedup", "PF17", f"""SELECT manufacturer, {n()} AS distinct_rows FROM (SELECT DISTINCT manufacturer, model, type, fuel, year, condition FROM listings) GROUP BY 1""")
def _(k):
    rows = k.listings("manufacturer", "model", "type", "fuel", "year", "condition").dropDuplicates()
    return rows.groupBy("manufacturer").agg(F.count("*").alias("distinct_rows"))


@query("suspicious_repeats", "PF18", """SELECT listing_id FROM (SELECT listing_id, row_number() OVER (PARTITION BY manufacturer, model, year
ORDER BY listing_id) AS rn FROM listings WHERE price < 5000 AND manufacturer IS NOT NULL) WHERE rn > 1""")
def _(k):
    df = k.listings("listing_id", "manufacturer", "model", "year", "price")
    return cl.mark_repeats(df, F.col("price") < 5000, ["manufacturer", "model", "year"], "listing_id").where(
        "is_repeat").select("listing_id")


_LEDGER = """WITH f AS (SELECT listing_id, manufacturer, model, year, state, description, price, row_number() OVER (PARTITION BY manufacturer, model, year, price < 8000
ORDER BY listing_id) AS rn FROM listings),
ledger AS (SELECT *, CASE WHEN price = 987654321 THEN 'sentinel_price' WHEN price < 8000 AND rn > 1 AND manufacturer IS NOT NULL THEN 'duplicate_listing'
WHEN lower(description) LIKE '%month%' OR lower(description) LIKE '%payment%' THEN 'monthly_payment'
WHEN price < 5000 THEN 'low_price' WHEN price > 90000 THEN 'high_price' END AS reject_reason FROM f)"""


def _ledger(k, *more):
    df = k.listings("listing_id", "manufacturer", "model", "year", "price", "description", *more)
    return cl.price_ledger(df, "listing_id", suspicious=F.col("price") < 8000,
                           repeat_keys=["manufacturer", "model", "year"], low=5000, high=90000)


@query("price_ledger", "PF19 PF20 PF21 SO1 SO2", f"""{_LEDGER} SELECT coalesce(reject_reason, 'kept') AS outcome, {n()} AS listings,
{r('sum(price)')} AS total_price FROM ledger GROUP BY 1""")
def _(k):
    return _ledger(k).groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("outcome")).agg(
        F.count("*").alias("listings"), half_up(F.sum("price")).alias("total_price"))


@query("rejected_listings", "SO1 PF21", f"{_LEDGER} SELECT listing_id, price, reject_reason FROM ledger WHERE reject_reason IS NOT NULL")
def _(k):
    return cl.rejected(_ledger(k)).select("listing_id", "price", "reject_reason")


@query("kept_listings", "SO2", f"{_LEDGER} SELECT listing_id, price FROM ledger WHERE reject_reason IS NULL")
def _(k):
    return cl.kept(_ledger(k)).select("listing_id", "price")


@query("removed_audit", "AG49", f"""{_LEDGER} SELECT reject_reason, {n()} AS listings, {r('avg(price)')} AS avg_price, {r('median(price)')} AS median_price,
{n('DISTINCT state')} AS states, array_to_string(list_sort(list(DISTINCT year)), ',') AS years FROM ledger WHERE reject_reason IS NOT NULL GROUP BY 1""")
def _(k):
    gone = cl.rejected(_ledger(k, "state"))
    stats = gone.groupBy("reject_reason").agg(
        F.count("*").alias("listings"), half_up(F.avg("price")).alias("avg_price"),
        F.count_distinct("state").alias("states"), F.array_join(F.array_sort(F.collect_set("year")), ",").alias("years"))
    return with_medians(stats, gone, ["reject_reason"], median_price="price")


@query("removed_by_make", "AG49", f"""{_LEDGER} SELECT manufacturer, {n()} AS listings, {r('avg(price)')} AS avg_price,
{r('median(price)')} AS median_price FROM ledger WHERE reject_reason IS NOT NULL AND manufacturer IS NOT NULL GROUP BY 1""")
def _(k):
    gone = cl.rejected(_ledger(k)).where("manufacturer is not null")
    stats = gone.groupBy("manufacturer").agg(F.count("*").alias("listings"), half_up(F.avg("price")).alias("avg_price"))
    return with_medians(stats, gone, ["manufacturer"], median_price="price")


_INFO = r"""WITH t AS (SELECT listing_id, manufacturer, price, lower(description) AS d FROM listings),
p AS (SELECT *, try_cast(replace(nullif(regexp_extract(d, '\$?\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\s*(?:\/|\s+per\s+)?\s*(?:month|mo|mensal)', 1), ''), ',', '') as double) AS monthly_payment,
try_cast(replace(nullif(regexp_extract(d, '(?:down\s+payment|entrada)\s*\$?\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)', 1), ''), ',', '') as double) AS down_payment,
try_cast(replace(nullif(regexp_extract(d, '(?:total\s+price|price|valor\s+total)\s*\$?\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)', 1), ''), ',', '') as double) AS total_price FROM t),
e AS (SELECT *, coalesce(nullif(total_price, 0), nullif(monthly_payment, 0) * 48 + coalesce(down_payment, 0)) AS estimate FROM p)"""


@query("payment_info", "TX3 TX4", f"""{_INFO} SELECT listing_id, coalesce(monthly_payment, down_payment, total_price) IS NOT NULL AS has_payment_info,
monthly_payment, down_payment, total_price, estimate FROM e""")
def _(k):
    df = wd.with_payment_info(k.listings("listing_id", "description"))
    return df.select("listing_id", "payment_info.*", "estimate")


@query("raised_prices", "TX5", f"""{_INFO} SELECT manufacturer, {n('CASE WHEN estimate > price THEN 1 END')} AS raised,
{r('avg(CASE WHEN estimate > price THEN estimate ELSE price END)')} AS avg_price FROM e GROUP BY 1""")
def _(k):
    df = wd.with_raised_price(k.listings("manufacturer", "price", "description"), name="better")
    return df.groupBy("manufacturer").agg(F.count_if(F.col("better") > F.col("price")).alias("raised"),
                                          half_up(F.avg("better")).alias("avg_price"))


@query("audit_ledger", "PF22 PF24", f"""{_INFO}, z AS (SELECT *, CASE WHEN estimate > price THEN estimate ELSE price END AS better FROM e)
SELECT CASE WHEN price IS NULL OR price <= 0 THEN 'no_price' WHEN better < 5000 THEN 'below_make_limit' WHEN better > 200000 THEN 'above_make_limit' ELSE 'kept' END AS outcome,
{n()} AS listings, {r('avg(better)')} AS avg_price FROM z GROUP BY 1""")
def _(k):
    ledger = cl.audit_ledger(k.listings("manufacturer", "price", "description"))
    return ledger.groupBy(F.coalesce("reject_reason", F.lit("kept")).alias("outcome")).agg(
        F.count("*").alias("listings"), half_up(F.avg("price")).alias("avg_price"))


@query("load_limits", "PF23", f"""SELECT manufacturer, coalesce(price BETWEEN 2000 AND 300000, false) AS price_valid, {n()} AS listings
FROM listings GROUP BY 1, 2""")
def _(k):
    return cl.within_load_limits(k.listings("manufacturer", "price")).groupBy("manufacturer", "price_valid").agg(
        F.count("*").alias("listings"))


_CLEAN = """l.model IS NOT NULL AND year BETWEEN 1900 AND 2024 AND price > 0 AND price >= mean * 0.1 AND price <= mean + 3 * sd
AND ((has_installments AND monthly_payment > 0 AND installments > 0 AND installments <= 120
AND abs(price - (monthly_payment * installments + coalesce(down_payment, 0))) <= 0.01) OR NOT has_installments)
AND (odometer IS NULL OR (odometer > 0 AND odometer < 1000000))"""


@query("clean_view", "PF25 JN5", f"""WITH s AS (SELECT manufacturer, avg(price) AS mean, stddev_samp(price) AS sd FROM listings WHERE price > 0 GROUP BY 1)
SELECT l.manufacturer, {m('total_listings avg_price')} FROM listings l JOIN s ON l.manufacturer = s.manufacturer WHERE {_CLEAN} GROUP BY 1""")
def _(k):
    rows = cl.clean_view(k.listings("manufacturer", "model", "year", "price", "odometer", "has_installments",
                                    "monthly_payment", "installments", "down_payment"))
    return summarise(rows, ["manufacturer"], ["total_listings", "avg_price"])


@query("wide_outliers_dropped", "PF28 WN2", f"""WITH a AS (SELECT quantile_cont(price, 0.01) AS lo, quantile_cont(price, 0.99) AS hi FROM listings),
p AS (SELECT l.* FROM listings l, a WHERE price >= lo - 1.5 * (hi - lo) AND price <= hi + 1.5 * (hi - lo)),
b AS (SELECT quantile_cont(odometer, 0.01) AS lo, quantile_cont(odometer, 0.99) AS hi FROM p),
q AS (SELECT p.* FROM p, b WHERE odometer >= lo - 1.5 * (hi - lo) AND odometer <= hi + 1.5 * (hi - lo) AND year >= 2000)
SELECT state, {m('total_listings avg_price avg_mileage')} FROM q GROUP BY 1""")
def _(k):
    rows = cl.drop_wide_outliers(k.listings("state", "year", "price", "odometer"))
    return summarise(rows, ["state"], ["total_listings", "avg_price", "avg_mileage"])


@query("low_price_audit", "PF29 AG50", f"""SELECT manufacturer, model, year, state, price, description, {n()} AS count FROM listings WHERE price < 10000 GROUP BY 1, 2, 3, 4, 5, 6""")
def _(k):
    return cl.low_price_audit(k.listings("manufacturer", "model", "year", "state", "price", "description"), 10000)


_TOTAL = r"""WITH t AS (SELECT listing_id, price, description, lower(description) AS d FROM listings),
x AS (SELECT *, try_cast(replace(replace(nullif(regexp_extract(d, '(\$?\d+[.,]\d+|\d+)(?:\s*(?:x|×)\s*|\s+parcelas?\s+de\s+)(\d+[.,]\d+|\d+)', 2), ''), '$', ''), ',', '.') as double) AS mp,
try_cast(replace(replace(nullif(regexp_extract(d, '(\$?\d+[.,]\d+|\d+)(?:\s*(?:x|×)\s*|\s+parcelas?\s+de\s+)(\d+[.,]\d+|\d+)', 1), ''), '$', ''), ',', '.') as double) AS times,
try_cast(replace(replace(nullif(regexp_extract(d, 'entrada\s+(?:de\s+)?(\$?\d+[.,]\d+|\d+)', 1), ''), '$', ''), ',', '.') as double) AS dp,
try_cast(nullif(regexp_extract(d, '(\d+)\s*(?:x|parcelas|vezes)', 1), '') as int) AS term FROM t)"""


@query("total_price_from_text", "TX1", f"""{_TOTAL} SELECT listing_id, mp IS NOT NULL AS has_installments, mp AS monthly_payment, dp AS down_payment,
{r('CASE WHEN mp IS NOT NULL THEN mp * coalesce(term, 48) + coalesce(dp, 0) WHEN description IS NOT NULL THEN price END')} AS total_price,
CASE WHEN mp IS NOT NULL THEN coalesce(term, 48) END AS installments, price AS original_price FROM x""")
def _(k):
    out = wd.with_total_price(k.listings("listing_id", "price", "description")).select("listing_id", "terms.*")
    return out.withColumn("total_price", half_up("total_price"))


@query("price_from_text", "TX2", f"""{_TOTAL} SELECT listing_id, {r('''CASE WHEN coalesce(times * mp, 0) + coalesce(dp, 0) != 0 THEN coalesce(times * mp, 0) + coalesce(dp, 0)
ELSE cast(floor(price) as double) END''')} AS price FROM x""")
def _(k):
    df = k.listings("listing_id", "price", "description").withColumn(
        "stated", F.concat(F.lit("$"), F.floor("price").cast("string")))
    return wd.with_text_price(df, "stated").select("listing_id", half_up("price").alias("price"))


_EN = {"down_payment": r"(?i)\$(\d+)\s*(?:down|entrada)", "monthly_payment": r"(?i)\$(\d+)\s*(?:monthly|mensal)",
       "term_months": r"(?i)(\d+)\s*(?:months|meses)", "apr": r"(?i)(\d+\.?\d*)%\s*APR", "real_price": r"(?i)price\s*of\s*\$(\d+,?\d*)"}
# The given texts hold no English financing phrase, so the phrase is written from each row's own figures.
_PHRASE_SQL = """concat('$', cast(cast(floor(l_quantity * 100) as bigint) as varchar), ' down, $', cast(cast(floor(l_extendedprice / 60) as bigint) as varchar),
' monthly for ', cast(12 * (1 + l_linenumber % 5) as varchar), ' months at ', cast(l_linenumber as varchar), '.5% APR, price of $', cast(cast(floor(l_extendedprice) as bigint) as varchar))"""


@query("financing_phrases_en", "TX6", "SELECT " + ", ".join(
    f"{n('v_' + c)} AS found_{c}, {r(f'sum(v_{c})')} AS sum_{c}" for c in _EN) + " FROM (SELECT " + ", ".join(
    f"try_cast(replace(nullif(regexp_extract(d, '{p}', 1), ''), ',', '') as double) AS v_{c}" for c, p in _EN.items())
    + f" FROM (SELECT {_PHRASE_SQL} AS d FROM lineitem))")
def _(k):
    big = lambda c: F.floor(c).cast("string")
    phrase = F.concat(
        F.lit("$"), big(F.col("l_quantity") * 100), F.lit(" down, $"), big(F.col("l_extendedprice") / 60),
        F.lit(" monthly for "), ((F.col("l_linenumber") % 5 + 1) * 12).cast("string"), F.lit(" months at "),
        F.col("l_linenumber").cast("string"), F.lit(".5% APR, price of $"), big(F.col("l_extendedprice")))
    found = k.table("lineitem").select(tx.financing_en(phrase).alias("f")).select("f.*")
    return found.agg(*[x for c in found.columns for x in (
        F.count(c).alias(f"found_{c}"), half_up(F.sum(c)).alias(f"sum_{c}"))])


_PT = r"""WITH x AS (SELECT listing_id, manufacturer, price,
try_cast(replace(replace(nullif(regexp_extract(description, '(?i)entrada\s*(?:de\s*)?R?\$?\s*(\d+(?:\.\d{3})*(?:,\d{2})?)', 1), ''), '.', ''), ',', '.') as double) AS down_payment,
try_cast(replace(replace(nullif(regexp_extract(description, '(?i)(?:parcela|parcelas)\s*(?:de\s*)?R?\$?\s*(\d+(?:\.\d{3})*(?:,\d{2})?)', 1), ''), '.', ''), ',', '.') as double) AS monthly_payment,
try_cast(nullif(regexp_extract(description, '(?i)(\d+)\s*(?:x|parcelas|vezes)', 1), '') as int) AS term_months FROM (
SELECT * REPLACE (replace(description, 'x ', ' parcelas de R$ ') AS description) FROM listings)),
y AS (SELECT *, CASE WHEN monthly_payment != 0 AND term_months != 0 AND down_payment != 0 THEN monthly_payment * term_months + down_payment END AS real_price FROM x)"""


def _pt(k):
    df = k.listings("listing_id", "manufacturer", "price", "description")
    said = F.replace("description", F.lit("x "), F.lit(" parcelas de R$ "))
    return wd.with_financing_pt(df.withColumn("description", said)).drop("description")


@query("financing_phrases_pt", "TX7", f"{_PT} SELECT listing_id, down_payment, monthly_payment, term_months, {r('real_price')} AS real_price FROM y WHERE term_months IS NOT NULL")
def _(k):
    return _pt(k).where("term_months is not null").select(
        "listing_id", "down_payment", "monthly_payment", "term_months", half_up("real_price").alias("real_price"))


@query("low_price_financing", "TX8", f"""{_PT} SELECT {n()} AS total_low_price, {n('nullif(down_payment, 0)')} AS with_down_payment,
{n('nullif(monthly_payment, 0)')} AS with_monthly_payment, {n('nullif(term_months, 0)')} AS with_term, {n('real_price')} AS with_real_price,
{n('CASE WHEN real_price > 10000 THEN 1 END')} AS suspicious_prices FROM y WHERE price < 30000""")
def _(k):
    return wd.low_price_financing(_pt(k).where("price < 30000"))


@query("low_price_financing_by_make", "TX8", f"""{_PT} SELECT manufacturer, {n()} AS listings, {r('avg(price)')} AS avg_price, min(price) AS min_price,
max(price) AS max_price, {n('CASE WHEN real_price > 10000 THEN 1 END')} AS suspicious_prices FROM y WHERE price < 30000 AND manufacturer IS NOT NULL GROUP BY 1""")
def _(k):
    rows = _pt(k).where("price < 30000 and manufacturer is not null")
    return rows.groupBy("manufacturer").agg(
        F.count("*").alias("listings"), half_up(F.avg("price")).alias("avg_price"), F.min("price").alias("min_price"),
        F.max("price").alias("max_price"), F.count_if(F.col("real_price") > 10000).alias("suspicious_prices"))


@query("description_features", "TX9", f"""SELECT listing_id, cast(length(description) as int) AS description_length,
cast(description IS NOT NULL as int) AS has_description, cast(coalesce(contains(lower(description), 'new'), false) as int) AS description_mentions_new,
cast(coalesce(contains(lower(description), 'warranty'), false) as int) AS description_mentions_warranty,
cast(coalesce(contains(lower(description), 'clean'), false) as int) AS description_mentions_clean FROM listings""")
def _(k):
    feats = tx.description_features(F.col("description"))
    return k.listings("listing_id", "description").select("listing_id", *[c.alias(a) for a, c in feats.items()])


@query("transmission_buckets", "TX10", f"""SELECT CASE WHEN lower(transmission) LIKE '%manual%' THEN 'Manual' WHEN lower(transmission) LIKE '%auto%' THEN 'Automatic' ELSE 'Other' END AS transmission_type,
{n()} AS total, {r('count(*) * 100.0 / sum(count(*)) OVER ()')} AS percentage FROM listings WHERE transmission IS NOT NULL GROUP BY 1""")
def _(k):
    rows = k.listings("transmission").where("transmission is not null")
    counts = rows.groupBy(tx.transmission_bucket(F.col("transmission")).alias("transmission_type")).agg(F.count("*").alias("total"))
    return share_of_total(counts, "total")


_WORDS = r"""regexp_split_to_array(lower({}), '[^\pL\pN]+')"""


@query("top_words_by_price_tercile", "TX11 SF11", f"""WITH q AS (SELECT quantile_cont(price, 1/3::double) AS a, quantile_cont(price, 2/3::double) AS b FROM listings),
w AS (SELECT CASE WHEN price <= a THEN 'low' WHEN price <= b THEN 'mid' ELSE 'high' END AS band, unnest({_WORDS.format('description')}) AS word FROM listings, q WHERE price IS NOT NULL),
c AS (SELECT band, word, {n()} AS total, row_number() OVER (PARTITION BY band ORDER BY count(*) DESC, word) AS place FROM w
WHERE word != '' AND word NOT IN ({', '.join(repr(x) for x in wd.STOP_WORDS if "'" not in x)}) GROUP BY 1, 2)
SELECT band, word, total, cast(place as int) AS place FROM c WHERE place <= 10""")
def _(k):
    return wd.top_words_by_price(k.listings("price", "description"), 10)


@query("description_sentiment", "TX12", f"""WITH lex(word, polarity) AS (VALUES {', '.join(f"('{w}', {p})" for w, p in wd.POLARITY.items())}),
t AS (SELECT doc_id, unnest({_WORDS.format('text')}) AS word FROM documents),
s AS (SELECT doc_id, avg(polarity) AS p FROM t JOIN lex USING (word) GROUP BY 1)
SELECT {n()} AS texts, {n('p')} AS scored, {r('avg(coalesce(p, 0))', 6)} AS mean, {r('stddev_samp(coalesce(p, 0))', 6)} AS std, min(coalesce(p, 0)) AS minimum, max(coalesce(p, 0)) AS maximum FROM documents LEFT JOIN s USING (doc_id)""")
def _(k):
    return wd.sentiment_summary(wd.sentiment(k.table("documents"), "doc_id", "text"))


@query("listing_sentiment", "TX12", f"""WITH lex(word, polarity) AS (VALUES {', '.join(f"('{w}', {p})" for w, p in wd.POLARITY.items())}),
t AS (SELECT listing_id, unnest({_WORDS.format('description')}) AS word FROM listings),
s AS (SELECT listing_id, avg(polarity) AS p FROM t JOIN lex USING (word) GROUP BY 1)
SELECT {r('coalesce(p, 0)', 6)} AS sentiment, {m('total_listings avg_price')} FROM listings LEFT JOIN s USING (listing_id) GROUP BY 1""")
def _(k):
    scored = wd.sentiment(k.listings("listing_id", "price", "description"), "listing_id", "description")
    return summarise(scored.withColumn("sentiment", half_up("sentiment", 6)), ["sentiment"], ["total_listings", "avg_price"])


_LEXICON = wd.POLARITY | wd.PHRASES
_PHRASE = wd.lexicon_pattern(_LEXICON).replace("'", "''")
_SPACED = _WORDS.replace("regexp_split_to_array", "' ' || array_to_string(list_filter(regexp_split_to_array") + ", lambda x: x <> ''), '  ') || ' '"


@query("phrase_sentiment", "TX12", f"""WITH lex(phrase, polarity) AS (VALUES {', '.join(f"('{'  '.join(p.split())}', {v})" for p, v in _LEXICON.items())}),
t AS (SELECT row_number() OVER () AS k, price, coalesce({_SPACED.format('description')}, '') AS said FROM listings),
h AS (SELECT k, coalesce(unnest(regexp_extract_all(said, '{_PHRASE}', 1)), '') AS turn, unnest(regexp_extract_all(said, '{_PHRASE}', 2)) AS phrase FROM t),
s AS (SELECT k, count(*) AS hits, count(*) FILTER (turn <> '') AS negated, avg(polarity * CASE WHEN turn = '' THEN 1 ELSE {wd.NEGATED} END) AS p FROM h JOIN lex USING (phrase) GROUP BY 1)
SELECT {r('coalesce(p, 0)', 6)} AS sentiment, cast(coalesce(hits, 0) AS int) AS hits, cast(coalesce(negated, 0) AS int) AS negated, {m('total_listings avg_price')}
FROM t LEFT JOIN s USING (k) GROUP BY 1, 2, 3""")
def _(k):
    scored = wd.phrase_sentiment(k.listings("listing_id", "price", "description"), "description")
    return summarise(scored.withColumn("sentiment", half_up("sentiment", 6)), ["sentiment", "hits", "negated"], ["total_listings", "avg_price"])


@query("price_history", "JN11", """WITH f AS (SELECT manufacturer, model, year, arg_min(price, listing_id) AS first_price FROM listings
WHERE manufacturer IS NOT NULL AND posting_date < DATE '1999-01-01' AND price IS NOT NULL GROUP BY 1, 2, 3)
SELECT listing_id, first_price FROM listings JOIN f USING (manufacturer, model, year)""")
def _(k):
    df = k.listings("listing_id", "manufacturer", "model", "year", "price", "posting_date")
    past = df.where((F.col("posting_date") < F.lit("1999-01-01").cast("date")) & F.col("price").isNotNull())
    return first_price_by_key(df.select("listing_id", "manufacturer", "model", "year"), past,
                              ["manufacturer", "model", "year"], "listing_id").select("listing_id", "first_price")


@query("load_check", "IO9", " UNION ALL ".join(f"SELECT {n()} AS total_rows, '{c}' AS column_name, {n(f'CASE WHEN {c} IS NULL THEN 1 END')} AS nulls FROM listings"
    for c in ("price", "manufacturer", "odometer", "description", "state")))
def _(k):
    return cl.load_check(k.listings("price", "manufacturer", "odometer", "description", "state"))


@query("projection_export", "IO12", """SELECT manufacturer, model, year, price, odometer, fuel, condition, region, posting_date, state, latitude, longitude
FROM listings WHERE price > 0 AND year >= 1990 AND posting_date IS NOT NULL""")
def _(k):
    from forecourt.sources.files import export_columns
    return export_columns(k.listings())


@query("typed_source", "IO4", f"""SELECT year, {AS_OF_YEAR} - year AS vehicle_age, {n('price')} AS prices, {n('odometer')} AS odometers, min(posting_date) AS first_posting FROM listings GROUP BY 1, 2""")
def _(k):
    from forecourt.sources.files import ensure_types
    text = k.listings("year", "price", "odometer", "posting_date")
    typed = ensure_types(text.select(*[F.col(c).cast("string") for c in text.columns]), AS_OF_YEAR)
    return typed.groupBy(F.col("year").cast("int").alias("year"), F.col("vehicle_age").cast("int").alias("vehicle_age")).agg(
        F.count("price").alias("prices"), F.count("odometer").alias("odometers"),
        F.min(F.col("posting_date").cast("date")).alias("first_posting"))


@query("fair_group_means", "JN8 WN2", f"""WITH a AS (SELECT manufacturer, avg(price) AS p FROM listings WHERE manufacturer IS NOT NULL GROUP BY 1)
SELECT listing_id, {r('a.p')} AS make_avg FROM listings LEFT JOIN a USING (manufacturer)""")
def _(k):
    df = attach_group_stats(k.listings("listing_id", "manufacturer", "price"), ["manufacturer"], make_avg=F.avg("price"))
    return df.select("listing_id", half_up("make_avg").alias("make_avg"))
