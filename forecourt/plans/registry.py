"""Register of named queries and the SQL each is checked against."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from forecourt.sources import Market

# The star-schema tables seen as listings; runs unchanged on Spark SQL and DuckDB.
LISTINGS_SQL = """
SELECT concat_ws('-', cast(l_orderkey as string), cast(l_partkey as string), cast(l_suppkey as string), cast(l_linenumber as string)) AS listing_id,
  nullif(l_extendedprice, CASE WHEN l_partkey % 41 = 0 THEN l_extendedprice ELSE -1.0 END) AS price,
  CASE WHEN l_partkey % 37 = 0 THEN NULL ELSE lower(p_brand) END AS manufacturer,
  lower(p_name) AS model, lower(p_type) AS type,
  CASE l_returnflag WHEN 'A' THEN 'gas' WHEN 'N' THEN 'diesel' ELSE 'electric' END AS fuel,
  CASE l_linestatus WHEN 'F' THEN 'manual' ELSE 'automatic' END AS transmission,
  CASE substr(o_orderpriority,1,1) WHEN '1' THEN 'new' WHEN '2' THEN 'like new' WHEN '3' THEN 'good' WHEN '4' THEN 'fair' ELSE 'salvage' END AS condition,
  n_name AS state, r_name AS region,
  cast(year(o_orderdate) as int) AS year,
  CASE WHEN l_suppkey % 29 = 0 THEN NULL ELSE l_quantity * 1000.0 END AS odometer,
  cast(l_shipdate as date) AS posting_date,
  (l_discount > 0.05) AS has_installments,
  12 * (1 + l_linenumber % 5) AS installments,
  floor(l_extendedprice * l_tax * 100) / cast(100 as double) AS down_payment,
  floor(l_extendedprice * (1 - l_tax) / (12 * (1 + l_linenumber % 5)) * 100) / cast(100 as double) AS monthly_payment,
  cast(30 + n_nationkey % 15 + (l_partkey % 100) / 100.0 as double) AS latitude,
  cast(-120 + n_nationkey * 2 + (l_suppkey % 100) / 100.0 as double) AS longitude,
  CASE l_linenumber % 5
    WHEN 0 THEN NULL
    WHEN 1 THEN concat('entrada de ', cast(cast(floor(l_extendedprice * l_tax) as bigint) as string), ' e ', cast(12 * (1 + l_linenumber % 5) as string), 'x ', cast(cast(floor(l_extendedprice / 48) as bigint) as string), ',50')
    WHEN 2 THEN concat('clean title, $', cast(cast(floor(l_extendedprice / 60) as bigint) as string), ' per month, down payment $', cast(cast(floor(l_extendedprice * 0.1) as bigint) as string))
    WHEN 3 THEN 'like NEW, warranty included'
    ELSE concat('asking price $', cast(cast(floor(l_extendedprice) as bigint) as string), ' obo') END AS description
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
"""


@dataclass(frozen=True)
class Entry:
    name: str
    covers: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


ENTRIES: dict[str, Entry] = {}


def query(name: str, covers: str, sql: str | None = None):
    """Register ``fn(market) -> DataFrame``; ``covers`` lists SURVEY ids."""

    def keep(fn: Callable[[Market], DataFrame]):
        if name in ENTRIES:
            raise ValueError(f"query {name} is registered twice")
        ENTRIES[name] = Entry(name, covers, lambda spark, sf_dir: fn(Market(spark, sf_dir)),
                              with_listings(sql) if sql else None)
        return fn

    return keep


def with_listings(sql: str) -> str:
    body = sql.strip()
    head = f"WITH listings AS ({LISTINGS_SQL})"
    if body[:5].upper() == "WITH ":
        return f"{head}, {body[5:]}"
    return f"{head} {body}"


def r(expr: str, places: int = 2) -> str:
    """SQL text of the guarded half-up rounding used on both sides."""
    return f"round(({expr}) + 1e-8, {places})"


def n(expr: str = "*") -> str:
    return f"cast(count({expr}) as bigint)"


# Oracle text of the shared metrics, by the same names the operators use.
SQL_METRICS = {
    "total_listings": n(),
    "priced": n("price"),
    "avg_price": r("avg(price)"),
    "min_price": "min(price)",
    "max_price": "max(price)",
    "std_price": r("stddev_samp(price)"),
    "total_value": r("sum(price)"),
    "avg_mileage": r("avg(odometer)"),
    "min_mileage": "min(odometer)",
    "max_mileage": "max(odometer)",
    "std_mileage": r("stddev_samp(odometer)"),
    "avg_year": r("avg(year)"),
    "median_price": r("median(price)"),
    "median_mileage": r("median(odometer)"),
    "total_financed": "cast(count(*) FILTER (WHERE has_installments) as bigint)",
    "financing_percentage": r("100.0 * count(*) FILTER (WHERE has_installments) / count(*)"),
    "avg_monthly_payment": r("avg(monthly_payment) FILTER (WHERE has_installments)"),
    "avg_down_payment": r("avg(down_payment) FILTER (WHERE has_installments)"),
    "avg_installments": r("avg(installments) FILTER (WHERE has_installments)"),
    "mean_monthly_payment": r("avg(monthly_payment)"),
    "mean_down_payment": r("avg(down_payment)"),
    "mean_installments": r("avg(installments)"),
}


def m(names: str) -> str:
    """Select-list text of the named metrics."""
    return ", ".join(f"{SQL_METRICS[x]} AS {x}" for x in names.split())
