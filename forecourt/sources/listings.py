"""Listing readers: raw files, and the star-schema adapter the queries run on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forecourt.schema import CANONICAL_NAMES, RAW_LISTING


def read_listings(spark: SparkSession, path: str) -> DataFrame:
    """Raw listings by file extension; ``posting_date`` parsed as a UTC timestamp.

    Bad CSV cells become null and the bad line is kept in ``_corrupt_record``.
    """
    kind = path.rstrip("/").rsplit(".", 1)[-1].lower()
    if kind == "csv":
        schema = T.StructType([*RAW_LISTING.fields, T.StructField("_corrupt_record", T.StringType())])
        raw = (
            spark.read.schema(schema)
            .option("header", True)
            .option("multiLine", False)
            .option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", "_corrupt_record")
            .csv(path)
        )
    elif kind == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unsupported listing file type: .{kind}")
    if dict(raw.dtypes).get("posting_date") == "string":
        raw = raw.withColumn("posting_date", F.try_to_timestamp("posting_date"))
    return raw


def read_first_available(spark: SparkSession, candidates: list[str]) -> DataFrame:
    """First readable source of an ordered list; the last resort may be a table name."""
    for place in candidates:
        try:
            if place.endswith((".csv", ".parquet")):
                return read_listings(spark, place)
            return spark.read.table(place)
        except Exception as problem:  # an absent source is expected here
            if "PATH_NOT_FOUND" not in str(problem) and "TABLE_OR_VIEW_NOT_FOUND" not in str(problem):
                raise
    raise FileNotFoundError(f"none of {candidates} can be read")


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """Database table; Spark pushes column choice and filters into the query.

    For a parallel read give partitionColumn, lowerBound, upperBound, numPartitions.
    """
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def canonical(raw: DataFrame) -> DataFrame:
    return raw.withColumnsRenamed(CANONICAL_NAMES)


# Which star-schema tables a listing column needs besides lineitem.
_NEEDS = {
    "manufacturer": {"part"}, "model": {"part"}, "type": {"part"},
    "condition": {"orders"}, "year": {"orders"},
    "state": {"supplier", "nation"}, "region": {"supplier", "nation", "region"},
    "latitude": {"supplier"}, "longitude": {"supplier"},
}

ALL_COLUMNS = [
    "listing_id", "price", "manufacturer", "model", "type", "fuel", "transmission",
    "condition", "state", "region", "year", "odometer", "posting_date",
    "has_installments", "installments", "down_payment", "monthly_payment",
    "latitude", "longitude", "description",
]


def _cents(c: Column) -> Column:
    return F.floor(c * 100) / F.lit(100.0)


def _listing_columns() -> dict[str, Column]:
    asked = F.col("l_extendedprice")
    line, part, supp = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    rest = line % 5
    term = ((rest + 1) * 12).cast("int")
    priority = F.col("_priority")
    whole = lambda c: F.floor(c).cast("string")
    return {
        "listing_id": F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
        "price": F.when(part % 41 != 0, asked),
        "manufacturer": F.when(part % 37 != 0, F.lower("p_brand")),
        "model": F.lower("p_name"),
        "type": F.lower("p_type"),
        "fuel": F.when(F.col("l_returnflag") == "A", "gas")
        .when(F.col("l_returnflag") == "N", "diesel").otherwise("electric"),
        "transmission": F.when(F.col("l_linestatus") == "F", "manual").otherwise("automatic"),
        "condition": F.when(priority == "1", "new").when(priority == "2", "like new")
        .when(priority == "3", "good").when(priority == "4", "fair").otherwise("salvage"),
        "state": F.col("n_name"),
        "region": F.col("r_name"),
        "year": F.col("_year"),
        "odometer": F.when(supp % 29 != 0, F.col("l_quantity") * 1000.0),
        "posting_date": F.col("l_shipdate").cast("date"),
        "has_installments": F.col("l_discount") > 0.05,
        "installments": term,
        "down_payment": _cents(asked * F.col("l_tax")),
        "monthly_payment": _cents(asked * (1 - F.col("l_tax")) / term),
        "latitude": (30 + F.col("s_nationkey") % 15 + (part % 100) / 100.0).cast("double"),
        "longitude": (-120 + F.col("s_nationkey") * 2 + (supp % 100) / 100.0).cast("double"),
        "description": F.when(rest == 1, F.concat(
            F.lit("entrada de "), whole(asked * F.col("l_tax")), F.lit(" e "),
            term.cast("string"), F.lit("x "), whole(asked / 48), F.lit(",50")))
        .when(rest == 2, F.concat(
            F.lit("clean title, $"), whole(asked / 60),
            F.lit(" per month, down payment $"), whole(asked * 0.1)))
        .when(rest == 3, "like NEW, warranty included")
        .when(rest == 4, F.concat(F.lit("asking price $"), whole(asked), F.lit(" obo"))),
    }


def spread_over_cores(df: DataFrame, *keys: str) -> DataFrame:
    """Hash the rows of an under-split input over all cores; leave any other input alone.

    A file with one row group is one task however many cores wait. A large table has more
    splits than the cluster has cores, so there this never adds a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > cores else df.repartition(cores, *keys)


def _narrow(facts: DataFrame, wanted: list[str]) -> DataFrame:
    """Line items with the numbers that are made of them alone in place of what they are made of.

    A price is the asking price or null by part, a mileage the quantity or null by supplier: made before the joins,
    they spare the keys that only say so on the way through a shuffle.
    """
    exprs = _listing_columns()
    early = ["odometer"] if "odometer" in wanted else []
    if "price" in wanted and not {"description", "down_payment", "monthly_payment"} & set(wanted):
        early.append("price")
    return facts.withColumns({f"_{c}": exprs[c] for c in early}) if early else facts


class Market:
    """The given tables of one scale directory, and listings derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def listings(self, *columns: str, spread: bool = False) -> DataFrame:
        """Listings with the wanted columns only.

        A dimension is joined only if a wanted column comes from it, so a price-by-fuel
        question reads one table and shuffles nothing for joins. Every foreign key has
        its row, so leaving a join out cannot change the row set. No broadcast is forced:
        Spark compares each dimension's size with its threshold. ``spread`` deals an under-split
        table over all cores, for work that goes over its rows many times.
        """
        wanted = list(columns) or ALL_COLUMNS
        needed = reduce(set.union, (_NEEDS.get(c, set()) for c in wanted), set())
        facts = self.table("lineitem")
        if spread or "description" in wanted:  # pattern searches are what keeps a core busy
            facts = spread_over_cores(facts, "l_orderkey", "l_linenumber")
        facts = _narrow(facts, wanted)
        if "orders" in needed:
            orders = self.table("orders").select("o_orderkey", F.year("o_orderdate").alias("_year"), F.substring("o_orderpriority", 1, 1).alias("_priority"))
            facts = facts.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        if "part" in needed:
            facts = facts.join(self.table("part"), F.col("l_partkey") == F.col("p_partkey"))
        if "supplier" in needed:
            sellers = self.table("supplier")
            if "nation" in needed:
                places = self.table("nation")
                if "region" in needed:
                    places = places.join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
                sellers = sellers.join(places, F.col("s_nationkey") == F.col("n_nationkey"))
            facts = facts.join(sellers, F.col("l_suppkey") == F.col("s_suppkey"))
        exprs = _listing_columns()
        exprs |= {c: F.col(f"_{c}") for c in ("price", "odometer") if f"_{c}" in facts.columns}
        return facts.select(*[exprs[c].alias(c) for c in wanted])
