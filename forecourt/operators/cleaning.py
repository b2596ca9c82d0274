"""Cleaning: coercion, normalising, repair, and the audited rejection of listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt import schema as s
from forecourt.functions.numbers import half_up
from forecourt.operators.joins import join_on, known_size
from forecourt.operators.market import limit_of
from forecourt.operators.quantiles import one_row, quantile_values, quantiles
from forecourt.operators.words import with_raised_price


def base_view(df: DataFrame, as_of_year: int) -> DataFrame:
    """Priced, dated listings from 1990 on, with the vehicle age."""
    rows = df.where((F.col("price") > 0) & (F.col("year") >= 1990) & F.col("posting_date").isNotNull())
    return rows.withColumn("vehicle_age", F.lit(as_of_year) - F.col("year"))


def search(df: DataFrame, *, manufacturer: str | None = None, state: str | None = None,
           min_price: float | None = None, max_price: float | None = None,
           min_year: int | None = None, max_year: int | None = None,
           has_installments: bool | None = None) -> DataFrame:
    """Listings meeting every condition that is given; 0 is a condition, None is not."""
    if manufacturer is not None:
        df = df.where(F.col("manufacturer").ilike(f"%{manufacturer}%"))
    if state is not None:
        df = df.where(F.col("state").ilike(f"%{state}%"))
    for column, low, high in (("price", min_price, max_price), ("year", min_year, max_year)):
        if low is not None:
            df = df.where(F.col(column) >= low)
        if high is not None:
            df = df.where(F.col(column) <= high)
    if has_installments is not None:
        df = df.where(F.col("has_installments") == has_installments)
    return df


def page(df: DataFrame, key: str, skip: int = 0, limit: int = 100) -> DataFrame:
    """One page in key order; at most 1000 rows."""
    if skip < 0 or not 1 <= limit <= 1000:
        raise ValueError("skip must be >= 0 and limit within 1..1000")
    return df.orderBy(key).offset(skip).limit(limit)


def coerce_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.col(c).try_cast("double") for c in columns if c in df.columns})


def null_outside(df: DataFrame, ranges: dict[str, tuple] = s.VALID_RANGES) -> DataFrame:
    """Null out values outside their range; the row stays."""
    return df.withColumns({
        c: F.when(F.col(c).between(low, high), F.col(c)) for c, (low, high) in ranges.items() if c in df.columns})


def normalise_text(df: DataFrame, columns: list[str]) -> DataFrame:
    def tidy(c: str) -> Column:
        text = F.trim(F.lower(c))
        return F.when(~text.isin("nan", "none", ""), text)

    return df.withColumns({c: tidy(c) for c in columns if c in df.columns})


def fill_unknown(df: DataFrame, columns: list[str] = s.TEXT_COLUMNS) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(F.trim(F.lower(c)), F.lit("unknown")) for c in columns if c in df.columns})


def rename_values(value: Column, names: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(F.try_element_at(table, value), value)


def standard_values(df: DataFrame) -> DataFrame:
    """Filled and lower-cased text, fuel and transmission under their common names, state upper."""
    df = fill_unknown(df, ["manufacturer", "model", "fuel", "transmission"])
    return df.withColumns({
        "fuel": rename_values(F.col("fuel"), s.FUEL_NAMES),
        "transmission": rename_values(F.col("transmission"), s.TRANSMISSION_NAMES),
        "state": F.trim(F.upper(F.coalesce("state", F.lit("unknown")))),
    })


def apply_aliases(df: DataFrame, aliases: dict[str, str] = s.MAKE_ALIASES,
                  valid: dict[str, list[str]] = s.VALID_SETS) -> DataFrame:
    """Make aliases resolved; values outside a column's accepted set become null."""
    df = df.withColumn("manufacturer", rename_values(F.lower("manufacturer"), aliases))
    return df.withColumns({
        c: F.when(F.lower(c).isin(values), F.lower(c)) for c, values in valid.items() if c in df.columns})


def fill_medians(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({
        c: F.coalesce(F.col(c).cast("double"), quantile_values(df, c, {"m": 0.5})["m"]) for c in columns})


def price_category(price: Column) -> Column:
    """Fixed bins open below and closed above; 0 and less give null."""
    return (F.when(price <= 0, None).when(price <= 10000, "<10k").when(price <= 20000, "10k-20k")
            .when(price <= 30000, "20k-30k").when(price <= 50000, "30k-50k").when(price > 50000, ">50k"))


def mark_repeats(df: DataFrame, suspicious: Column, keys: list[str], id_column: str) -> DataFrame:
    """Flag ``is_repeat``: suspicious rows sharing all keys with a suspicious row of lower id."""
    first = df.where(suspicious).dropna(subset=keys).groupBy(*keys).agg(F.min(id_column).alias("_first"))
    marked = join_on(df, first, keys, "left")
    repeat = F.coalesce(suspicious & (F.col(id_column) != F.col("_first")), F.lit(False))
    return marked.withColumn("is_repeat", repeat).drop("_first")


def corrected_price(manufacturer: Column, model: Column, price: Column) -> Column:
    """Prices known to be mistyped."""
    # Fixed values: (make, model or any, stated price, real price).
    known = [("honda", None, 80, 800.0), ("cadillac", "escalade esv", 1, 5500.0)]
    out = price
    for make, name, wrong, right in known:
        hit = (F.lower(manufacturer) == make) & (price == wrong)
        if name:
            hit = hit & (F.lower(model) == name)
        out = F.when(hit, F.lit(right)).otherwise(out)
    return out


def says_monthly(description: Column) -> Column:
    return F.coalesce(F.lower(description).rlike("month|payment"), F.lit(False))


def suspicious_charger() -> Column:
    """The repeated listing the reference audit found."""
    return ((F.lower("manufacturer") == "dodge") & (F.lower("model") == "charger")
            & (F.col("price") == 199) & (F.col("year") == 2017))


def price_ledger(df: DataFrame, id_column: str, *, suspicious: Column | None = None,
                 repeat_keys: list[str] | None = None, low: float = 500, high: float = 1_000_000) -> DataFrame:
    """Every listing with its corrected price and a ``reject_reason`` (null when kept).

    Rules apply in order and the first that fits names the reason, so a listing is counted
    once. Split with :func:`kept` and :func:`rejected`.
    """
    suspicious = suspicious_charger() if suspicious is None else suspicious
    marked = mark_repeats(df, suspicious & (F.col("price") != s.SENTINEL_PRICE),
                          repeat_keys or ["manufacturer", "model", "price", "year"], id_column)
    fixed = corrected_price(F.col("manufacturer"), F.col("model"), F.col("price"))
    reason = (F.when(F.col("price") == s.SENTINEL_PRICE, "sentinel_price")
              .when(F.col("is_repeat"), "duplicate_listing")
              .when(says_monthly(F.col("description")), "monthly_payment")
              .when(fixed < low, "low_price")
              .when(fixed > high, "high_price"))
    return marked.withColumns({"reject_reason": reason, "price": fixed}).drop("is_repeat")


def audit_ledger(df: DataFrame) -> DataFrame:
    """Second rule set: no price, then estimate from text, then limits by make."""
    price, make = F.col("price"), F.col("manufacturer")
    raised = F.col("_raised")
    low = limit_of(make, s.AUDIT_LIMITS, s.AUDIT_DEFAULT_LIMITS, 0)
    high = limit_of(make, s.AUDIT_LIMITS, s.AUDIT_DEFAULT_LIMITS, 1)
    reason = (F.when(price.isNull() | (price <= 0), "no_price")
              .when(raised < low, "below_make_limit").when(raised > high, "above_make_limit"))
    rows = with_raised_price(df, name="_raised")
    return rows.withColumns({"reject_reason": reason, "price": raised}).drop("_raised")


def kept(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(ledger: DataFrame) -> DataFrame:
    return ledger.where(F.col("reject_reason").isNotNull())


def within_load_limits(df: DataFrame) -> DataFrame:
    """Flag ``price_valid`` by the load-time limits of the make; a null price is not valid."""
    make, price = F.col("manufacturer"), F.col("price")
    low = limit_of(make, s.LOAD_LIMITS, s.LOAD_DEFAULT_LIMITS, 0)
    high = limit_of(make, s.LOAD_LIMITS, s.LOAD_DEFAULT_LIMITS, 1)
    return df.withColumn("price_valid", F.coalesce(price.between(low, high), F.lit(False)))


def clean_view(df: DataFrame) -> DataFrame:
    """Trustworthy listings: complete, plausible against their make, consistent financing."""
    price = F.col("price")
    by_make = df.where(price > 0).groupBy("manufacturer").agg(
        F.avg("price").alias("_mean"), F.stddev_samp("price").alias("_std"))
    gap = F.abs(price - (F.col("monthly_payment") * F.col("installments")
                         + F.coalesce("down_payment", F.lit(0.0))))
    financed = (F.col("has_installments") & (F.col("monthly_payment") > 0)
                & F.col("installments").between(1, 120) & (gap <= 0.01))
    rows = df.where(
        F.col("model").isNotNull() & F.col("year").between(1900, 2024) & (price > 0)
        & (financed | ~F.col("has_installments"))
        & (F.col("odometer").isNull() | ((F.col("odometer") > 0) & (F.col("odometer") < 1_000_000))))
    joined = join_on(rows, by_make, ["manufacturer"])
    return joined.where((price >= F.col("_mean") * 0.1) & (price <= F.col("_mean") + 3 * F.col("_std"))).drop("_mean", "_std")


def drop_wide_outliers(df: DataFrame, columns: tuple[str, ...] = ("price", "odometer"),
                       min_year: int | None = 2000) -> DataFrame:
    """Keep P1 - 1.5 spread .. P99 + 1.5 spread, one column after another; nulls go.

    Two numbers per column come to the driver, so each fence is a literal that the Parquet
    reader can use to skip row groups of the written rows.
    """
    df = known_size(df)
    for c in columns:
        q = quantiles(df, c, {"a": 0.01, "b": 0.99}).first()
        if q is None:
            return df.where(F.lit(False))
        gap = (q.b - q.a) * 1.5
        df = df.where(F.col(c).between(q.a - gap, q.b + gap))
    return df.where(F.col("year") >= min_year) if min_year is not None else df


def low_price_audit(df: DataFrame, below: float) -> DataFrame:
    """Low-priced listings by all their fields, with how often each occurs."""
    fields = ["manufacturer", "model", "year", "state", "price", "description"]
    return df.where(F.col("price") < below).groupBy(*fields).agg(F.count("*").alias("count"))


def comparables(df: DataFrame, requests: DataFrame, span: int = 2, days_listed: str | None = None) -> DataFrame:
    """Price figures of like listings for each requested (make, model, year).

    Listings are first counted per make, model, year and price, in a written table that all further steps read. A request
    is spread over the model years within ``span`` and meets those counts, so listings are never copied, and counts
    nobody asks for are dropped in the join. Where none is found the make's own figures are used; they are taken for
    such makes only. ``days_listed`` names a column whose average is added as ``avg_days_listed``.
    """
    close_by, make_by = ["manufacturer", "model", "year"], ["manufacturer"]
    days = [F.sum(days_listed).alias("_days"), F.count(days_listed).alias("_dated")] if days_listed else []
    cells = known_size(df.dropna(subset=make_by).groupBy(*close_by, "price").agg(F.count("*").alias("_n"), *days))
    figures = ["total_listings", "priced", "avg_price", "min_price", "max_price", "std_price", *(["avg_days_listed"] if days_listed else []), "median_price"]

    def measured(rows: DataFrame, by: list[str]) -> DataFrame:
        x, n = F.col("price"), F.when(F.col("price").isNotNull(), F.col("_n"))
        priced = F.coalesce(F.sum(n), F.lit(0))
        spread = (F.sum(x * x * n) - F.pow(F.sum(x * n), F.lit(2)) / F.nullif(priced, F.lit(0))) / F.nullif(priced - 1, F.lit(0))
        dated = [half_up(F.sum("_days") / F.nullif(F.sum("_dated"), F.lit(0))).alias("avg_days_listed")] if days_listed else []
        base = rows.groupBy(*by).agg(
            F.sum("_n").alias("total_listings"), priced.alias("priced"), half_up(F.sum(x * n) / F.nullif(priced, F.lit(0))).alias("avg_price"),
            F.min(x).alias("min_price"), F.max(x).alias("max_price"), half_up(F.sqrt(F.when(spread < 0, 0.0).otherwise(spread))).alias("std_price"), *dated)
        middle = quantiles(rows, "price", {"median_price": 0.5}, by, weight="_n").withColumn("median_price", half_up("median_price"))
        return join_on(base, middle, by, "left", nulls_match=True)

    asked = requests.select(*close_by).distinct().dropna()
    years = asked.select(*close_by, F.explode(F.sequence(F.col("year") - span, F.col("year") + span)).alias("_near"))
    near = known_size(join_on(cells.withColumnRenamed("year", "_near"), years, ["manufacturer", "model", "_near"]))
    close = known_size(measured(near, close_by))
    lonely = known_size(join_on(requests.select(*close_by), close, close_by, "left_anti").select("manufacturer").dropna().distinct())
    make = measured(join_on(cells, lonely, make_by, "left_semi"), make_by)
    both = join_on(join_on(requests, close, close_by, "left"), make.withColumnsRenamed({c: f"_make_{c}" for c in figures}), make_by, "left")
    alone = F.col("total_listings").isNull()
    return both.select(
        *close_by, F.when(alone, "make").otherwise("model").alias("basis"),
        *[F.when(alone, F.col(f"_make_{c}")).otherwise(F.col(c)).alias(c) for c in figures])


def sidebar_filter(df: DataFrame, years: tuple | None = None, makes: list[str] | None = None,
                   regions: list[str] | None = None, prices: tuple | None = None) -> DataFrame:
    """Interactive filter; without a price range it is the minimum up to the 99th percentile."""
    if years:
        df = df.where(F.col("year").between(*years))
    if prices is None:
        top = quantile_values(df, "price", {"p": 0.99})["p"]
        df = df.where(F.col("price") <= top)
    else:
        df = df.where(F.col("price").between(*prices))
    if makes:
        df = df.where(F.col("manufacturer").isin(makes))
    if regions:
        df = df.where(F.col("region").isin(regions))
    return df


def load_check(df: DataFrame) -> DataFrame:
    """Row count and nulls per column in one pass, as (column_name, nulls, total_rows)."""
    counts = df.agg(F.count("*").alias("total_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    return counts.unpivot(["total_rows"], df.columns, "column_name", "nulls")


def scalar_max(df: DataFrame, column: str) -> Column:
    return one_row(df.agg(F.max(column).alias("x")))["x"]
