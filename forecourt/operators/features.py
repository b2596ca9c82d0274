"""The wide feature table, one row per listing."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt import schema as s
from forecourt.functions.calendar import calendar_parts, days_between, haversine_km, local_time, season_flags
from forecourt.functions.numbers import ratio
from forecourt.functions.text import description_features
from forecourt.operators.joins import attach_group_stats, join_on, known_size
from forecourt.operators.quantiles import one_row
from forecourt.session import checkpoint_dir

_MODEL = ["manufacturer", "model"]
FAMILIES = {
    "make": ["manufacturer"],
    "model": _MODEL,
    "type": ["type"],
    "state": ["state"],
    "week": [*_MODEL, "posting_year", "posting_week"],
    "month": [*_MODEL, "posting_year", "posting_month"],
}


def one_for_zero(c: Column) -> Column:
    return F.when(c == 0, F.lit(1)).otherwise(c)


def condition_code(condition: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in s.CONDITION_CODES.items() for x in pair])
    return F.try_element_at(table, condition)


def segment_flags(make: Column, fuel: Column) -> dict[str, Column]:
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    return {
        "is_luxury": flag(make.isin(s.LUXURY_MAKES)), "is_economy": flag(make.isin(s.ECONOMY_MAKES)),
        "is_american": flag(make.isin(s.AMERICAN_MAKES)), "is_electric": flag(F.lower(fuel).contains("electric")),
        "is_hybrid": flag(F.lower(fuel).contains("hybrid")),
    }


def title_flags(title: Column) -> dict[str, Column]:
    return {f"is_{t}_title": F.coalesce(title == t, F.lit(False)).cast("int")
            for t in ("clean", "salvage", "rebuilt", "lien")}


def _group_figures(rows: DataFrame, id_column: str) -> str:
    """All six families' statistics from one scan, written as a small table per family.

    Grouping sets aggregate every family in the same pass with map-side partial sums. The
    written table gives the later joins a known size, so a family that is small enough is
    broadcast and the listings are not shuffled for it.
    """
    keys = list(dict.fromkeys(k for f in FAMILIES.values() for k in f))
    name = F.lit(None).cast("string")
    for family, by in FAMILIES.items():
        bits = sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in by)
        name = F.when(F.grouping_id() == bits, family).otherwise(name)
    figures = rows.groupingSets([[F.col(k) for k in f] for f in FAMILIES.values()], *keys).agg(
        name.alias("family"),
        F.avg("price").alias("avg_price"), F.stddev_samp("price").alias("std_price"),
        F.avg("odometer").alias("avg_miles"), F.count(id_column).alias("listings"),
        F.avg("condition_numeric").alias("avg_condition"), F.stddev_samp("condition_numeric").alias("std_condition"),
        F.avg("latitude").alias("centre_latitude"), F.avg("longitude").alias("centre_longitude"))
    path = f"{checkpoint_dir(rows.sparkSession)}/forecourt/group-figures-{uuid.uuid4().hex}"
    figures.write.partitionBy("family").parquet(path)
    return path


def feature_table(df: DataFrame, id_column: str = "original_id") -> DataFrame:
    """Features of every priced, dated listing from 1990 on that has a state.

    Raw text, links and the posting moment are left out of the result. The rows are written before they are read by
    each step. The figures of make, model, week and month meet on their common keys, which are few; the
    rows, which are wide, meet them in one join.
    """
    rows = df.where((F.col("price") > 0) & (F.col("year") >= 1990) & F.col("posting_date").isNotNull()
                    & F.col("state").isNotNull())
    rows = rows.withColumns({c: F.col(c).try_cast("double") for c in ("price", "odometer", "latitude", "longitude")})
    rows = rows.withColumn("_local", local_time(F.col("posting_date")))
    rows = rows.withColumns({**calendar_parts(F.col("_local")), "condition_numeric": condition_code(F.col("condition"))})
    text = description_features(F.col("description"), F.col("vin") if "vin" in df.columns else None)
    plain = [c for c in rows.columns if c not in ("_local", "description", "url", "region_url", "image_url")]
    rows = known_size(rows.select(*plain, *[x.alias(c) for c, x in text.items()]))
    path = _group_figures(rows, id_column)
    last = one_row(rows.agg(F.max("posting_year").alias("year"), F.max("posting_date").alias("moment"),
                            F.count("*").alias("rows")))

    taken = {
        "make": {"avg_price": "avg_price_by_manufacturer", "avg_miles": "avg_miles_by_manufacturer",
                 "listings": "listings_by_manufacturer"},
        "model": {"avg_price": "avg_price_by_model", "avg_miles": "avg_miles_by_model", "listings": "listings_by_model",
                  "avg_condition": "_avg_condition", "std_condition": "_std_condition"},
        "type": {"avg_price": "avg_price_by_type", "listings": "listings_by_type"},
        "state": {"avg_price": "avg_price_by_state", "listings": "listings_by_state",
                  "centre_latitude": "_centre_lat", "centre_longitude": "_centre_lon"},
        "week": {"avg_price": "price_avg_by_week", "std_price": "price_std_by_week"},
        "month": {"avg_price": "price_avg_by_month", "std_price": "price_std_by_month"},
    }

    def with_figures(frame: DataFrame, families: tuple[str, ...]) -> DataFrame:
        for family in families:
            figures = rows.sparkSession.read.parquet(f"{path}/family={family}")
            figures = figures.select(*FAMILIES[family], *[F.col(a).alias(b) for a, b in taken[family].items()])
            frame = join_on(frame, figures, FAMILIES[family], "left")
        return frame

    nested = ("make", "model", "week", "month")
    keys = list(dict.fromkeys(k for f in nested for k in FAMILIES[f]))
    cells = known_size(with_figures(rows.select(*keys).distinct(), nested))
    wide = with_figures(join_on(rows, cells, keys, "left", nulls_match=True), ("type", "state"))

    price, miles = F.col("price"), F.col("odometer")
    age = last["year"] - F.col("year")
    against = lambda value, mean: ratio(value - F.col(mean), F.col(mean))
    wide = wide.withColumns({
        "vehicle_age": age, "days_on_market": days_between(last["moment"], F.col("posting_date")), "_rows": last["rows"]})
    aged = one_for_zero(F.col("vehicle_age"))
    features = {
        "price_per_year": price / aged, "price_per_mile": ratio(price, miles),
        "price_position_manufacturer": against(price, "avg_price_by_manufacturer"),
        "price_position_model": against(price, "avg_price_by_model"),
        "price_position_type": against(price, "avg_price_by_type"),
        "miles_per_year": miles / aged, "miles_position": against(miles, "avg_miles_by_model"),
        **{c: F.col(c) for c in text},
        "condition_relative": ratio(F.col("condition_numeric") - F.col("_avg_condition"), F.col("_std_condition")),
        "competitors_same_model": F.col("listings_by_model"), "competitors_same_type": F.col("listings_by_type"),
        "competitors_same_state": F.col("listings_by_state"),
        "market_share_manufacturer": F.col("listings_by_manufacturer") / F.col("_rows"),
        "market_share_model": F.col("listings_by_model") / F.col("_rows"),
        **season_flags(F.col("posting_dayofweek"), F.col("posting_month")),
        "age_mileage_ratio": ratio(F.col("vehicle_age"), miles), "price_mileage_ratio": ratio(price, miles),
        "price_age_ratio": price / aged, "competition_density": F.col("listings_by_model") / F.col("listings_by_state"),
        **segment_flags(F.col("manufacturer"), F.col("fuel")),
        "distance_to_state_center": haversine_km(
            F.col("latitude"), F.col("longitude"), F.col("_centre_lat"), F.col("_centre_lon")),
    }
    if "title_status" in df.columns:
        features |= title_flags(F.col("title_status"))
    wide = wide.withColumns(features)
    figures = [b for family in FAMILIES for b in taken[family].values()]
    return wide.select(*[c for c in (*plain, *figures, "vehicle_age", "days_on_market", *features) if c != "posting_date" and not c.startswith("_")])


def notebook_features(df: DataFrame, as_of_year: int) -> DataFrame:
    """Short feature set: age, price per year and mile, make average, text length."""
    rows = df.withColumn("vehicle_age", F.lit(as_of_year) - F.col("year"))
    rows = rows.withColumns({
        "price_per_year": F.col("price") / one_for_zero(F.col("vehicle_age")),
        "price_per_mile": ratio(F.col("price"), F.col("odometer")),
        "description_length": F.coalesce(F.length("description"), F.lit(0))})
    return attach_group_stats(rows, ["manufacturer"], make_avg_price=F.avg("price"))


def state_distances(df: DataFrame) -> DataFrame:
    """Distance of each listing to the mean position of its state's listings."""
    placed = attach_group_stats(df, ["state"], _lat=F.avg("latitude"), _lon=F.avg("longitude"))
    return placed.withColumn("distance_km", haversine_km(
        F.col("latitude"), F.col("longitude"), F.col("_lat"), F.col("_lon"))).drop("_lat", "_lon")
