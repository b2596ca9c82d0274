"""Schemas and the fixed lookup values of the listings market."""

from __future__ import annotations

from pyspark.sql import types as T

# Raw listing file, 26 columns.
RAW_LISTING = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("region", T.StringType()),
        T.StructField("region_url", T.StringType()),
        T.StructField("price", T.DoubleType()),
        T.StructField("year", T.DoubleType()),
        T.StructField("manufacturer", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("condition", T.StringType()),
        T.StructField("cylinders", T.StringType()),
        T.StructField("fuel", T.StringType()),
        T.StructField("odometer", T.DoubleType()),
        T.StructField("title_status", T.StringType()),
        T.StructField("transmission", T.StringType()),
        T.StructField("VIN", T.StringType()),
        T.StructField("drive", T.StringType()),
        T.StructField("size", T.StringType()),
        T.StructField("type", T.StringType()),
        T.StructField("paint_color", T.StringType()),
        T.StructField("image_url", T.StringType()),
        T.StructField("description", T.StringType()),
        T.StructField("county", T.DoubleType()),
        T.StructField("state", T.StringType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("long", T.DoubleType()),
        T.StructField("posting_date", T.StringType()),
    ]
)

# Fixed values.
CANONICAL_NAMES = {"VIN": "vin", "lat": "latitude", "long": "longitude", "id": "original_id"}

# Fixed values.
REQUIRED_COLUMNS = [
    "manufacturer", "model", "year", "price", "odometer",
    "fuel", "transmission", "state", "posting_date",
]

# Fixed values.
TEXT_COLUMNS = [
    "manufacturer", "model", "condition", "fuel", "title_status",
    "transmission", "drive", "size", "type", "paint_color",
]

# Accepted ranges of the numeric columns.
VALID_RANGES = {"price": (100, 1000000), "year": (1900, 2024), "odometer": (0, 1000000)}

# Alias and accepted-value sets of the text columns.
MAKE_ALIASES = {
    "vw": "volkswagen",
    "chevy": "chevrolet",
    "mercedes": "mercedes-benz",
    "infinity": "infiniti",
}
VALID_SETS = {
    "condition": ["new", "like new", "excellent", "good", "fair", "salvage"],
    "fuel": ["gas", "diesel", "hybrid", "electric", "other"],
    "transmission": ["manual", "automatic", "other"],
}

# Fixed values.
FUEL_NAMES = {
    "gas": "gasoline",
    "petrol": "gasoline",
    "diesel fuel": "diesel",
    "flex": "hybrid",
    "electric fuel": "electric",
}
# Fixed values.
TRANSMISSION_NAMES = {
    "manual": "manual",
    "automatic": "automatic",
    "automated": "automatic",
    "auto": "automatic",
    "cvt": "automatic",
}

# Price limits by make, load-time set and audit set.
LOAD_LIMITS = {
    "toyota": (5000, 150000),
    "honda": (4000, 130000),
    "ford": (3000, 120000),
    "chevrolet": (3000, 110000),
    "bmw": (10000, 200000),
    "mercedes-benz": (12000, 250000),
    "audi": (10000, 180000),
    "volkswagen": (3000, 100000),
    "hyundai": (3000, 90000),
    "kia": (3000, 85000),
}
LOAD_DEFAULT_LIMITS = (2000, 300000)

AUDIT_LIMITS = {
    "ferrari": (100000, 2000000),
    "lamborghini": (100000, 2000000),
    "rolls-royce": (100000, 2000000),
    "bentley": (80000, 1000000),
    "porsche": (50000, 1000000),
    "maserati": (50000, 800000),
    "aston martin": (80000, 1000000),
    "mercedes-benz": (20000, 500000),
    "bmw": (20000, 500000),
    "audi": (20000, 500000),
    "lexus": (20000, 400000),
    "tesla": (30000, 200000),
}
AUDIT_DEFAULT_LIMITS = (5000, 200000)

# Ordinal codes of the condition column.
CONDITION_CODES = {"new": 5, "like new": 4, "excellent": 3, "good": 2, "fair": 1, "salvage": 0}

# Make segments.
LUXURY_MAKES = ["bmw", "mercedes-benz", "audi", "porsche", "lexus"]
ECONOMY_MAKES = ["toyota", "honda", "hyundai", "kia", "nissan"]
AMERICAN_MAKES = ["ford", "chevrolet", "dodge", "jeep", "chrysler"]

SENTINEL_PRICE = 987654321
