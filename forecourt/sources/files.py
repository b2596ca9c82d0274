"""Writers, exports and run metadata."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

EXPORT_COLUMNS = ["manufacturer", "model", "year", "price", "odometer", "fuel", "condition",
                  "region", "posting_date", "state", "latitude", "longitude"]


def ensure_types(df: DataFrame, as_of_year: int) -> DataFrame:
    """Numbers and dates from whatever the source gave; derive the vehicle age if absent."""
    df = df.withColumns({c: F.col(c).try_cast("double") for c in ("year", "price", "odometer") if c in df.columns})
    if dict(df.dtypes).get("posting_date") == "string":
        df = df.withColumn("posting_date", F.try_to_timestamp("posting_date"))
    if "vehicle_age" not in df.columns and "year" in df.columns:
        df = df.withColumn("vehicle_age", F.lit(as_of_year) - F.col("year"))
    return df


def export_columns(df: DataFrame) -> DataFrame:
    rows = df.where((F.col("price") > 0) & (F.col("year") >= 1990) & F.col("posting_date").isNotNull())
    return rows.select(*EXPORT_COLUMNS)


def write_listings(df: DataFrame, path: str, kind: str = "parquet", mode: str = "overwrite",
                   partition_by: list[str] | None = None) -> None:
    """Snappy Parquet or CSV with a header."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if kind == "parquet":
        writer.option("compression", "snappy").parquet(path)
    elif kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        raise ValueError(f"unsupported output type: {kind}")


def append_listings(df: DataFrame, path: str) -> None:
    """Append one batch; Spark writes it in parallel, so no chunk loop is needed."""
    df.write.mode("append").parquet(path)


def write_snapshot_once(df: DataFrame, path: str) -> None:
    """Reference snapshot for drift checks; an existing one is left alone."""
    df.write.mode("ignore").parquet(path)


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "append", batch: int = 10_000, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, batchsize=str(batch), **options).mode(mode).save()


def write_results(results: dict[str, DataFrame], folder: str, rows_per_file: int = 1_000_000) -> None:
    """Each result as CSV and as JSON records, in one output file (in the result's order) for up to ``rows_per_file`` rows.

    A larger one has more files. A result is computed once, by as many tasks as it has; only the kept rows are
    brought together for the files.
    """
    for name, df in results.items():
        kept = df.persist()
        try:
            dealt = kept.coalesce(kept.count() // rows_per_file + 1)
            dealt.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
            dealt.write.mode("overwrite").json(f"{folder}/{name}.json")
        finally:
            kept.unpersist()


def with_run_metadata(df: DataFrame, name: str, **counted) -> tuple[DataFrame, Observation]:
    """The frame plus counters filled in by the job that writes it, without a second pass."""
    seen = Observation(name)
    extra = [c.alias(k) for k, c in counted.items()]
    return df.observe(seen, F.count("*").alias("rows"), *extra), seen


def run_report(seen: Observation, started: dt.datetime, columns: list[str]) -> dict:
    return {**seen.get, "started": started.isoformat(), "ended": dt.datetime.now(dt.timezone.utc).isoformat(),
            "columns": columns}
