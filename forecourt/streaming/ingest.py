"""Append ingestion of listing files as they arrive, with additive statistics.

The batch counterpart loads files in chunks and then rebuilds its statistics. Here each
micro-batch is written under its own batch number, listings and partial sums alike. Writing
the same batch twice after a failure overwrites the same folder, so nothing is counted
twice, and statistics are the sum of the parts: no stored figure is ever rewritten.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from forecourt.functions.numbers import half_up, ratio
from forecourt.schema import RAW_LISTING
from forecourt.sources import canonical

SUMS = ("price", "monthly_payment", "down_payment", "installments")


def partial_stats(df: DataFrame, by: list[str]) -> DataFrame:
    """Additive parts of the per-key statistics."""
    aggs = [F.count("*").alias("rows"), F.min("price").alias("min_price"), F.max("price").alias("max_price")]
    for c in SUMS:
        if c in df.columns:
            aggs += [F.sum(c).cast("double").alias(f"sum_{c}"), F.count(c).alias(f"known_{c}")]
    return df.dropna(subset=by).groupBy(*by).agg(*aggs)


def merged_stats(parts: DataFrame, by: list[str]) -> DataFrame:
    """Statistics over all batches written so far."""
    known = [c for c in SUMS if f"sum_{c}" in parts.columns]
    return parts.groupBy(*by).agg(
        F.sum("rows").alias("total_listings"), F.min("min_price").alias("min_price"), F.max("max_price").alias("max_price"),
        *[half_up(ratio(F.sum(f"sum_{c}"), F.sum(f"known_{c}"))).alias(f"avg_{c}") for c in known])


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, by: list[str],
           files_per_batch: int = 100) -> StreamingQuery:
    """Take in every CSV listing file under ``source`` not seen before, then stop."""
    arriving = (spark.readStream.schema(RAW_LISTING).option("header", True)
                .option("maxFilesPerTrigger", files_per_batch).csv(source))

    def write(batch: DataFrame, number: int) -> None:
        canonical(batch).write.mode("overwrite").parquet(f"{target}/listings/batch={number}")
        stored = batch.sparkSession.read.parquet(f"{target}/listings/batch={number}")
        partial_stats(stored, by).write.mode("overwrite").parquet(f"{target}/stats/batch={number}")

    return (arriving.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
