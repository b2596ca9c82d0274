"""Batch run: read, check, enrich, clean, check again, measure, write."""

from __future__ import annotations

import datetime as dt
import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from forecourt.functions.numbers import half_up
from forecourt.operators.aggregates import summarise, with_medians
from forecourt.operators.anomalies import isolation_anomalies
from forecourt.operators.cleaning import fill_unknown, within_load_limits
from forecourt.operators.quality import clean_suite, gate, raw_suite
from forecourt.operators.words import with_total_price
from forecourt.sources import canonical, read_listings
from forecourt.sources.files import run_report, with_run_metadata, write_listings, write_snapshot_once

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Transformed:
    """What the transformation gives; frames are lazy."""

    clean: DataFrame
    removed: DataFrame
    market_stats: DataFrame


def enrich_prices(df: DataFrame) -> DataFrame:
    """Financing terms from the text; the price becomes the total they imply."""
    rows = with_total_price(df, name="_t").withColumns({
        "price_original": F.col("_t.original_price"),
        **{c: F.col(f"_t.{c}") for c in ("has_installments", "monthly_payment", "down_payment", "installments")},
        "price": F.coalesce("_t.total_price", "_t.original_price")})
    return rows.drop("_t").where(F.col("price") > 0)


def market_stats(df: DataFrame, as_of: dt.date) -> DataFrame:
    """Price figures and days since the last posting by make, model and year."""
    by = ["manufacturer", "model", "year"]
    rows = df.dropna(subset=by)
    stats = summarise(rows, by, ["avg_price", "min_price", "max_price", "priced"],
                      days_listed=F.datediff(F.lit(as_of), F.max("posting_date")).cast("bigint"))
    return with_medians(stats, rows, by, median_price="price").withColumn("calculated_at", F.lit(as_of))


def transform(df: DataFrame, as_of: dt.date, key: str = "original_id", contamination: float = 0.1) -> Transformed:
    """Enrich, reject by make limits and anomaly, keep plausible years, tidy text."""
    judged = isolation_anomalies(within_load_limits(enrich_prices(df)), ["price", "year", "odometer"], key, contamination)
    reason = F.when(~F.col("price_valid"), "outside_make_limits").when(F.col("is_anomaly"), "price_anomaly")
    ledger = judged.withColumn("reject_reason", reason).drop("price_valid", "is_anomaly", "anomaly_score")
    kept = ledger.where(F.col("reject_reason").isNull()).drop("reject_reason")
    kept = kept.where(F.col("year").between(1950, as_of.year + 1)).withColumn("vehicle_age", F.lit(as_of.year) - F.col("year"))
    clean = fill_unknown(kept)
    return Transformed(clean, ledger.where(F.col("reject_reason").isNotNull()), market_stats(clean, as_of))


def run(spark: SparkSession, source: str, target: str, as_of: dt.date) -> dict:
    """The whole batch. A failed raw suite is logged; a failed clean suite stops the run
    before the clean listings are published."""
    started = dt.datetime.now(dt.timezone.utc)
    raw = canonical(read_listings(spark, source))
    failed = gate(raw, raw_suite(as_of.year), must_pass=False)
    if failed:
        log.warning("raw listings fail: %s", ", ".join(failed))
    seen_raw, incoming = with_run_metadata(raw, "incoming")
    done = transform(seen_raw, as_of)

    counted, outgoing = with_run_metadata(done.clean, "outgoing", avg_price=half_up(F.avg("price")))
    write_listings(counted, f"{target}/staging")
    staged = spark.read.parquet(f"{target}/staging")
    gate(staged, clean_suite(as_of.year), must_pass=True)
    write_listings(staged, f"{target}/listings")
    write_listings(done.removed, f"{target}/removed", partition_by=["reject_reason"])
    write_listings(market_stats(staged, as_of), f"{target}/market_stats")
    write_snapshot_once(staged, f"{target}/reference")
    removed = spark.read.parquet(f"{target}/removed").count()
    report = run_report(outgoing, started, staged.columns)
    return {**report, "input_rows": incoming.get["rows"], "removed_rows": removed}
