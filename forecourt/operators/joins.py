"""Join helpers and the lookup joins."""

from __future__ import annotations

import uuid
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.session import checkpoint_dir


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner",
            nulls_match: bool = False) -> DataFrame:
    """Equi join that keeps one copy of the keys.

    Ordinary equality by default, so a null key finds no partner (and a left join gives
    it nulls); ``nulls_match`` pairs null with null, as after a SQL group-by.
    """
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    pair = [
        left[k].eqNullSafe(other[f"_right_{k}"]) if nulls_match else left[k] == other[f"_right_{k}"]
        for k in keys
    ]
    if how in ("full", "full_outer", "outer"):
        both = left.join(other, reduce(and_, pair), "full")
        merged = [F.coalesce(left[k], other[f"_right_{k}"]).alias(k) for k in keys]
        rest = [left[c] for c in left.columns if c not in keys]
        rest += [other[c] for c in right.columns if c not in keys]
        return both.select(*merged, *rest)
    return left.join(other, reduce(and_, pair), how).drop(*[f"_right_{k}" for k in keys])


def keep_frequent(df: DataFrame, key: str, min_count: int | None = None, top: int | None = None) -> DataFrame:
    """Rows whose key is among the ``top`` most frequent, or occurs ``min_count`` times."""
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    if min_count is not None:
        counts = counts.where(F.col("_n") >= min_count)
    if top is not None:
        counts = counts.orderBy(F.desc("_n"), key).limit(top)
    return join_on(df, counts.select(key), [key], "left_semi")


def attach_group_stats(df: DataFrame, by: list[str], **aggs: Column) -> DataFrame:
    """Add per-group statistics to each row.

    Aggregates first (partial sums on the map side) and joins the small result back, so a
    group holding a third of the rows never has to fit one task as it would in a window.
    The statistics are a written table of known size: if they are small, they are broadcast and
    the rows stay where they are, not shuffled by a key of a few values. A null key gets null statistics.
    """
    stats = df.dropna(subset=by).groupBy(*by).agg(*[c.alias(k) for k, c in aggs.items()])
    return join_on(df, known_size(stats), by, "left")


def known_size(df: DataFrame) -> DataFrame:
    """``df`` written in the shared folder and read again, so that joins know how large it is."""
    path = f"{checkpoint_dir(df.sparkSession)}/forecourt/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_price_by_key(cars: DataFrame, prices: DataFrame, keys: list[str], order: str) -> DataFrame:
    """For each car the first price recorded under its key."""
    first = prices.dropna(subset=keys).groupBy(*keys).agg(F.min_by("price", order).alias("first_price"))
    return join_on(cars, first, keys)


def upsert(stored: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Insert-or-replace: fresh rows win, stored rows without a fresh one stay."""
    values = [c for c in stored.columns if c not in keys]
    marked = fresh.withColumnsRenamed({v: f"_new_{v}" for v in values}).withColumn("_fresh", F.lit(True))
    both = join_on(stored, marked, keys, "full", nulls_match=True)
    return both.select(
        *keys,
        *[F.when(F.col("_fresh"), F.col(f"_new_{v}")).otherwise(F.col(v)).alias(v) for v in values],
    )
