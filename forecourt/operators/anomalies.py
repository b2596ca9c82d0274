"""Isolation-forest anomalies and price anomalies by residual."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from forecourt.operators.pricing import Inputs, fair_prices
from forecourt.operators.quantiles import quantile_values
from forecourt.operators.sampling import lot
from forecourt.operators.statistics import mad_anomalies
from forecourt.session import checkpoint_dir

SAMPLE = 256
EULER = 0.5772156649015329


def _mean_depth(n: float) -> float:
    """Expected depth of an unsuccessful search among n values."""
    if n <= 1:
        return 0.0
    return 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


def _grow(points: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """One isolation tree as (node, feature, cut, left, right, depth value) rows."""
    rows, todo = [], [(0, points, 0)]
    made = 1
    while todo:
        node, part, depth = todo.pop()
        spread = np.ptp(part, axis=0) if len(part) else np.zeros(points.shape[1])
        open_features = np.flatnonzero(spread > 0)
        if depth >= limit or len(part) <= 1 or not len(open_features):
            rows.append((node, -1, 0.0, -1, -1, depth + _mean_depth(len(part))))
            continue
        f = int(rng.choice(open_features))
        cut = float(rng.uniform(part[:, f].min(), part[:, f].max()))
        low = part[:, f] < cut
        rows.append((node, f, cut, made, made + 1, 0.0))
        todo += [(made, part[low], depth + 1), (made + 1, part[~low], depth + 1)]
        made += 2
    return rows


def isolation_scores(df: DataFrame, features: list[str], key: str, trees: int = 100, seed: int = 42) -> DataFrame:
    """Add ``anomaly_score`` (0..1, higher is odder) by an isolation forest.

    Unknown values take the column mean and columns are standardised. Each tree grows in its
    own task on at most 256 rows; the grown trees, ``trees`` x 511 nodes at most, are
    shipped to the tasks that score. No listing but the sampled ones ever moves.
    """
    stats = df.agg(F.count("*").alias("n"), *[x for c in features for x in (
        F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    z = [((F.coalesce(F.col(c).cast("double"), F.lit(stats[f"m_{c}"])) - F.lit(stats[f"m_{c}"]))
          / (stats[f"s_{c}"] or 1.0)).alias(f"z{i}") for i, c in enumerate(features)]
    names = [f"z{i}" for i in range(len(features))]

    # half as many rows again as needed, so that every tree fills its sample
    wanted = trees * SAMPLE * 1.5 / max(stats["n"], 1)
    copies = max(1, math.ceil(wanted))
    rows = df.select(key, *z)
    rows = rows.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))) if copies > 1 else F.lit(0))
    picked = rows.where(lot(seed, key, "_copy") < wanted / copies).withColumns({
        "_tree": F.pmod(F.xxhash64(key, "_copy", F.lit(seed + 1)), F.lit(trees)).cast("int"),
        "_order": lot(seed + 2, key, "_copy")}).select("_tree", "_order", *names)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["_tree"].iloc[0])
        points = pdf.sort_values("_order")[names].to_numpy()[:SAMPLE]
        limit = math.ceil(math.log2(max(len(points), 2)))
        out = pd.DataFrame(_grow(points, np.random.default_rng(seed * 1000 + tree), limit),
                           columns=["node", "feature", "cut", "low", "high", "value"])
        return out.assign(tree=tree, size=len(points))

    grown = picked.groupBy("_tree").applyInPandas(
        grow, "node int, feature int, cut double, low int, high int, value double, tree int, size int").toPandas()
    forest = []
    for _, t in grown.groupby("tree"):
        t = t.sort_values("node")
        forest.append(tuple(t[c].to_numpy() for c in ("feature", "cut", "low", "high", "value")))
    scale = _mean_depth(float(grown["size"].mean())) if len(grown) else 1.0
    shipped = df.sparkSession.sparkContext.broadcast((forest, scale))

    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        trees_, scale_ = shipped.value
        for columns in batches:
            points = np.column_stack([c.to_numpy() for c in columns])
            depth = np.zeros(len(points))
            for feature, cut, low, high, value in trees_:
                at = np.zeros(len(points), dtype=np.int64)
                while True:
                    f = feature[at]
                    moving = np.flatnonzero(f >= 0)
                    if not len(moving):
                        break
                    here = at[moving]
                    at[moving] = np.where(points[moving, f[moving]] < cut[here], low[here], high[here])
                depth += value[at]
            yield pd.Series(2.0 ** (-depth / max(len(trees_), 1) / max(scale_, 1e-12)))

    score.__annotations__ = {"batches": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
    return df.withColumn("anomaly_score", F.pandas_udf(score, "double")(*z))


def isolation_anomalies(df: DataFrame, features: list[str], key: str, contamination: float = 0.1, **options) -> DataFrame:
    """Flag the ``contamination`` share of listings with the highest scores.

    Scores are checkpointed: the cut needs them all once before the flag can be set, and
    scoring twice would cost more than writing them.
    """
    checkpoint_dir(df.sparkSession)
    scored = isolation_scores(df, features, key, **options).checkpoint()
    cut = quantile_values(scored, "anomaly_score", {"c": 1 - contamination})["c"]
    return scored.withColumn("is_anomaly", F.col("anomaly_score") > cut)


def price_anomalies(df: DataFrame, inputs: Inputs, key: str, times: float = 3.0) -> DataFrame:
    """Listings whose price or whose distance from the fair price is beyond 3 MADs."""
    checkpoint_dir(df.sparkSession)
    fair = fair_prices(df.select(key, inputs.target, *inputs.categorical, *inputs.numeric), inputs).checkpoint()
    flagged = mad_anomalies(mad_anomalies(fair, "residual", times, "by_residual"), inputs.target, times, "by_price")
    return flagged.withColumn("is_anomaly", F.col("by_residual") | F.col("by_price"))
