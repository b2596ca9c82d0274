"""Forecasts: volume and price by season and trend, demand per series, listing traits."""

from __future__ import annotations

import datetime as dt
import math
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import IndexToString, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.calendar import local_time
from forecourt.operators.joins import join_on, known_size
from forecourt.session import checkpoint_dir

HORIZONS = (1, 7, 15, 30, 60)


def season_columns(day: Column, yearly: int = 10, weekly: int = 3) -> dict[str, Column]:
    """Fourier terms of the year and of the week for a date."""
    n = F.unix_date(day).cast("double")
    out = {}
    for name, length, order in (("y", 365.25, yearly), ("w", 7.0, weekly)):
        for i in range(1, order + 1):
            angle = n * (2 * math.pi * i / length)
            out |= {f"{name}_sin{i}": F.sin(angle), f"{name}_cos{i}": F.cos(angle)}
    return out


@dataclass
class Trend:
    """A fitted series on a scale of its own: weights of the terms, their spread, which are slope changes, and the noise."""

    weights: np.ndarray
    spread: np.ndarray
    which: slice
    noise: float

    @property
    def changes(self) -> np.ndarray:
        return self.weights[self.which]

    def band(self, ahead: np.ndarray, terms: np.ndarray, level: float = 0.95, draws: int = 2000, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """What to add to the forecast at times ``ahead`` (history ends at 1), whose terms are given, for the ends of the band.

        Each draw takes weights as uncertain as the history leaves them, a slope that goes on changing as often and by as
        much as the drawn changes, and noise.
        """
        rng = np.random.default_rng(seed)
        off = rng.multivariate_normal(np.zeros(len(self.weights)), self.spread, draws, method="eigh")
        paths = off @ terms.T
        far = ahead.max() if len(ahead) else 1.0
        if len(self.changes) and far > 1:
            size = np.abs(self.changes + off[:, self.which]).mean()
            many = rng.poisson(len(self.changes) * (far - 1), draws)
            draw = np.repeat(np.arange(draws), many)
            when, change = rng.uniform(1, far, len(draw)), rng.laplace(0, size, len(draw))
            np.add.at(paths, draw, change[:, None] * np.maximum(ahead[None, :] - when[:, None], 0))
        paths += rng.normal(0, self.noise, paths.shape)
        return tuple(np.quantile(paths, [(1 - level) / 2, (1 + level) / 2], axis=0))


def fitted_trend(gram: np.ndarray, rows: int, penalties: np.ndarray, changes: slice) -> Trend:
    """Most likely weights given the sums of products of the terms and, last, of the value.

    Slope changes have a Laplace prior of the given scale, so most of them are 0; the other terms a normal one. Coordinate
    descent takes one weight at a time; the noise follows from what is left and the two are repeated until they agree.
    """
    g, target, square = gram[:-1, :-1], gram[:-1, -1], gram[-1, -1]
    sparse = np.zeros(len(g), bool)
    sparse[changes] = True
    weights = np.linalg.solve(g + np.diag(np.where(sparse, 1e-3, 1e-9) * rows + 1e-12), target)
    noise = 0.0
    for _ in range(20):
        before, left = noise, square - 2 * weights @ target + weights @ g @ weights
        noise = max(left / rows, 1e-12)
        if abs(noise - before) <= 1e-4 * noise:
            break
        hold = np.where(sparse, noise / penalties, noise / penalties ** 2)
        slope = target - g @ weights
        for _ in range(400):
            moved = 0.0
            for j in range(len(g)):
                if g[j, j] <= 0:
                    continue
                pull = slope[j] + g[j, j] * weights[j]
                new = np.sign(pull) * max(abs(pull) - hold[j], 0) / g[j, j] if sparse[j] else pull / (g[j, j] + hold[j])
                if new != weights[j]:
                    slope -= g[:, j] * (new - weights[j])
                    moved = max(moved, abs(new - weights[j]) * math.sqrt(g[j, j] / rows))
                    weights[j] = new
            if moved < 1e-6:
                break
    prior = np.where(sparse, 2 * penalties ** 2, penalties ** 2)  # variances of the two kinds of prior
    return Trend(weights, noise * np.linalg.inv(g + np.diag(noise / prior)), changes, math.sqrt(noise))


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x = batch.column("terms").flatten().to_numpy().reshape(batch.num_rows, -1)
            sums = (x.T @ x).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums), dtype=np.int32)), pa.array(sums)], ["at", "product"])


def seasonal_forecast(daily: DataFrame, value: str, days: int, trend: bool = True, start: dt.date | None = None,
                      regressor: str | None = None, regressor_ahead: Column | None = None, changepoints: int = 25,
                      change_scale: float = 0.05, level: float = 0.95, yearly: int = 10, weekly: int = 3) -> DataFrame:
    """Fit trend and seasons to a daily series and look ``days`` ahead.

    Gives (period, yhat, yhat_lower, yhat_upper, is_future) for the history and the days after it (or from ``start`` on).
    The trend is a line whose slope may change at ``changepoints`` days spread over the first four fifths of the
    history; a Laplace prior of ``change_scale`` leaves most of them out. The band holds ``level`` of the noise and, ahead,
    of slope changes like those seen. ``yearly`` and ``weekly`` are the orders of the seasons; in a series of less than two
    years the year's waves can stand in for a change of slope. Sums of products are taken in Spark; only their matrix, of a size set by the
    number of terms, comes to the driver.
    """
    spark = daily.sparkSession
    checkpoint_dir(spark)
    daily = daily.checkpoint()  # a row per day, read several times below
    known = daily.where(F.col(value).isNotNull()).select("period", F.col(value).cast("double").alias("y"), *([F.col(regressor).cast("double").alias("_r")] if regressor else []))
    figures = [F.count("*").alias("n"), F.max(F.abs("y")).alias("scale")] + ([F.avg("_r").alias("mean"), F.stddev_pop("_r").alias("std")] if regressor else [])
    s = known.agg(*figures).first()
    edge = daily.agg(F.min("period").alias("a"), F.max("period").alias("b")).first()
    if edge.a is None or not s.n:
        raise ValueError("the series is empty")
    first = start or edge.b + dt.timedelta(days=1)
    ahead = spark.range(days).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("period"))
    if regressor:
        ahead = ahead.withColumn("_r", regressor_ahead.cast("double"))
    span, scale = max((edge.b - edge.a).days, 1), s.scale or 1.0
    t = F.datediff("period", F.lit(edge.a)) / float(span)
    many = min(changepoints, int(0.8 * s.n) - 1) if trend else 0
    cuts = [0.8 * k / many for k in range(1, many + 1)] if many > 0 else []
    terms = [F.lit(1.0), *([t] if trend else []), *[F.greatest(t - c, F.lit(0.0)) for c in cuts]]
    changes = slice(len(terms) - len(cuts), len(terms))
    penalties = [5.0] * (len(terms) - len(cuts)) + [change_scale] * len(cuts)
    seasons = list(season_columns(F.col("period"), yearly, weekly).values())
    terms += seasons
    penalties += [10.0] * len(seasons)
    if regressor:
        terms.append((F.coalesce("_r", F.lit(s["mean"])) - s["mean"]) / (s["std"] or 1.0))
        penalties.append(10.0)

    rows = known.select(F.array(*terms, F.col("y") / scale).alias("terms"))
    sums = {r["at"]: r["product"] for r in rows.mapInArrow(_products, "at int, product double").groupBy("at").agg(F.sum("product").alias("product")).collect()}
    gram = np.array([sums[k] for k in range((len(terms) + 1) ** 2)]).reshape(len(terms) + 1, -1)
    fit = fitted_trend(gram, s.n, np.array(penalties), changes)

    yhat = sum((x * float(w * scale) for x, w in zip(terms, fit.weights) if w), F.lit(0.0))
    times = np.array([((first - edge.a).days + k) / span for k in range(days)])
    later = [r["terms"] for r in ahead.orderBy("period").select(F.array(*terms).alias("terms")).collect()]  # a row per day asked for
    low, high = fit.band(times, np.array(later, float).reshape(-1, len(terms)), level)
    ends = spark.createDataFrame([(first + dt.timedelta(days=k), float(a * scale), float(b * scale)) for k, (a, b) in enumerate(zip(low, high))],
                                 "period date, _low double, _high double")
    margin = NormalDist().inv_cdf((1 + level) / 2) * fit.noise * scale
    past = known.select("period", yhat.alias("yhat"), F.lit(-margin).alias("_low"), F.lit(margin).alias("_high"), F.lit(False).alias("is_future"))
    future = join_on(ahead, ends, ["period"]).select("period", yhat.alias("yhat"), "_low", "_high", F.lit(True).alias("is_future"))
    return past.unionByName(future).select(
        "period", "yhat", (F.col("yhat") + F.col("_low")).alias("yhat_lower"), (F.col("yhat") + F.col("_high")).alias("yhat_upper"), "is_future")


def volume_forecast(daily: DataFrame, count: str, days: int = 60, start: dt.date | None = None) -> DataFrame:
    """Daily listing counts ahead: seasons without trend on log1p counts, never below 1."""
    logged = daily.withColumn("_y", F.log1p(count))
    out = seasonal_forecast(logged, "_y", days + 1, trend=False, start=start).where("is_future")
    return out.select("period", F.greatest(F.floor(F.expm1("yhat")), F.lit(1)).cast("bigint").alias("expected_volume"))


def price_trend(forecast: DataFrame) -> DataFrame:
    """Last fitted price against the last forecast one."""
    now = F.max_by("yhat", F.when(~F.col("is_future"), F.col("period")))
    later = F.max_by("yhat", F.when(F.col("is_future"), F.col("period")))
    out = forecast.agg(now.alias("current_price"), later.alias("forecasted_price"))
    change = F.col("forecasted_price") - F.col("current_price")
    return out.withColumns({
        "price_change": change, "price_change_percent": change / F.nullif("current_price", F.lit(0.0)) * 100,
        "trend_direction": F.when(change > 0, "up").otherwise("down")})


def demand_forecasts(df: DataFrame, by: list[str], moment: str, days: int = 30, min_points: int = 2) -> DataFrame:
    """Daily demand ahead for every region and model.

    Listings are counted per series and day, and the normal equations of all series are partial sums of products, so
    a series is one row of sums however long it is, and any number of series is solved in batches.
    """
    daily = df.dropna(subset=[*by, moment]).groupBy(*by, F.col(moment).cast("date").alias("period")).agg(F.count("*").alias("y"))
    span = daily.groupBy(*by).agg(F.min(F.unix_date("period")).alias("_first"), F.max(F.unix_date("period")).alias("_last"), F.count("*").alias("_points"))
    span = span.where(F.col("_points") >= min_points)
    rows = join_on(daily, known_size(span), by)
    day = F.unix_date("period").cast("double")
    waves = [(length, i) for length, order in ((365.25, 3), (7.0, 3)) for i in range(1, order + 1)]
    terms = [F.lit(1.0), (day - F.col("_first")) / F.greatest(F.col("_last") - F.col("_first"), F.lit(1))]
    terms += [f(day * (2 * math.pi * i / length)) for length, i in waves for f in (F.sin, F.cos)]
    m = len(terms)
    rows = rows.select(*by, "_first", "_last", F.col("y").cast("double").alias("_y"), *[x.alias(f"_t{i}") for i, x in enumerate(terms)])
    pairs = [(i, j) for i in range(m) for j in range(i, m)]
    sums = [F.sum(F.col(f"_t{i}") * F.col(f"_t{j}")) for i, j in pairs] + [F.sum(F.col(f"_t{i}") * F.col("_y")) for i in range(m)]
    solved = rows.groupBy(*by, "_first", "_last").agg(F.array(*sums).alias("_sums"))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            sums = batch.column("_sums").flatten().to_numpy().reshape(n, -1)
            gram, target = np.zeros((n, m, m)), sums[:, len(pairs):]
            for k, (i, j) in enumerate(pairs):
                gram[:, i, j] = gram[:, j, i] = sums[:, k]
            weights = np.linalg.solve(gram + np.eye(m), target[:, :, None])[:, :, 0]
            first, last = (batch.column(c).to_numpy().astype(float) for c in ("_first", "_last"))
            future = last[:, None] + np.arange(1, days + 1)
            yhat = weights[:, :1] + weights[:, 1:2] * (future - first[:, None]) / np.maximum(last - first, 1.0)[:, None]
            for k, (length, i) in enumerate(waves):
                angle = future * (2 * math.pi * i / length)
                yhat += weights[:, 2 + 2 * k, None] * np.sin(angle) + weights[:, 3 + 2 * k, None] * np.cos(angle)
            of = pa.array(np.repeat(np.arange(n), days))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c).take(of) for c in by], pa.array(future.reshape(-1).astype(np.int32)).cast(pa.date32()), pa.array(np.maximum(yhat, 0).reshape(-1))],
                [*by, "period", "yhat"])

    kinds = dict(daily.dtypes)
    return solved.mapInArrow(solve, ", ".join(f"{c} {kinds[c]}" for c in by) + ", period date, yhat double")


_DATE_FEATURES = ["posting_year", "month", "day", "dayofweek", "quarter", "is_weekend", "vehicle_age"]


def _date_features(local: Column) -> dict[str, Column]:
    return {"posting_year": F.year(local), "month": F.month(local), "day": F.dayofmonth(local),
            "dayofweek": F.weekday(local), "quarter": F.quarter(local),
            "is_weekend": F.weekday(local).isin(5, 6).cast("int")}


def listing_forecast(df: DataFrame, as_of: dt.date, traits: tuple[str, ...] = ("manufacturer", "model", "type", "region"),
                     min_count: int = 100, trees: int = 100, depth: int = 6, horizons: tuple[int, ...] = HORIZONS) -> DataFrame:
    """Expected volume, price, make, model, type and region on days ahead of ``as_of``.

    The inputs are calendar values and the vehicle's age, so listings are first counted per
    distinct input and label; training then works on weighted counts, not on listings.
    Values seen fewer than ``min_count`` times are left out, and classes weigh equally.
    """
    spark = df.sparkSession
    rows = df.where((F.col("price") > 0) & (F.col("year") >= 1990) & F.col("posting_date").isNotNull() & F.col("type").isNotNull())
    local = local_time(F.col("posting_date"))
    rows = rows.withColumns(_date_features(local)).withColumn("vehicle_age", F.col("posting_year") - F.col("year"))
    daily = rows.groupBy(local.cast("date").alias("period")).agg(F.count("*").alias("y"))
    volume = volume_forecast(daily, "y", days=max(horizons), start=as_of)
    every = rows.groupBy(*_DATE_FEATURES, *traits).agg(F.count("*").alias("_n"), F.sum("price").alias("_price")).persist()
    # each value is counted over all listings, whichever of their other values are rare
    counted = every
    for c in traits:
        often = every.where(F.col(c).isNotNull()).groupBy(c).agg(F.sum("_n").alias("_all")).where(F.col("_all") >= min_count)
        counted = join_on(counted, often.select(c), [c], "left_semi")
    counted = counted.persist()
    gather = VectorAssembler(inputCols=_DATE_FEATURES, outputCol="features")
    try:
        age = counted.agg(F.sum(F.col("vehicle_age") * F.col("_n")) / F.sum("_n")).first()[0]
        ahead = spark.createDataFrame([(h, as_of + dt.timedelta(days=h), age) for h in horizons], "horizon_days int, date date, vehicle_age double")
        ahead = ahead.withColumns(_date_features(F.col("date")))
        mean = counted.groupBy(*_DATE_FEATURES).agg(F.sum("_n").cast("double").alias("weight"), (F.sum("_price") / F.sum("_n")).alias("price"))
        price = Pipeline(stages=[gather, GBTRegressor(labelCol="price", weightCol="weight", maxIter=trees, maxDepth=depth, stepSize=0.1,
                                                      seed=42, predictionCol="predicted_price")]).fit(mean)
        # a row per horizon, written, so that no plan carries a model into the next
        out = known_size(price.transform(ahead).select("horizon_days", "date", "predicted_price"))
        for c in traits:
            per = counted.groupBy(*_DATE_FEATURES, c).agg(F.sum("_n").alias("_k"))
            sizes = per.groupBy(c).agg(F.sum("_k").alias("_class"))
            labelled = per.join(sizes, c).withColumn("weight", F.col("_k") / F.col("_class"))
            model = _classifier(gather, c, trees, depth).fit(labelled)
            out = out.join(known_size(_named(model, ahead, c).select("horizon_days", f"predicted_{c}")), "horizon_days")
    finally:
        counted.unpersist()
        every.unpersist()
    out = out.join(known_size(volume.withColumnRenamed("period", "date")), "date", "left")
    return out.select("horizon_days", "date", "expected_volume", F.floor("predicted_price").alias("predicted_price"),
                      *[f"predicted_{c}" for c in traits])


def _classifier(gather: VectorAssembler, column: str, trees: int, depth: int) -> Pipeline:
    index = StringIndexer(inputCol=column, outputCol="label", stringOrderType="alphabetAsc")
    forest = RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=42)
    return Pipeline(stages=[index, gather, forest])


def _named(model: PipelineModel, frame: DataFrame, column: str) -> DataFrame:
    """Predicted class by name; the label indexer only belongs to training.

    A fitted classifier keeps its training summary, and with it the session, which can't be sent to tasks once anything in it
    was observed. A copy has no summary.
    """
    index, gather, forest = model.stages
    scored = forest.copy().transform(gather.transform(frame))
    named = IndexToString(inputCol="prediction", outputCol=f"predicted_{column}", labels=index.labels).transform(scored)
    return named.drop("features", "prediction", "rawPrediction", "probability")

