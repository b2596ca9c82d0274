import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as hs
from pyspark.sql import functions as F

from forecourt.functions import bins, tails
from forecourt.functions.calendar import calendar_parts, days_between, haversine_km, local_time
from forecourt.functions.numbers import half_up
from forecourt.operators import drift, quality, sampling, series, statistics
from forecourt.operators.quantiles import QUARTILES, absolute_deviation, leading_bits, quantiles, value_counts


def column(spark, values, name="x"):
    return spark.createDataFrame([(None if v is None else float(v),) for v in values], f"{name} double")


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(hs.lists(hs.one_of(hs.floats(-1e9, 1e9), hs.sampled_from([0.0, 7.0, 987654321.0, -3.0])), min_size=1, max_size=40))
def test_quantiles_equal_numpy(spark, values):
    got = quantiles(column(spark, values), "x", QUARTILES).first()
    want = np.quantile(values, [0.25, 0.5, 0.75])
    assert [got.q1, got.median, got.q3] == pytest.approx(list(want), rel=1e-12, abs=1e-9)


def test_quantiles_of_a_hot_value_nulls_and_groups(spark):
    rows = [("a", 5.0)] * 50 + [("a", float(i)) for i in range(50)] + [("b", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: r.m for r in quantiles(df, "x", {"m": 0.5}, ["g"]).collect()}
    assert got == {"a": 5.0, None: 3.0}
    weighted = spark.createDataFrame([(1.0, 3), (10.0, 1)], "x double, w int")
    assert quantiles(weighted, "x", {"m": 0.5}, weight="w").first().m == 1.0


def test_mad_and_fences(spark):
    assert absolute_deviation(column(spark, [1, 2, 3, 4, 100.0]), "x").first().mad == 1.0
    r = statistics.iqr_outliers(column(spark, [float(i) for i in range(1, 10)]), "x").first()
    assert (r.q1, r.q3, r.lower_bound, r.upper_bound, r.low_outliers) == (3.0, 7.0, -3.0, 13.0, 0)


def test_rounding_and_guard(spark):
    df = column(spark, [0.125, 2.675, 0.285, None])
    assert [r.y for r in df.select(half_up("x").alias("y")).collect()] == [0.13, 2.68, 0.29, None]


def test_ks_statistic(spark):
    a, b = column(spark, [1, 2, 3, 4.0]), column(spark, [3, 4, 5, 6.0, None])
    r = drift.numeric_drift(a, b, ["x"]).first()
    assert (r.statistic, r.reference_rows, r.current_rows) == (0.5, 4, 4)


def cells(spark, table):
    rows = [("t", str(i), str(j), v) for i, line in enumerate(table) for j, v in enumerate(line) if v is not None]
    return spark.createDataFrame(rows, "g string, r string, c string, n long")


@pytest.mark.parametrize("table, want", [
    ([[10, 20], [20, 10]], 5.4), ([[10, None], [None, 10]], 16.2), ([[10, 0], [0, 10]], 16.2),
    ([[5, 10, 15], [10, 10, 10]], None), ([[5, 10, None], [10, 10, 10]], None)])
def test_chi_square(spark, table, want):
    got = drift.chi_square(cells(spark, table), ["g"], "r", "c", "n").first()
    full = np.array([[v or 0 for v in line] for line in table], float)
    expected = full.sum(1, keepdims=True) * full.sum(0) / full.sum()
    gap = abs(full - expected)
    if full.shape == (2, 2):
        gap -= np.minimum(gap, 0.5)
    assert got.statistic == pytest.approx((gap ** 2 / expected).sum())
    if want:
        assert got.statistic == pytest.approx(want)
    assert got.degrees_of_freedom == (full.shape[0] - 1) * (full.shape[1] - 1)


def test_tails():
    assert tails.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-10)
    assert tails.chi_square_tail(30.0, 40) == pytest.approx(0.8746, abs=1e-3)
    assert tails.chi_square_quantile(0.975, 5) == pytest.approx(12.832501994, abs=1e-6)
    assert tails.t_two_sided(2.2281388519649385, 10) == pytest.approx(0.05, abs=1e-9)
    assert tails.t_two_sided(0.0, 10) == pytest.approx(1.0)


def test_drift_report_has_verdicts(spark):
    a = spark.range(500).select(F.col("id").cast("double").alias("x"), F.when(F.col("id") % 2 == 0, "u").otherwise("v").alias("c"))
    b = a.withColumn("x", F.col("x") + 300)
    got = {r.column_name: r for r in drift.drift_report(a, b, ["x"], ["c"]).collect()}
    assert got["x"].has_drift and not got["c"].has_drift and got["c"].p_value == pytest.approx(1.0)


def test_entropy_and_modes(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    r = quality.category_metrics(df, ["c"]).first()
    assert r.entropy == pytest.approx(math.log(2), abs=1e-5) and r.mode == "a" and r.unique_count == 2
    assert {x.c for x in statistics.fill_modes(df, ["c"]).collect()} == {"a", "b"}


def test_conditional_mode_falls_back(spark):
    df = spark.createDataFrame([("k", "x"), ("k", "x"), ("z", "y"), ("k", None), ("q", None)], "g string, c string")
    got = statistics.fill_conditional_modes(df, "c", ["g"])
    assert sorted((r.g, r.c) for r in got.collect()) == [("k", "x")] * 3 + [("q", "x"), ("z", "y")]


def test_null_keys(spark):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0)], "manufacturer string, price double").withColumn("has_installments", F.lit(True))
    from forecourt.operators.aggregates import summarise
    for c in ("odometer", "year", "monthly_payment", "down_payment", "installments"):
        df = df.withColumn(c, F.lit(1.0))
    assert summarise(df, ["manufacturer"], ["avg_price"]).count() == 2
    assert summarise(df, ["manufacturer"], ["avg_price"], drop_null_keys=True).count() == 1


def test_gate(spark):
    df = spark.createDataFrame([(1.0,), (None,)], "price double")
    suite = [quality.Expectation("not_null", "price", 0.9), quality.Expectation("exists", "price")]
    assert quality.gate(df, suite, must_pass=False) == ["not_null(price)"]
    with pytest.raises(quality.QualityGateError):
        quality.gate(df, suite, must_pass=True)
    assert len(quality.raw_suite(2024)) == 16 and len(quality.clean_suite(2024)) == 11


def test_equal_width_edges(spark):
    df = column(spark, [float(i) for i in range(11)])
    got = {r.x: r.bin for r in bins.equal_width(df, "x", 5).collect()}
    assert [got[float(i)] for i in range(11)] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    assert sum(r.listings for r in bins.histogram(df, "x", 4).collect()) == 11


def test_calendar(spark):
    df = spark.sql("SELECT timestamp_ntz '2024-01-01 03:00:00' AS t, timestamp_ntz '2024-01-02 02:59:59' AS u")
    parts = calendar_parts(local_time(F.col("t")))
    r = df.select(*[c.alias(a) for a, c in parts.items()], days_between(F.col("u"), F.col("t")).alias("days")).first()
    assert (r.posting_year, r.posting_month, r.posting_day, r.posting_dayofweek, r.posting_week) == (2023, 12, 31, 6, 52)
    assert r.days == 0


def test_haversine(spark):
    z = [F.lit(float(v)) for v in (0, 0, 0, 1)]
    assert spark.range(1).select(haversine_km(*z).alias("d")).first().d == pytest.approx(111.195, abs=1e-3)


def test_rolling_events_need_a_full_window(spark):
    df = spark.createDataFrame([(i, 1.0 + (i % 2) if i < 39 else 50.0) for i in range(40)], "period int, v double")
    got = {r.period: r for r in series.rolling_events(df, "v").collect()}
    assert got[28].z_score is None and got[29].z_score is not None and got[39].is_event and not got[35].is_event


def test_decomposition_adds_up(spark):
    rows = [(i, 100 + 2 * i + 10 * math.sin(2 * math.pi * i / 12)) for i in range(60)]
    got = series.decompose(spark.createDataFrame(rows, "period int, y double"), "y").orderBy("period").collect()
    assert all(r.y == pytest.approx(r.trend + r.seasonal + r.residual) for r in got)
    assert got[0].trend == pytest.approx(100, abs=0.5) and max(abs(r.residual) for r in got) < 1
    ends = series.decompose(spark.createDataFrame(rows, "period int, y double"), "y", extrapolate=False)
    assert ends.where("trend is null").count() == 12


def test_forecast_metrics_skip_what_is_not_finite(spark):
    df = spark.createDataFrame([(10.0, 12.0), (20.0, 16.0), (float("nan"), 1.0), (5.0, float("inf")), (None, 1.0)], "y double, p double")
    r = series.forecast_metrics(df, "y", "p").first()
    assert (r.mae, r.mse, r.mape) == (3.0, 10.0, pytest.approx(20.0))
    assert series.forecast_metrics(df.limit(1), "y", "p").first().mae is None


def test_sampling(spark):
    df = spark.range(5000).select("id", F.when(F.col("id") < 4000, "hot").otherwise((F.col("id") % 10).cast("string")).alias("g"))
    picked = sampling.stratified_sample(df, ["g"], "id", 500)
    per = {r.g: r["count"] for r in picked.groupBy("g").count().collect()}
    assert per["hot"] == 400 and sum(per.values()) == 500
    assert picked.exceptAll(sampling.stratified_sample(df.repartition(7), ["g"], "id", 500)).count() == 0
    # a margin that leaves too few rows near a quota is noticed, and the sample is the same
    assert picked.exceptAll(sampling.stratified_sample(df, ["g"], "id", 500, margin=-5)).count() == 0
    train, test = sampling.split(df, "id")
    assert train.count() + test.count() == 5000 and 3800 < train.count() < 4200
    assert sampling.bounded_sample(df, "id", 50).distinct().count() == 50


@pytest.mark.parametrize("sizes, target", [([10, 10, 10, 3], 31), ([7, 5, 5, 1, 1, 1], 19), ([4, 4], 8), ([100, 1, 1, 1, 1, 1], 7)])
def test_quotas_equal_the_loop(spark, sizes, target):
    total = sum(sizes)
    want = [round(x / total * target) for x in sizes]
    while sum(want) > target:
        want[want.index(max(want))] -= 1
    df = spark.createDataFrame([(f"{i:02d}", v) for i, v in enumerate(sizes)], "s string, _n long")
    assert [r.quota for r in sampling.quotas(df, target).orderBy("s").collect()] == want


def test_bootstrap_interval_holds_the_median(spark):
    df = spark.range(1, 1002).select((F.col("id") * 1.0).alias("x"))
    r = statistics.bootstrap_median(df, "x", 400).first()
    assert 440 < r.ci_low < 501 < r.ci_high < 562 and r.resamples == 400
    # against plain resampling
    rng = np.random.default_rng(0)
    plain = [np.median(rng.choice(np.arange(1, 1002), 1001)) for _ in range(400)]
    assert r.ci_low == pytest.approx(np.percentile(plain, 2.5), abs=12)


def test_mahalanobis(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(a + b)) for a, b in rng.normal(size=(300, 2))] + [(8.0, -8.0), (None, 0.0)]
    got = statistics.mahalanobis_outliers(spark.createDataFrame(rows, "a double, b double"), ["a", "b"])
    worst = got.orderBy(F.desc("distance")).first()
    assert (worst.a, worst.b, worst.is_outlier) == (8.0, -8.0, True) and got.count() == 302


def test_imputation_report(spark):
    df = column(spark, [1.0, 2.0, 3.0, None])
    after = df.withColumn("x", F.coalesce("x", F.lit(2.0)))
    r = statistics.imputation_report(df, after, ["x"]).first()
    assert (r.missing_before, r.missing_after, r.mean_before, r.mean_after) == (1, 0, 2.0, 2.0)
    assert r.ks_statistic == pytest.approx(1 / 3 - 1 / 4, abs=1e-5)


def test_tails_at_high_freedom_and_against_tables():
    from forecourt.functions.tails import chi_square_tail, t_two_sided

    # Printed tables of the t and chi-square distributions.
    assert abs(t_two_sided(2.0003, 60) - 0.05) < 1e-4 and abs(t_two_sided(12.706, 1) - 0.05) < 1e-5
    assert abs(chi_square_tail(124.342, 100) - 0.05) < 1e-5
    assert abs(chi_square_tail(1e7, 1e7) - 0.5) < 1e-3 and abs(chi_square_tail(30_000, 30_000) - 0.5) < 2e-3
    assert abs(chi_square_tail(20_403.4, 20_002) - chi_square_tail(20_401.4, 20_000)) < 1e-3


def test_leading_bits_grow_with_the_value(spark):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.random(500), -rng.random(500), 10.0 ** rng.uniform(-300, 300, 500), 1e6 + rng.random(500), [0.0, 1.0, 2.0, 8.0, -8.0, 5e-324, 1.7e308],
                             2.0 ** np.arange(-40, 60), np.nextafter(2.0 ** np.arange(-40, 60), 0)])
    bucket, part = leading_bits(F.col("v"))
    rows = spark.createDataFrame([(float(v),) for v in values], "v double").select("v", bucket.alias("b"), part.alias("p")).collect()
    rows = sorted(rows)
    assert [(r.b, r.p) for r in rows] == sorted((r.b, r.p) for r in rows) and all(0 <= r.p < 1 << 14 for r in rows)


def test_no_opened_part_is_large(spark):
    """Values on [0, 1] as well as values crowded far from 0."""
    for of in (F.col("u"), 1e6 + F.col("u"), F.when(F.col("id") % 2 == 0, F.col("u")).otherwise(1e4 + F.col("u"))):
        rows = spark.range(40_000).select("id", ((F.xxhash64("id") % 1_000_003) / 1_000_003.0).alias("u")).select(of.alias("v"))
        counts = value_counts(rows, "v", [])
        n = counts.count()
        assert counts.groupBy("_bucket", "_part").count().agg(F.max("count")).first()[0] < n / 20
        got = quantiles(rows, "v", {"q": 0.3, "m": 0.5}).first()
        want = rows.agg(F.percentile("v", F.lit(0.3)).alias("q"), F.percentile("v", F.lit(0.5)).alias("m")).first()
        assert got.q == pytest.approx(want.q, rel=1e-12) and got.m == pytest.approx(want.m, rel=1e-12)
    uniform = spark.range(200_000).select(F.rand(3).alias("v"))
    assert value_counts(uniform, "v", []).groupBy("_bucket").count().agg(F.max("count")).first()[0] < 200
