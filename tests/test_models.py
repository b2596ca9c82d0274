import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecourt.operators import anomalies, density, forecasting, nearest, neighbours, pricing, segments, shap
from forecourt.operators.sampling import lot


@pytest.fixture(scope="module")
def market(spark):
    """2000 listings whose price falls with age and mileage, in three makes."""
    rng = np.random.default_rng(3)
    make = rng.integers(0, 3, 2000)
    year = rng.integers(2000, 2020, 2000)
    km = rng.uniform(0, 200_000, 2000)
    price = 5000 * (make + 1) + 600 * (year - 2000) - 0.02 * km + 8000 + rng.normal(0, 300, 2000)
    rows = [(f"l{i:04d}", f"make{m}", "good", "gas", "manual", int(y), float(k), float(p), dt.date(2020, 1, 1) + dt.timedelta(days=int(i % 400)))
            for i, (m, y, k, p) in enumerate(zip(make, year, km, price))]
    df = spark.createDataFrame(rows, "listing_id string, manufacturer string, condition string, fuel string, transmission string, "
                                     "year int, odometer double, price double, posting_date date")
    return df.withColumn("odometer", F.when(F.rand(1) > 0.02, F.col("odometer"))).persist()


INPUTS = pricing.Inputs()


def test_price_model_learns_and_reloads(market, tmp_path):
    small = pricing.boosted(INPUTS, trees=20, depth=4)
    model, stored = pricing.load_or_train(str(tmp_path / "m"), market, INPUTS, regressor=small)
    again, found = pricing.load_or_train(str(tmp_path / "m"), market, INPUTS)
    assert (stored, found) == (False, True)
    got = pricing.predict(model, market, INPUTS)
    assert pricing.regression_metrics(got).first().r2 > 0.9
    assert got.exceptAll(pricing.predict(again, market, INPUTS)).count() == 0
    unseen = market.limit(1).withColumn("manufacturer", F.lit("never seen")).withColumn("odometer", F.lit(None).cast("double"))
    assert pricing.predict(model, unseen, INPUTS).first().prediction > 0


def test_importances(market):
    model = pricing.train(market, INPUTS, pricing.boosted(INPUTS, trees=10, depth=4))
    gain = {r.feature: r.importance for r in pricing.importances(model, INPUTS).collect()}
    moved = {r.feature: r.importance for r in pricing.permutation_importance(model, market, INPUTS).collect()}
    assert gain["manufacturer"] > gain["fuel"] and moved["manufacturer"] > moved["fuel"] == 0
    assert sum(gain.values()) == pytest.approx(1)


def test_shap_values_sum_to_the_prediction(market):
    model = pricing.train(market, INPUTS, pricing.boosted(INPUTS, trees=8, depth=5))
    rows = shap.shap_values(model, market, INPUTS).select("prediction", "base", F.aggregate("shap", F.lit(0.0), lambda a, v: a + v).alias("all")).collect()
    assert len(rows) == 2000
    assert [r.base + r["all"] for r in rows] == pytest.approx([r.prediction for r in rows], rel=1e-9)
    mean = {r.feature: r.importance for r in shap.mean_shap(model, market, INPUTS).collect()}
    assert set(mean) == {*INPUTS.categorical, *INPUTS.numeric} and mean["manufacturer"] > mean["fuel"] == 0


def test_shap_values_equal_enumeration_of_subsets(spark):
    from itertools import combinations
    from math import factorial

    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor, RandomForestRegressor

    rng = np.random.default_rng(12)
    x = np.round(rng.random((400, 3)), 1)
    df = spark.createDataFrame([(*map(float, r), float(r[0] * 3 + r[1] * r[2] + (r[0] > 0.5) * r[2])) for r in x], "a double, b double, c double, price double")
    for trees in (GBTRegressor(labelCol="price", maxIter=4, maxDepth=4, seed=1), RandomForestRegressor(labelCol="price", numTrees=3, maxDepth=4, seed=1)):
        model = Pipeline(stages=[VectorAssembler(inputCols=["a", "b", "c"], outputCol="features"), trees]).fit(df)
        found = shap.leaves(model, spark)

        def expected(row, known):
            """Mean of the model if only the inputs in ``known`` are those of the row."""
            return sum(leaf.value * np.prod([float(lo < row[f] <= hi) if f in known else part for f, lo, hi, part in zip(leaf.features, leaf.low, leaf.high, leaf.kept)])
                       for leaf in found)

        got = shap.contributions(found, x[:25])
        for row, shares in zip(x[:25], got):
            for f in range(3):
                rest = [g for g in range(3) if g != f]
                want = sum(factorial(k) * factorial(2 - k) / 6 * (expected(row, {*s, f}) - expected(row, set(s))) for k in range(3) for s in combinations(rest, k))
                assert shares[f] == pytest.approx(want, abs=1e-9)


def test_permuted_values_come_from_the_whole_column(market):
    class Rare:
        def transform(self, df):
            return df.withColumn("prediction", (F.col("manufacturer") == "rare").cast("double"))

    one = F.when(F.col("listing_id") == "l0777", "rare").otherwise(F.col("manufacturer"))
    moved = {r.feature: r.importance for r in pricing.permutation_importance(Rare(), market.withColumn("manufacturer", one), INPUTS).collect()}
    assert moved.pop("manufacturer") == pytest.approx(2 / 2000) and set(moved.values()) == {0.0}


def test_time_folds_never_look_ahead(market):
    folds = pricing.time_folds(market, "posting_date", 5)
    assert len(folds) == 5
    for past, future in folds:
        assert past.agg(F.max("posting_date")).first()[0] < future.agg(F.min("posting_date")).first()[0]
    assert pricing.time_validation(market, "posting_date", INPUTS, pricing.boosted(INPUTS, 3, 3), folds=2).count() == 2


def test_model_comparison_and_grid(market):
    learn, check = market.where("listing_id < 'l1500'"), market.where("listing_id >= 'l1500'")
    got = {r.model: r.r2 for r in pricing.compare_models(learn, check, INPUTS, trees=5, depth=4).collect()}
    assert set(got) == {"RandomForest", "GradientBoosting", "Lasso", "Ridge"} and got["Ridge"] > 0.9
    grid = pricing.grid_search(market, INPUTS, trees=(2,), depths=(2, 4), steps=(0.1,), shares=(1.0,), folds=2)
    assert grid.where("is_best").count() == 1 and grid.orderBy(F.desc("r2")).first().is_best


def test_staged_scores_equal_separate_fits(market):
    """A model's first trees are those of a shorter one, so the grid fits only the longest."""
    from pyspark.ml import Pipeline
    from pyspark.ml.evaluation import RegressionEvaluator
    from pyspark.ml.regression import GBTRegressor

    stages = Pipeline(stages=pricing.encoder(INPUTS)).fit(pricing.usable(market, INPUTS))
    rows = stages.transform(pricing.usable(market, INPUTS)).select("features", "price").persist()
    for share in (0.8, 1.0):
        fit = lambda n: GBTRegressor(labelCol="price", seed=42, maxIter=n, maxDepth=3, stepSize=0.1, subsamplingRate=share).fit(rows)
        judge = RegressionEvaluator(labelCol="price", metricName="r2")
        assert pricing.staged_r2(fit(9), rows, "price", (3, 6, 9)) == pytest.approx([judge.evaluate(fit(n).transform(rows)) for n in (3, 6, 9)], abs=1e-9)
    grid = pricing.grid_search(market, INPUTS, trees=(2, 4), depths=(2, 3), steps=(0.1, 0.3), shares=(0.9,), folds=2)
    assert grid.count() == 8 and grid.select("trees", "depth", "step").distinct().count() == 8 and grid.where("is_best").count() == 1


def test_uncertainty_and_residuals(market):
    rows = pricing.prediction_spread(market, "listing_id", INPUTS, pricing.boosted(INPUTS, 3, 3), refits=3)
    assert rows.where("uncertainty > 0").count() > 1000
    r = pricing.residual_figures(rows).first()
    assert 0 <= r.white_p <= 1 and r.listings == 2000


def test_poisson_weights(spark):
    mean = spark.range(20000).select(pricing.poisson_one(lot(5, "id")).alias("w")).agg(F.avg("w").alias("m"), F.var_pop("w").alias("v")).first()
    assert mean.m == pytest.approx(1, abs=0.03) and mean.v == pytest.approx(1, abs=0.06)


def test_fair_price_finds_the_bargain(market, spark):
    bargain = market.limit(1).withColumn("listing_id", F.lit("bargain")).withColumns({
        "price": F.lit(1000.0), "year": F.lit(2019), "odometer": F.lit(10.0), "manufacturer": F.lit("make2")})
    fair = pricing.fair_prices(market.unionByName(bargain), INPUTS)
    best = pricing.opportunities(fair, 0.2, max_outlay=5000, min_year=2010, max_km=1000)
    assert best.first().listing_id == "bargain"
    odd = anomalies.price_anomalies(market.unionByName(bargain), INPUTS, "listing_id")
    assert odd.where("listing_id = 'bargain'").first().by_residual


def test_isolation_forest_finds_planted_rows(spark, market):
    odd = spark.createDataFrame([(f"odd{i}", 1e6 + i, 1950, 9e5) for i in range(5)], "listing_id string, price double, year int, odometer double")
    rows = market.select("listing_id", "price", "year", "odometer").unionByName(odd)
    got = anomalies.isolation_anomalies(rows, ["price", "year", "odometer"], "listing_id", contamination=0.02, trees=30)
    assert got.where("is_anomaly and listing_id like 'odd%'").count() == 5
    assert got.where("is_anomaly").count() <= 0.021 * 2005
    same = anomalies.isolation_scores(rows.repartition(5), ["price", "year", "odometer"], "listing_id", trees=30)
    assert got.join(same.select("listing_id", F.col("anomaly_score").alias("s")), "listing_id").where("abs(anomaly_score - s) > 1e-9").count() == 0


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(5)
    points = rng.random((600, 2))
    points[:2] = [[0, 0], [1, 1]]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id int, a double, b double")
    got = {r.id: [(e.other, e.distance) for e in r.near] for r in neighbours.neighbours(df, "id", ["a", "b"], 5, shifts=4).collect()}
    far = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    np.fill_diagonal(far, np.inf)
    hits = 0
    for i, near in got.items():
        assert len(near) == 5 and i not in [j for j, _ in near]
        assert all(d == pytest.approx(far[i, j]) for j, d in near) and [d for _, d in near] == sorted(d for _, d in near)
        hits += len({j for j, _ in near} & set(np.argsort(far[i])[:5]))
    assert hits / (5 * 600) > 0.9


def test_neighbours_are_the_same_on_any_partitions(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 64)
    df = spark.range(1000).select("id", (F.xxhash64("id") % 1000 / 1000.0).alias("a"), (F.xxhash64("id", F.lit(1)) % 7 / 7.0).alias("b"))
    lists, was = [], spark.conf.get("spark.sql.shuffle.partitions")
    for n in (1, 4, 64):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        near = neighbours.neighbours(df.repartition(n), "id", ["a", "b"], 5).collect()
        lists.append({r.id: [(e.other, e.distance) for e in r.near] for r in near})
    spark.conf.set("spark.sql.shuffle.partitions", was)
    assert lists[0] == lists[1] == lists[2] and len(lists[0]) == 1000 and all(len(x) == 5 for x in lists[0].values())


@pytest.mark.parametrize("cell_rows", [20_000, 60])
def test_nearest_lists_equal_brute_force(spark, cell_rows):
    rng = np.random.default_rng(8)
    points = np.round(np.vstack([rng.random((500, 3)), rng.normal(0.2, 0.01, (200, 3)), np.full((300, 3), 0.5), [[9.0, 9.0, 9.0]]]), 2)
    wanted, donor = rng.random(len(points)) < 0.7, rng.random(len(points)) < 0.5
    rows = [(f"r{i:04d}", *map(float, p), float(i), bool(w), bool(d)) for i, (p, w, d) in enumerate(zip(points, wanted, donor))]
    df = spark.createDataFrame(rows + [("none", None, 0.0, 0.0, 1.0, True, True)], "id string, a double, b double, c double, v double, w boolean, d boolean")
    scaled = {c: F.col(c) for c in "abc"}
    got = nearest.nearest(df, "id", scaled, 6, value="v", wanted=F.col("w"), donor=F.col("d"), cell_rows=cell_rows).collect()
    far = np.zeros((len(points), len(points)))
    for j in range(3):
        far += (points[:, j, None] - points[None, :, j]) ** 2
    far = np.sqrt(far)
    far[:, ~donor] = np.inf
    np.fill_diagonal(far, np.inf)
    assert sorted(r.id for r in got) == [f"r{i:04d}" for i in np.flatnonzero(wanted)]
    for r in got:
        i = int(r.id[1:])
        assert [(e.distance, e.other, e.value) for e in r.near] == [(far[i, j], f"r{j:04d}", float(j)) for j in np.argsort(far[i], kind="stable")[:6]]


def test_nearest_with_few_donors(spark):
    df = spark.createDataFrame([(i, float(i), i < 3) for i in range(200)], "id int, a double, d boolean")
    got = {r.id: [e.other for e in r.near] for r in nearest.nearest(df, "id", {"a": F.col("a")}, 5, donor=F.col("d"), cell_rows=10).collect()}
    assert got[0] == [1, 2] and got[199] == [2, 1, 0] and len(got) == 200
    none = nearest.nearest(df, "id", {"a": F.col("a")}, 5, donor=F.lit(False)).collect()
    assert len(none) == 200 and all(r.near == [] for r in none)


def test_cells_reached_hold_every_point_within_the_radius():
    rng = np.random.default_rng(9)
    points = rng.random((2000, 2))
    tree = nearest.Tree.grown(points[:300], 32)
    cells, asked, radius = tree.cells_of(points), rng.random((50, 2)), rng.random(50) * 0.2
    at, cell = tree.reached(asked, radius)
    found = set(zip(at.tolist(), cell.tolist()))
    for i in range(50):
        inside = np.sqrt(((points - asked[i]) ** 2).sum(axis=1)) <= radius[i]
        assert {(i, c) for c in cells[inside].tolist()} <= found
    assert len(found) < 50 * len(set(cells.tolist())) and len(set(cells.tolist())) == 32


def test_outlier_factors_equal_brute_force(spark, sf_dir):
    """Recall is 1: the lists behind the factors are those of all pairs."""
    from forecourt.sources import Market

    features = ["price", "year", "odometer"]
    df = Market(spark, sf_dir).listings("listing_id", *features).dropna().where("crc32(listing_id) % 4 = 0")
    rows = df.orderBy("listing_id").collect()
    x = np.array([[float(r[c]) for c in features] for r in rows])
    x = (x - x.min(axis=0)) / np.ptp(x, axis=0)
    far = np.zeros((len(x), len(x)))
    for j in range(3):
        far += (x[:, j, None] - x[None, :, j]) ** 2
    far = np.sqrt(far)
    np.fill_diagonal(far, np.inf)
    near = np.argsort(far, axis=1, kind="stable")[:, :20]
    kth = np.take_along_axis(far, near, axis=1)[:, -1]
    density = 1 / (np.maximum(np.take_along_axis(far, near, axis=1), kth[near]).mean(axis=1) + 1e-10)
    want = density[near].mean(axis=1) / density
    got = {r.listing_id: r.lof for r in neighbours.local_outlier_factor(df, "listing_id", features).collect()}
    assert [got[r.listing_id] for r in rows] == pytest.approx(want.tolist(), rel=1e-9)


def test_neighbour_fill(spark):
    rows = [(i, float(i % 10), float(i % 10), 10.0 * (i % 10)) for i in range(200)] + [(900, 3.0, 3.0, None), (901, None, 3.0, None)]
    df = spark.createDataFrame(rows, "id int, a double, b double, t double")
    got = {r.id: r.t for r in neighbours.fill_from_neighbours(df, "id", "t", ["a", "b"], k=3).where("id >= 900").collect()}
    assert got == {900: 30.0, 901: None}


def test_local_outlier_factor(spark):
    rng = np.random.default_rng(6)
    points = np.vstack([rng.normal(0, 0.1, (300, 2)), [[5.0, 5.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id int, a double, b double")
    got = neighbours.local_outlier_factor(df, "id", ["a", "b"], k=10).orderBy(F.desc("lof")).first()
    assert got.id == 300 and got.lof > 3
    flagged = neighbours.local_outliers(df, "id", ["a", "b"], k=10, contamination=0.01).where("is_outlier")
    assert flagged.count() == 3 and flagged.where("id = 300").count() == 1


def test_similar_listings(spark):
    df = spark.createDataFrame([("a", 0.0, 1.0), ("b", 0.1, 10.0), ("c", 5.0, 0.5), ("d", 10.0, 0.0), ("e", None, 1.0)], "id string, x double, y double")
    got = neighbours.similar_listings(df, "id", ["x", "y"], ["b"], n=2).orderBy("place").collect()
    assert [r.id for r in got] == ["a", "c"] and got[0].similarity > 0.99


def test_similar_to_all_equals_brute_force(spark):
    rng = np.random.default_rng(13)
    x = np.round(rng.random((300, 4)), 2)
    x[:2] = [[0] * 4, [1] * 4]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)] + [(999, None, 0.0, 0.0, 0.0)], "id int, a double, b double, c double, d double")
    got = {}
    for r in neighbours.similar_to_all(df, "id", list("abcd"), 4).orderBy("id", "place").collect():
        got.setdefault(r.id, []).append((r.other, r.similarity))
    norm = np.sqrt((x * x).sum(axis=1))
    cos = (x @ x.T) / np.where(norm > 0, norm, np.inf)[:, None] / np.where(norm > 0, norm, np.inf)[None, :]
    np.fill_diagonal(cos, -1)
    cos[:, norm == 0] = -1
    assert set(got) == set(np.flatnonzero(norm > 0).tolist())
    for i, near in got.items():
        assert [s for _, s in near] == pytest.approx(sorted(cos[i], reverse=True)[:4], abs=2e-8)  # rounding has a guard of 1e-8
        assert all(s == pytest.approx(cos[i, j], abs=2e-8) for j, s in near)


def test_density_clusters(spark):
    rng = np.random.default_rng(7)
    points = np.vstack([rng.normal(0, 0.3, (200, 2)), rng.normal(10, 0.3, (150, 2)), [[5.0, 5.0]], [[0.0, 10.0]]])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(points)], "id int, a double, b double")
    got = {r.id: r.cluster for r in density.density_clusters(df, ["a", "b"], eps=0.1).collect()}
    assert len({got[i] for i in range(200)}) == 1 and len({got[i] for i in range(200, 350)}) == 1
    assert got[0] != got[200] and got[350] == got[351] == -1 and {got[0], got[200]} == {0, 1}


@pytest.mark.parametrize("features, eps, min_points, joined, group", [(2, 0.02, 6, 4096, 20_000), (3, 0.06, 5, 0, 10), (1, 0.002, 4, 4096, 20_000), (2, 0.05, 1, 0, 7)])
def test_density_clusters_equal_brute_force(spark, monkeypatch, features, eps, min_points, joined, group):
    monkeypatch.setattr(density, "_JOINED", joined)
    rng = np.random.default_rng(features)
    x = np.vstack([rng.random((700, features)), rng.normal(0.4, 0.03, (900, features)), rng.normal(0.7, 0.01, (250, features)),
                   np.full((150, features), 0.9), np.zeros((1, features)), np.ones((1, features))]).clip(0, 1)
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id int, " + ", ".join(f"f{j} double" for j in range(features)))
    got = {r.id: r.cluster for r in density.density_clusters(df, [f"f{j}" for j in range(features)], eps, min_points, group).collect()}
    far = np.sqrt(sum((x[:, j, None] - x[None, :, j]) ** 2 for j in range(features)))
    close = far <= eps
    core = close.sum(axis=1) >= min_points
    label = np.full(len(x), -1)
    clusters = []
    for i in np.flatnonzero(core):
        if label[i] < 0:
            open_, label[i] = [i], len(clusters)
            while open_:
                for j in np.flatnonzero(close[open_.pop()] & core & (label < 0)):
                    label[j] = label[i]
                    open_.append(j)
            clusters.append(label == label[i])
    assert len(got) == len(x)
    mine = np.array([got[i] for i in range(len(x))])
    numbers = [set(mine[c].tolist()) for c in clusters]
    assert all(len(n) == 1 for n in numbers) and sorted(n.pop() for n in numbers) == list(range(len(clusters)))
    sizes = [int((core & (mine == k)).sum()) for k in range(len(clusters))]
    assert sizes == sorted(sizes, reverse=True)
    for i in np.flatnonzero(~core):
        reached = mine[close[i] & core]
        assert mine[i] == (reached.min() if len(reached) else -1)


def test_segments(market):
    found = segments.segment(market, 3)
    figures = segments.segment_figures(found)
    assert figures.agg(F.sum("size")).first()[0] == market.dropna(subset=["odometer"]).count()
    assert figures.where("segment is null or top_manufacturer is null").count() == 0
    shares = segments.cluster_by_make(found).groupBy("cluster").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == pytest.approx(1, abs=1e-4) for r in shares)
    line = segments.elbow(market, range(1, 4)).orderBy("k").collect()
    assert line[0].cost > line[1].cost > line[2].cost and line[0].silhouette is None


def test_forecasts(spark, market):
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=i), 100.0 + 0.5 * i + (20 if i % 7 == 5 else 0)) for i in range(400)]
    daily = spark.createDataFrame(rows, "period date, y double")
    got = forecasting.seasonal_forecast(daily, "y", 14)
    future = got.where("is_future").orderBy("period").collect()
    assert len(future) == 14 and future[0].period == dt.date(2021, 2, 4)
    for i, r in enumerate(future):
        assert r.yhat == pytest.approx(100 + 0.5 * (400 + i) + (20 if (400 + i) % 7 == 5 else 0), rel=0.1)
        assert r.yhat_lower < r.yhat < r.yhat_upper
    assert forecasting.price_trend(got).first().trend_direction == "up"
    volume = forecasting.volume_forecast(daily.withColumn("y", F.lit(0)), "y", 5)
    assert {r.expected_volume for r in volume.collect()} == {1}


def trend_terms(t, cuts):
    return np.column_stack([np.ones_like(t), t, np.maximum(t[:, None] - cuts, 0)])


def test_trend_finds_planted_breaks(spark):
    rng = np.random.default_rng(21)
    day = np.arange(600)
    y = 200 + 0.5 * day - 1.2 * np.maximum(day - 192, 0) + 1.0 * np.maximum(day - 384, 0) + rng.normal(0, 2, 600)
    rows = [(dt.date(2020, 1, 1) + dt.timedelta(days=int(d)), float(v)) for d, v in zip(day, y)]
    got = forecasting.seasonal_forecast(spark.createDataFrame(rows, "period date, y double"), "y", 30, yearly=0).orderBy("period").collect()
    future = [r for r in got if r.is_future]
    assert len(got) == 630 and len(future) == 30
    truth = 200 + 0.5 * 629 - 1.2 * (629 - 192) + 1.0 * (629 - 384)
    assert future[-1].yhat == pytest.approx(truth, abs=8) and future[-1].yhat_lower < truth < future[-1].yhat_upper
    assert future[-1].yhat_upper - future[-1].yhat_lower > future[0].yhat_upper - future[0].yhat_lower
    inside = sum(r.yhat_lower <= v <= r.yhat_upper for r, v in zip(got, y))
    assert 0.9 * 600 <= inside <= 600
    # a break shows as slope changes next to it, and few elsewhere
    cuts = 0.8 * np.arange(1, 26) / 25
    t = day / 599
    x = np.column_stack([trend_terms(t, cuts), y / y.max()])
    fit = forecasting.fitted_trend(x.T @ x, 600, np.array([5.0, 5.0] + [0.05] * 25), slice(2, 27))
    strong = {int(round(cuts[k] * 599)) for k in np.argsort(-np.abs(fit.changes))[:4]}
    assert any(abs(s - 192) < 40 for s in strong) and any(abs(s - 384) < 40 for s in strong)
    assert (np.abs(fit.changes) < 0.02 * np.abs(fit.changes).max()).sum() >= 12


def test_band_covers_what_comes():
    """Series whose slope keeps changing: the band of 95 % holds the later days about as often as it says."""
    rng = np.random.default_rng(22)
    cuts, t, ahead = 0.8 * np.arange(1, 26) / 25, np.arange(400) / 399, (400 + np.arange(30)) / 399
    inside = []
    for _ in range(80):
        when = np.concatenate([rng.uniform(0, 0.8, 25), rng.uniform(1, ahead[-1], rng.poisson(25 * (ahead[-1] - 1)))])
        change = rng.laplace(0, 0.2, len(when))
        path = lambda at: 1 + 0.3 * at + (change * np.maximum(at[:, None] - when, 0)).sum(axis=1)
        y = path(t) + rng.normal(0, 0.02, 400)
        x = np.column_stack([trend_terms(t, cuts), y / np.abs(y).max()])
        fit = forecasting.fitted_trend(x.T @ x, 400, np.array([5.0, 5.0] + [0.05] * 25), slice(2, 27))
        low, high = fit.band(ahead, trend_terms(ahead, cuts))
        yhat = trend_terms(ahead, cuts) @ fit.weights
        later = (path(ahead) + rng.normal(0, 0.02, 30)) / np.abs(y).max()
        inside.append(((yhat + low <= later) & (later <= yhat + high)).mean())
    assert 0.92 <= np.mean(inside) <= 0.985


def test_demand_equals_a_fit_per_series(market):
    got = {}
    for r in forecasting.demand_forecasts(market, ["manufacturer", "year"], "posting_date", days=7).collect():
        got.setdefault((r.manufacturer, r.year), []).append((r.period, r.yhat))
    counts = {}
    for r in market.select("manufacturer", "year", "posting_date").collect():
        days = counts.setdefault((r.manufacturer, r.year), {})
        days[r.posting_date] = days.get(r.posting_date, 0) + 1

    def design(day, first, span):
        cols = [np.ones_like(day), (day - first) / span]
        for length, order in ((365.25, 3), (7.0, 3)):
            for i in range(1, order + 1):
                cols += [np.sin(2 * np.pi * i * day / length), np.cos(2 * np.pi * i * day / length)]
        return np.column_stack(cols)

    assert set(got) == {k for k, days in counts.items() if len(days) > 1}
    for key, rows in got.items():
        day = np.array([(d - dt.date(1970, 1, 1)).days for d in counts[key]], float)
        a = design(day, day.min(), max(np.ptp(day), 1.0))
        weights = np.linalg.solve(a.T @ a + np.eye(14), a.T @ np.array(list(counts[key].values()), float))
        future = day.max() + np.arange(1, 8)
        want = np.maximum(design(future, day.min(), max(np.ptp(day), 1.0)) @ weights, 0)
        rows = sorted(rows)
        assert [r[1] for r in rows] == pytest.approx(want.tolist(), abs=1e-9)
        assert [(r[0] - dt.date(1970, 1, 1)).days for r in rows] == future.tolist()


def test_demand_forecasts(market, spark):
    one = spark.createDataFrame([("solo", dt.date(2020, 1, 1))], "manufacturer string, posting_date date")
    got = forecasting.demand_forecasts(market.select("manufacturer", "posting_date").unionByName(one), ["manufacturer"], "posting_date", days=10)
    assert got.groupBy("manufacturer").count().count() == 3 and got.count() == 30 and got.where("yhat < 0").count() == 0


def test_listing_forecast(market):
    rows = market.withColumns({"model": F.col("manufacturer"), "type": F.lit("sedan"), "region": F.lit("r")})
    got = forecasting.listing_forecast(rows, dt.date(2021, 3, 1), trees=2, depth=3).orderBy("horizon_days").collect()
    assert [r.horizon_days for r in got] == [1, 7, 15, 30, 60]
    assert all(r.predicted_type == "sedan" and r.expected_volume >= 1 and r.predicted_price > 0 for r in got)


def test_listing_forecast_after_an_observation(spark, market):
    """A session in which something was observed can't be serialised; no model may carry it along."""
    from pyspark.sql import Observation

    seen = Observation("rows")
    spark.range(3).observe(seen, F.count("*").alias("n")).write.format("noop").mode("overwrite").save()
    assert seen.get == {"n": 3}
    rows = market.withColumns({"model": F.col("manufacturer"), "type": F.lit("sedan"), "region": F.lit("r")})
    assert forecasting.listing_forecast(rows, dt.date(2021, 3, 1), trees=2, depth=2, traits=("manufacturer", "type")).count() == 5


def test_model_queries_run_at_full_size(monkeypatch):
    """Registered queries hand no sizes of their own to the operators."""
    from forecourt.plans import ENTRIES, modelling

    class Rows:
        def __getattr__(self, name):
            return lambda *a, **b: self

        def __getitem__(self, name):
            return self

    asked = []
    sizes = {"trees", "depth", "depths", "steps", "shares", "folds", "refits", "regressor"}

    def noting(module, name):
        def note(*args, **options):
            asked.append((name, [a for a in args if not isinstance(a, (Rows, str, pricing.Inputs, dt.date))], options))
            return Rows()
        monkeypatch.setattr(module, name, note)

    for name in ("train", "compare_models", "grid_search", "time_validation", "prediction_spread", "permutation_importance", "predict",
                 "regression_metrics", "importances", "residual_figures"):
        noting(modelling.pr, name)
    noting(modelling.fc, "listing_forecast")
    monkeypatch.setattr(modelling, "Market", lambda *a: Rows(), raising=False)
    monkeypatch.setattr("forecourt.plans.registry.Market", lambda *a: Rows())
    monkeypatch.setattr(modelling, "split", lambda *a: (Rows(), Rows()))
    monkeypatch.setattr(modelling, "half_up", lambda *a: Rows())
    monkeypatch.setattr(modelling, "F", Rows())
    forests = []
    monkeypatch.setattr(modelling, "RandomForestRegressor", lambda **options: forests.append(options) or Rows())
    for name in ("price_model_metrics", "price_model_importances", "permutation_importances", "residual_report", "batch_pricing",
                 "forest_with_dummies", "model_comparison", "parameter_grid", "time_validation", "prediction_spread", "listing_forecast"):
        ENTRIES[name].run(None, "")
    assert all(not args and not sizes & set(options) for _, args, options in asked), asked
    assert len(asked) >= 11 and [(f["numTrees"], f["maxDepth"]) for f in forests] == [(100, 6)]


def test_demand_runs_by_state_and_model(spark, sf_dir):
    from forecourt.plans import ENTRIES

    assert ENTRIES["demand_forecasts"].run(spark, sf_dir).columns == ["state", "model", "period", "yhat"]


def _by_hand(model, block, trees, width, bins=32):
    """One boosted model grown node by node on all rows at once."""
    from forecourt.operators import boosting as bo

    y, x = block.target, block.bins
    base = bo.row_weights(bo.replace(model, row_share=1.0), block, 0).astype(float)
    out = np.full(len(y), (base @ y) / base.sum())
    for t in range(trees):
        w, columns = bo.row_weights(model, block, t).astype(float), np.flatnonzero(bo.drawn_columns(model, t, width))
        gap, value = y - out, np.zeros(len(y))

        def split(rows, depth):
            g, h = (w * gap)[rows].sum(), w[rows].sum()
            best = (0, None)
            for c in columns if depth < model.depth else []:
                for cut in range(bins):
                    left = rows & (x[:, c] <= cut)
                    right = rows & ~left
                    if min(w[left].sum(), w[right].sum()) < model.min_weight:
                        continue
                    score = lambda r: (w * gap)[r].sum() ** 2 / (w[r].sum() + model.l2)
                    gain = score(left) + score(right) - g * g / (h + model.l2)
                    if gain > best[0] * (1 + 1e-9) + 1e-6:
                        best = (gain, (left, right))
            if best[1] is None:
                value[rows] = g / (h + model.l2)
            else:
                for side in best[1]:
                    split(side, depth + 1)

        split(np.ones(len(y), bool), 0)
        out += model.step * value
    return out


@pytest.mark.parametrize("merged", [48 << 20, 1000])
def test_models_grown_together_equal_each_by_hand(spark, monkeypatch, merged):
    """Sums merged at once, or by model in tasks of their own: the same trees."""
    from pyspark.ml.functions import array_to_vector

    from forecourt.operators import boosting as bo

    monkeypatch.setattr(bo, "MERGED_BYTES", merged)
    draw = np.random.default_rng(3)
    rows = [(i, [float(draw.integers(9)), float(draw.normal()), float(draw.integers(3))], i % 4) for i in range(400)]
    rows = [(i, x, 10 * x[0] + 40 * x[1] + 7 * x[2] * x[1] + float(draw.normal()), f) for i, x, f in rows]
    df = spark.createDataFrame(rows, "id long, x array<double>, price double, _fold int").withColumn("features", array_to_vector("x"))
    models = [bo.Boosted(3, 0.3), bo.Boosted(2, 0.1, 0.7, 0.6, seed=5), bo.Boosted(3, 0.2, 0.8, seed=9, resample=True), bo.Boosted(1, 0.5, without=2)]
    blocks, scores = bo.grow(bo.binned(df, "id", "price", 3, "_fold"), models, 3, 4, marks=(2, 4), cut_every=2)
    found = blocks.collect()
    assert sorted(k for b in found for k in b.keys) == list(range(400))
    whole = bo.Block(*[np.concatenate([getattr(b, c) for b in found]) for c in ("keys", "target", "bins", "ids", "fold")])
    got = np.concatenate([b.prediction for b in found], axis=1)
    for i, m in enumerate(models):
        assert got[i] == pytest.approx(_by_hand(m, whole, 4, 3), rel=1e-4, abs=1e-2), m
    held = whole.fold == 2
    left = ((whole.target - _by_hand(models[3], whole, 2, 3)) ** 2)[held].sum()
    assert scores[2][3] == pytest.approx(1 - left / ((whole.target[held] - whole.target[held].mean()) ** 2).sum(), abs=1e-4)
    assert scores[4][3] > scores[2][3] and scores[4][0] == 0


def test_draws_of_rows_and_columns(spark):
    from forecourt.operators import boosting as bo

    ids = np.arange(50_000, dtype=np.uint64) * np.uint64(7919)
    block = bo.Block([], np.zeros(len(ids)), np.zeros((len(ids), 2), np.uint8), ids, np.zeros(len(ids), np.int32))
    again = bo.row_weights(bo.Boosted(seed=4, resample=True), block, 0)
    assert again.mean() == pytest.approx(1, abs=0.03) and again.var() == pytest.approx(1, abs=0.06)
    first, second = (bo.row_weights(bo.Boosted(row_share=0.8), block, t) for t in (0, 1))
    assert first.mean() == pytest.approx(0.8, abs=0.01) and (first & second).mean() == pytest.approx(0.64, abs=0.01)
    assert [bo.drawn_columns(bo.Boosted(column_share=s), 0, 6).sum() for s in (1.0, 0.8, 0.01)] == [6, 5, 1]


def test_refits_stand_awkward_rows(spark, market):
    none = pricing.prediction_spread(market.limit(0), "listing_id", INPUTS, pricing.boosted(INPUTS, 2, 2), refits=2)
    assert none.count() == 0 and none.columns == ["listing_id", "price", "prediction", "uncertainty"]
    odd = market.limit(60).withColumns({"odometer": F.when(F.col("listing_id") < "l0030", F.col("odometer")), "manufacturer": F.lit(None).cast("string"),
                                        "features": F.lit(1), "keys": F.lit(2)})
    got = pricing.prediction_spread(odd.unionByName(odd), "listing_id", INPUTS, pricing.boosted(INPUTS, 2, 2), refits=2)
    assert got.count() == 120 and got.where("prediction is null or uncertainty is null").isEmpty()


def test_rows_of_equal_bins_grow_as_one_cell(spark):
    """Whatever the draws, a cell gets what its rows would get one by one."""
    from pyspark.ml.functions import array_to_vector

    from forecourt.operators import boosting as bo

    rows = [(i, [float(i % 5), float(i % 3)], 10.0 * (i % 5) + (i * 7919) % 11, i % 4) for i in range(600)]
    df = spark.createDataFrame(rows, "id long, x array<double>, price double, _fold int").withColumn("features", array_to_vector("x"))
    table = bo.binned(df, "id", "price", 2, "_fold")
    cells = [bo._opened(2, r) for r in table.collect()]
    assert sum(len(c.rows.target) for c in cells) == 600 and sum(len(c.first) for c in cells) <= 15 + table.rdd.getNumPartitions()
    models = [bo.Boosted(2, 0.3), bo.Boosted(3, 0.1, 0.7, seed=5), bo.Boosted(2, 0.2, 0.8, seed=9, resample=True), bo.Boosted(2, 0.5, without=2)]
    found = bo.grow(table, models, 2, 3)[0].collect()
    whole = bo.Block(*[np.concatenate([getattr(b, c) for b in found]) for c in ("keys", "target", "bins", "ids", "fold")])
    got = np.concatenate([b.prediction for b in found], axis=1)
    assert sorted(whole.keys) == list(range(600)) and all(y == rows[k][2] for k, y in zip(whole.keys, whole.target))
    for i, m in enumerate(models):
        assert got[i] == pytest.approx(_by_hand(m, whole, 3, 2), rel=1e-4, abs=1e-2), m


def test_model_rows_lie_on_all_cores(spark, tmp_path):
    """A table of one row group would be one task for every pass of a learner."""
    from forecourt.plans import modelling
    from forecourt.sources import Market

    n = 4000
    lines = spark.range(n).selectExpr(
        "id AS l_orderkey", "id % 50 AS l_partkey", "id % 7 AS l_suppkey", "1 AS l_linenumber", "cast(id AS double) AS l_extendedprice",
        "cast(id % 50 AS double) AS l_quantity", "'A' AS l_returnflag", "'F' AS l_linestatus")
    orders = spark.range(n).selectExpr("id AS o_orderkey", "date'1995-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority")
    parts = spark.range(50).selectExpr("id AS p_partkey", "'Brand#1' AS p_brand", "'name' AS p_name", "'kind' AS p_type")
    for name, df in {"lineitem": lines, "orders": orders, "part": parts}.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = modelling._model_rows(Market(spark, str(tmp_path)))
    held = rows.rdd.mapPartitions(lambda part: [sum(1 for _ in part)]).collect()
    assert sum(held) == n and max(held) < n / 2 and rows.select("listing_id").distinct().count() == n


@pytest.mark.parametrize("most_cells", [1 << 21, 0])
def test_boosted_trees_equal_those_of_spark(spark, monkeypatch, most_cells):
    """Grown on cells in one task or level by level, the trees are those of Spark's learner if nothing is drawn; the model is one of Spark's."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    from forecourt.operators import boosting as bo

    monkeypatch.setattr(bo, "MOST_CELLS", most_cells)
    draw = np.random.default_rng(21)
    rows = [(i, [float(draw.integers(9)), float(draw.integers(20)), float(draw.integers(2))]) for i in range(900)]
    rows = [(i, x, 1000.0 + 50 * x[0] + 3 * x[1] * x[2] + float(draw.normal())) for i, x in rows]
    df = spark.createDataFrame(rows, "_id long, x array<double>, price double").withColumn("features", array_to_vector("x"))
    regressor = GBTRegressor(labelCol="price", maxIter=4, maxDepth=3, stepSize=0.2, seed=3)
    got, want = bo.fit(df, regressor, "_id"), regressor.fit(df)
    pairs = got.transform(df).withColumnRenamed("prediction", "mine").join(want.transform(df).select("_id", "prediction"), "_id").collect()
    near = 1e-9 if most_cells else 1e-5  # level by level, sums are sent in single precision
    assert [r.mine for r in pairs] == pytest.approx([r.prediction for r in pairs], rel=near)
    assert got.featureImportances.toArray() == pytest.approx(want.featureImportances.toArray(), abs=near)
    assert list(got.treeWeights) == list(want.treeWeights) and got.getStepSize() == 0.2 and got.numFeatures == 3
    drawn = GBTRegressor(labelCol="price", maxIter=4, maxDepth=3, subsamplingRate=0.7, featureSubsetStrategy="0.5", seed=3)
    once, again = (bo.fit(d, drawn, "_id").transform(df).orderBy("_id").collect() for d in (df, df.repartition(7)))
    assert [r.prediction for r in once] == pytest.approx([r.prediction for r in again], rel=near)


def test_columns_drawn_per_node_as_spark_names_them():
    from forecourt.operators import boosting as bo

    assert [bo.columns_per_node(s, 6) for s in ("all", "auto", "sqrt", "log2", "onethird", "0.8", "1.0", "4", "9")] == [6, 6, 3, 3, 2, 5, 6, 4, 6]
    masks = bo.node_columns(bo.Boosted(node_columns=2), np.array([True, True, False, True]), 0, 3)
    assert masks.shape == (8, 4) and set(masks.sum(axis=1)) == {2} and not masks[:, 2].any() and len(np.unique(masks, axis=0)) > 1


def test_price_models_go_through_rows_once(spark, market):
    """Not a job per tree and level: as many jobs for many trees as for few."""
    import uuid

    def jobs(trees):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, group)
        pricing.train(market, INPUTS, pricing.boosted(INPUTS, trees, 3))
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    assert jobs(2) == jobs(20)


def test_predictions_by_cell_equal_those_of_the_model(spark, market):
    """Also at cuts, beyond all values, for numbers that are none, and for a model of one leaf."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.regression import GBTRegressor

    from forecourt.operators import scoring

    model = pricing.train(market, INPUTS, pricing.boosted(INPUTS, trees=12, depth=5))
    trees = scoring.trees_of(model, spark)
    x = np.random.default_rng(5).normal(0, 2, (500, 6))
    x[:60] = [[c[(i * 7) % len(c)] if len(c) else 0.0 for c in trees.cuts] for i in range(60)]
    x[60:70, 5], x[70:80, 4] = np.nan, np.inf
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, x array<double>").withColumn("features", array_to_vector("x"))
    want = [r.prediction for r in model.stages[-1].transform(df).orderBy("id").collect()]
    assert trees.predicted(x) == pytest.approx(want, rel=1e-12)
    cells = trees.cell(x)
    assert all(len({round(want[i], 6) for i in np.flatnonzero(cells == c)}) == 1 for c in cells)
    got = {r.listing_id: r.prediction for r in pricing.predict(model, market, INPUTS).collect()}
    assert got == pytest.approx({r.listing_id: r.prediction for r in model.transform(INPUTS.prepare(market)).collect()}, rel=1e-12)
    flat = market.withColumn("price", F.lit(7.0))
    assert {r.prediction for r in pricing.predict(pricing.train(flat, INPUTS, GBTRegressor(labelCol="price", maxIter=2, maxDepth=2)), flat, INPUTS).collect()} == {7.0}


def test_edges_lie_halfway_between_values():
    from forecourt.operators import boosting as bo

    assert bo.halfway(np.array([1.0, 2.0, 4.0]), np.array([5.0, 1.0, 1.0]), 32).tolist() == [1.5, 3.0]
    assert len(bo.halfway(np.arange(100.0), np.ones(100), 32)) == 31
    rare, often = np.arange(40.0), np.r_[np.ones(39), 1000.0]
    assert bo.halfway(rare, often, 4).tolist() == [38.5]
    values, times = bo._counted(np.array([1.0, 3.0]), np.array([2, 2]), np.array([3.0, 0.0, 3.0, 9.0]))
    assert values.tolist() == [0.0, 1.0, 3.0, 9.0] and times.tolist() == [1, 2, 4, 1]
    assert bo._counted(np.empty(0), np.empty(0), np.arange(5000.0)) is None


def test_mean_shapley_values_are_worked_out_once_per_cell(spark, market, monkeypatch):
    model = pricing.train(market, INPUTS, pricing.boosted(INPUTS, trees=6, depth=4))
    rows = shap.shap_values(model, market, INPUTS)
    want = rows.agg(*[F.avg(F.abs(F.get("shap", F.lit(i)))).alias(c) for i, c in enumerate((*INPUTS.categorical, *INPUTS.numeric))]).first().asDict()
    monkeypatch.setattr(shap, "shap_values", None)
    got = shap.mean_shap(model, market.unionByName(market), INPUTS)
    assert got.dtypes == [("feature", "string"), ("importance", "double")]
    assert {r.feature: r.importance for r in got.collect()} == pytest.approx(want, rel=1e-9)


@pytest.mark.parametrize("at_once", [64 << 20, 1])
def test_models_grown_by_way_equal_each_by_hand(spark, monkeypatch, at_once):
    """Each way to draw rows in a task of its own, few or many trees' sums at a time: the same trees and scores as level by level."""
    import pickle

    from pyspark.ml.functions import array_to_vector

    from forecourt.operators import boosting as bo

    monkeypatch.setattr(bo, "DRAWN_BYTES", at_once)
    draw = np.random.default_rng(8)
    rows = [(i, [float(draw.integers(5)), float(draw.integers(4))], i % 3) for i in range(700)]
    rows = [(i, x, 10 * x[0] + 7 * x[1] * x[0] + float(draw.normal()), f) for i, x, f in rows]
    df = spark.createDataFrame(rows, "id long, x array<double>, price double, _fold int").withColumn("features", array_to_vector("x"))
    models = [bo.Boosted(2, 0.3, without=1), bo.Boosted(3, 0.1, 0.7, seed=5, without=1), bo.Boosted(1, 0.2, 0.7, seed=5, without=1),
              bo.Boosted(2, 0.2, 0.8, seed=9, resample=True), bo.Boosted(2, 0.5, without=7)]
    found = bo.bin_rows(df, "id", "price", 2, "_fold")
    blocks, want = bo.grow(bo.in_blocks(found, 2), models, 2, 4, marks=(2, 4))
    lines = bo.grow_cells(found, models, 2, 4, (2, 4), kinds=("predictions",)).collect()
    got = bo.scores_of(spark.createDataFrame(lines), models, (2, 4))
    assert {m: s.tolist() for m, s in got.items()} == {m: pytest.approx(s.tolist(), abs=1e-5) for m, s in want.items()} and got[4][0] > got[2][0] > 0
    assert got[4][4] == 0  # no row is in that fold
    by_hand = {}
    for b in blocks.collect():
        by_hand |= {(i, x.tobytes()): b.prediction[i][j] for i in range(len(models)) for j, x in enumerate(b.bins)}
    cells = [(r.model, *pickle.loads(r.data)) for r in lines if r.kind == "predictions"]
    assert {(i, x.tobytes()): float(p) for i, bins, f in cells for x, p in zip(bins, f)} == pytest.approx(by_hand, rel=1e-5)


def test_spread_by_cell_equals_spread_by_row(spark, market, monkeypatch):
    from forecourt.operators import boosting as bo

    def rows():
        got = pricing.prediction_spread(market, "listing_id", INPUTS, pricing.boosted(INPUTS, 3, 3), refits=4)
        return got.columns, {r.listing_id: (r.price, r.prediction, r.uncertainty) for r in got.collect()}

    columns, by_cell = rows()
    monkeypatch.setattr(bo, "MOST_CELLS", 0)
    names, by_row = rows()
    assert columns == names == ["listing_id", "price", "prediction", "uncertainty"] and len(by_cell) == len(by_row) == 2000
    assert all(by_cell[i] == pytest.approx(by_row[i], rel=1e-3, abs=0.05) for i in by_row)
    # the lots of rows differ from tree to tree, also among the four that share a number
    ids = np.arange(40_000, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    drawn = np.stack([bo.drawn_rows(ids, 4, t, 0.8) for t in range(8)]).astype(float)
    assert drawn.mean(axis=1) == pytest.approx(np.full(8, 0.8), abs=0.01) and np.abs(np.corrcoef(drawn) - np.eye(8)).max() < 0.03
