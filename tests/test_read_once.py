"""Operators that go over their rows several times write them first, so a dear source (a join) is made once."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from forecourt.operators import cleaning, features, neighbours, sampling, segments, statistics

FEATURES = ["price", "year", "odometer"]


@pytest.fixture
def counted(spark):
    """200 listings and a counter of the rows that pass the source."""
    rng = np.random.default_rng(3)
    rows = [(f"k{i}", float(rng.integers(1, 90)) * 100, int(2000 + i % 9), float(rng.integers(0, 50)) * 1000, "abcd"[i % 4], f"m{i % 3}") for i in range(200)]
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "listing_id string, price double, year int, odometer double, state string, manufacturer string").repartition(2)
    return df.mapInArrow(count, df.schema), seen


CASES = {
    "segments": lambda df: segments.segment_figures(segments.segment(df, 3)),
    "states": lambda df: segments.state_clusters(df),
    "mahalanobis": lambda df: statistics.mahalanobis_outliers(df, FEATURES),
    "wide outliers": lambda df: cleaning.drop_wide_outliers(df),
    "strata": lambda df: sampling.stratified_sample(df, ["state", "year"], "listing_id", 50),
    "neighbour fill": lambda df: neighbours.fill_from_neighbours(df.withColumn("odometer", F.nullif("odometer", F.lit(0.0))), "listing_id", "odometer", ["price", "year"]),
    "outlier factors": lambda df: neighbours.local_outliers(df, "listing_id", FEATURES, 5),
    "similar listings": lambda df: neighbours.similar_listings(df, "listing_id", FEATURES, ["k3", "k7"]),
    "similar to all": lambda df: neighbours.similar_to_all(df, "listing_id", FEATURES),
}


@pytest.mark.parametrize("name", CASES)
def test_source_rows_are_made_once(counted, name):
    df, seen = counted
    CASES[name](df).collect()
    assert seen.value == 200


@pytest.mark.parametrize("run", [
    lambda df: segments.elbow(df, range(1, 4)),
    lambda df: statistics.robust_prices(df, ["manufacturer", "state"]),
], ids=["elbow", "robust prices"])
def test_rows_of_many_steps_are_made_once(counted, run):
    df, seen = counted
    run(df).collect()
    assert seen.value == 200


def wide(df):
    return df.withColumns({
        "model": F.when(F.col("odometer") > 9000, F.concat(F.lit("x"), F.col("year"))), "manufacturer": F.nullif("manufacturer", F.lit("m2")), "type": F.lit("sedan"),
        "fuel": F.lit("gas"), "condition": F.lit("good"), "latitude": F.col("price") / 100, "longitude": F.col("year") / 10,
        "posting_date": F.date_add(F.lit("2020-01-01").cast("date"), (F.col("odometer") / 500).cast("int")), "description": F.lit("like new")})


def test_rows_of_the_feature_table_are_made_once(counted):
    df, seen = counted
    assert features.feature_table(wide(df), "listing_id").count() == 200 and seen.value == 200


def test_figures_of_the_feature_table_need_their_own_keys_only(counted):
    """Figures of make, model, week and month come in one join; a missing model takes none of its make's."""
    df = wide(counted[0]).localCheckpoint()
    rows = features.feature_table(df, "listing_id").collect()
    plain = {r.listing_id: r for r in df.collect()}
    mean = lambda x: pytest.approx(sum(x) / len(x)) if x else None
    assert len(rows) == 200 and any(r.model is None and r.manufacturer for r in rows) and any(r.manufacturer is None for r in rows)
    for r in rows:
        make = [o for o in rows if o.manufacturer and o.manufacturer == r.manufacturer]
        model = [o for o in make if o.model and o.model == r.model]
        week, month = ([o for o in model if (o.posting_year, o[part]) == (r.posting_year, r[part])] for part in ("posting_week", "posting_month"))
        assert r.avg_price_by_manufacturer == mean([o.price for o in make]) and r.avg_price_by_model == mean([o.price for o in model])
        assert r.price_avg_by_week == mean([o.price for o in week]) and r.price_avg_by_month == mean([o.price for o in month])
        assert r.listings_by_type == 200 and r.price == plain[r.listing_id].price and r.description_mentions_new == 1


def test_elbow_is_that_of_a_run_per_k(counted):
    """Runs grown side by side end at the centres, costs and silhouettes of one after the other."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.evaluation import ClusteringEvaluator

    df = counted[0].select(*FEATURES).coalesce(1).localCheckpoint()
    rows = segments.scaled(df, FEATURES, "minmax").select("features")
    got = {r.k: r for r in segments.elbow(df, range(2, 5)).collect()}
    for k in got:
        model = KMeans(k=k, seed=42).fit(rows)
        assert got[k].cost == pytest.approx(model.summary.trainingCost)
        assert got[k].silhouette == pytest.approx(ClusteringEvaluator().evaluate(model.transform(rows)))


def test_outlier_factors_of_crowded_places(spark):
    """Listings that share a place share their factor; the lists are those of pairing all rows."""
    rng = np.random.default_rng(8)
    points = np.vstack([np.zeros((30, 2)), np.full((4, 2), 9.0), rng.integers(0, 10, (60, 2))]).astype(float)
    ids = [f"p{i:03d}" for i in rng.permutation(len(points))]
    df = spark.createDataFrame([(i, *map(float, p)) for i, p in zip(ids, points)], "id string, a double, b double")
    k, unit = 6, points / 9.0
    far = np.sqrt(((unit[:, None] - unit[None]) ** 2).sum(axis=2))
    near = [[j for j in sorted(range(len(ids)), key=lambda j: (far[i, j], ids[j])) if j != i][:k] for i in range(len(ids))]
    reach = [far[i, near[i][-1]] for i in range(len(ids))]
    density = [1 / (np.mean([max(far[i, j], reach[j]) for j in near[i]]) + 1e-10) for i in range(len(ids))]
    want = {ids[i]: np.mean([density[j] for j in near[i]]) / density[i] for i in range(len(ids))}
    got = {r.id: r.lof for r in neighbours.local_outlier_factor(df, "id", ["a", "b"], k).collect()}
    assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i]) for i in want)


def test_outlier_factors_of_repeated_keys(spark):
    """No listing is its own neighbour under the same key: one row per key, as ever."""
    df = spark.createDataFrame([(i % 20, float(i % 20), float(i % 20 * 3 % 7)) for i in range(40)], "id int, a double, b double")
    got = neighbours.local_outlier_factor(df, "id", ["a", "b"], 4).collect()
    assert sorted(r.id for r in got) == list(range(20))


def test_keys_that_only_make_a_null_are_not_shuffled(spark, tmp_path):
    """Price and mileage are made before line items meet their orders."""
    from forecourt.sources import Market

    spark.range(40).selectExpr("id as l_orderkey", "id % 50 as l_partkey", "id % 30 as l_suppkey", "cast(id as double) as l_quantity", "cast(id as double) as l_extendedprice").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    spark.range(40).selectExpr("id as o_orderkey", "timestamp'2001-02-03' as o_orderdate", "'1-URGENT' as o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    listings = Market(spark, str(tmp_path)).listings("price", "odometer", "year", "condition")
    lines = listings._jdf.queryExecution().optimizedPlan().toString().splitlines()
    below = lines[next(i for i, line in enumerate(lines) if "Join Inner" in line) + 1]
    assert "_price" in below and not re.search(r"(\[|, )l_(part|supp)key#", below)
    got = {r.year for r in listings.collect()}
    assert got == {2001} and {r.condition for r in listings.collect()} == {"new"}
    assert listings.where("price is null").count() == 1 and listings.where("odometer is null").count() == 3
