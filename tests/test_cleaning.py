import datetime as dt

import pytest
from pyspark.sql import functions as F

from forecourt import schema as s
from forecourt.operators import cleaning as cl
from forecourt.operators import financing as fin
from forecourt.operators.joins import join_on, keep_frequent, upsert
from forecourt.operators.market import limit_of

SCENARIO = [
    (0, "chevrolet", "impala", 987654321.0, 2010, "ok"), (1, "dodge", "charger", 199.0, 2017, "monthly payment $199"),
    (2, "dodge", "charger", 199.0, 2017, "monthly payment $199"), (3, "dodge", "charger", 199.0, 2017, "monthly payment $199"),
    (4, "honda", "accord", 80.0, 2005, "Asking $800"), (5, "cadillac", "escalade esv", 1.0, 2008, "$5,500 OBO"),
    (6, "ford", "f150", 100.0, 1999, "runs"), (7, "ferrari", "testarossa", 200000.0, 1990, None),
    (8, "toyota", "camry", 15000.0, 2015, "clean"), (9, "honda", "civic", 25000.0, 2020, "new"),
]


@pytest.fixture(scope="module")
def ledger(spark):
    df = spark.createDataFrame(SCENARIO, "original_id int, manufacturer string, model string, price double, year int, description string")
    return cl.price_ledger(df, "original_id")


def test_cleaning_scenario(ledger):
    got = {r.original_id: (r.price, r.reject_reason) for r in ledger.collect()}
    assert got == {
        0: (987654321.0, "sentinel_price"), 1: (199.0, "monthly_payment"), 2: (199.0, "duplicate_listing"),
        3: (199.0, "duplicate_listing"), 4: (800.0, None), 5: (5500.0, None), 6: (100.0, "low_price"),
        7: (200000.0, None), 8: (15000.0, None), 9: (25000.0, None)}


def test_kept_and_rejected_make_the_input(ledger):
    assert cl.kept(ledger).count() == 5 and cl.rejected(ledger).count() == 5


def test_limits(spark):
    df = spark.createDataFrame([("Ferrari",), ("kia",), (None,)], "m string")
    high = limit_of(F.col("m"), s.AUDIT_LIMITS, s.AUDIT_DEFAULT_LIMITS, 1)
    assert [r.x for r in df.select(high.alias("x")).collect()] == [2000000.0, 200000.0, 200000.0]
    rows = spark.createDataFrame([("Toyota", 4000.0), ("toyota", 6000.0), ("x", 2500.0), (None, 1.0), ("bmw", None)], "manufacturer string, price double")
    assert [r.price_valid for r in cl.within_load_limits(rows).collect()] == [False, True, True, False, False]


def test_audit_ledger_order(spark):
    df = spark.createDataFrame([("ferrari", 5000.0, None), ("kia", None, None), ("kia", 100.0, "$299 per month"), ("kia", 250000.0, None)],
                               "manufacturer string, price double, description string")
    assert [(r.price, r.reject_reason) for r in cl.audit_ledger(df).collect()] == [
        (5000.0, "below_make_limit"), (None, "no_price"), (14352.0, None), (250000.0, "above_make_limit")]


def test_price_bins(spark):
    df = spark.createDataFrame([(0.0,), (10000.0,), (10000.01,), (50000.0,), (60000.0,), (None,)], "p double")
    row = lambda f: [r.x for r in df.select(f(F.col("p")).alias("x")).collect()]
    assert row(cl.price_category) == [None, "<10k", "10k-20k", "30k-50k", ">50k", None]
    assert row(fin.dollar_range) == ["Under $10k", "$10k-$20k", "$10k-$20k", "Over $50k", "Over $50k", None]
    assert row(fin.real_range) == ["Até R$ 50.000"] * 4 + ["R$ 50.001 - R$ 100.000", None]


def test_installment_clamp(spark):
    df = spark.createDataFrame([(10000.0, 5000.0, None, 6), (10000.0, 10000.0, 5.0, 12), (10000.0, 100.0, 1000.0, None), (10000.0, 100.0, 0.0, 99)],
                               "price double, monthly_payment double, down_payment double, installments int")
    got = fin.repair_installments(df).collect()
    assert (got[0].down_payment, got[0].installments) == (2000.0, 12) and got[0].monthly_payment == pytest.approx(8000 / 12)
    assert (got[1].has_installments, got[1].monthly_payment, got[1].installments) == (False, None, None)
    assert (got[2].installments, got[3].installments) == (48, 60)


def test_text_cleaning(spark):
    df = spark.createDataFrame([(" NaN ", "Petrol", "CVT", "ca "), (None, "flex", None, None), ("VW", "gas", "auto", "ny")],
                               "manufacturer string, fuel string, transmission string, state string").withColumn("model", F.lit(" A "))
    assert [r.manufacturer for r in cl.normalise_text(df, ["manufacturer"]).collect()] == [None, None, "vw"]
    got = cl.standard_values(df).collect()
    assert [(r.fuel, r.transmission, r.state, r.model) for r in got] == [
        ("gasoline", "automatic", "CA", "a"), ("hybrid", "unknown", "UNKNOWN", "a"), ("gasoline", "automatic", "NY", "a")]
    assert cl.apply_aliases(df).collect()[2].manufacturer == "volkswagen"
    assert [r.fuel for r in cl.apply_aliases(df).collect()] == [None, None, "gas"]


def test_ranges_and_numbers(spark):
    df = spark.createDataFrame([("12.5", 99.0), ("x", 100.0), ("", 1e6), (None, 1e6 + 1)], "t string, price double")
    assert [r.t for r in cl.coerce_numbers(df, ["t"]).collect()] == [12.5, None, None, None]
    assert [r.price for r in cl.null_outside(df).collect()] == [None, 100.0, 1e6, None]


def test_search_keeps_zero_as_a_condition(spark):
    df = spark.createDataFrame([(1, -5.0), (2, 0.0), (3, 7.0)], "id int, price double")
    assert cl.search(df, min_price=0).count() == 2
    with pytest.raises(ValueError):
        cl.page(df, "id", limit=1001)


def test_comparables_fall_back_to_the_make(spark):
    rows = [("kia", "rio", y, p) for y, p in ((2010, 10.0), (2012, 20.0), (2015, 60.0))]
    df = spark.createDataFrame(rows, "manufacturer string, model string, year int, price double")
    asked = spark.createDataFrame([("kia", "rio", 2011), ("kia", "soul", 2011)], "manufacturer string, model string, year int")
    got = {r.model: r for r in cl.comparables(df, asked).collect()}
    assert (got["rio"].basis, got["rio"].priced, got["rio"].avg_price, got["rio"].median_price) == ("model", 2, 15.0, 15.0)
    assert (got["soul"].basis, got["soul"].priced, got["soul"].avg_price) == ("make", 3, 30.0)


def test_comparables_with_days_listed(spark):
    rows = [("kia", "rio", 2010, 10.0, 4), ("kia", "rio", 2011, 10.0, 8), ("kia", "rio", 2012, None, None), ("kia", "ceed", 2012, 50.0, 20), (None, "rio", 2010, 1.0, 1)]
    df = spark.createDataFrame(rows, "manufacturer string, model string, year int, price double, days int")
    asked = spark.createDataFrame([("kia", "rio", 2011), ("kia", "soul", None), ("bmw", "m3", 2011)], "manufacturer string, model string, year int")
    got = {r.model: r for r in cl.comparables(df, asked, span=1, days_listed="days").collect()}
    assert (got["rio"].total_listings, got["rio"].priced, got["rio"].avg_days_listed, got["rio"].std_price) == (3, 2, 6.0, 0.0)
    assert (got["soul"].basis, got["soul"].total_listings, got["soul"].avg_days_listed) == ("make", 4, 10.67)
    assert (got["m3"].basis, got["m3"].total_listings, got["m3"].median_price) == ("make", None, None)


def test_comparables_never_copy_listings(spark):
    """The plan spreads requests, not listings: no Generate stands on the scan of listings."""
    df = spark.createDataFrame([("kia", "rio", 2010, 10.0)], "manufacturer string, model string, year int, price double")
    asked = spark.createDataFrame([("kia", "rio", 2011)], "manufacturer string, model string, year int")
    plan = cl.comparables(df, asked)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # what is left joins written counts


def test_clean_view_needs_a_known_flag(spark):
    base = ("kia", "rio", 2010, 1000.0, 5.0)
    rows = [(*base, False, None, None, None), (*base, None, None, None, None), (*base, True, 100.0, 9, 100.0), (*base, True, 100.0, 9, 0.0)]
    df = spark.createDataFrame(rows, "manufacturer string, model string, year int, price double, odometer double, "
                                     "has_installments boolean, monthly_payment double, installments int, down_payment double")
    assert cl.clean_view(df).count() == 2


def test_wide_outliers(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("price"), F.lit(1.0).alias("odometer"), F.lit(2010).alias("year"))
    extra = spark.createDataFrame([(1e6, 1.0, 2010), (5.0, None, 2010), (5.0, 1.0, 1999)], "price double, odometer double, year int")
    assert cl.drop_wide_outliers(df.unionByName(extra)).count() == 100


def test_joins(spark):
    old = spark.createDataFrame([("a", None, 1), ("b", "x", 2)], "k string, j string, v int")
    new = spark.createDataFrame([("a", None, 10), ("c", "y", 3)], "k string, j string, v int")
    got = {(r.k, r.j): r.v for r in upsert(old, new, ["k", "j"]).collect()}
    assert got == {("a", None): 10, ("b", "x"): 2, ("c", "y"): 3}
    assert join_on(old, new, ["k", "j"]).count() == 0 and join_on(old, new.withColumnRenamed("v", "w"), ["k", "j"], nulls_match=True).count() == 1
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)] * 2 + [(None,)] * 9, "k string")
    assert keep_frequent(df, "k", top=2).groupBy("k").count().count() == 2
    assert {r.k for r in keep_frequent(df, "k", min_count=3).collect()} == {"a"}


def test_as_of_is_a_parameter(spark):
    df = spark.createDataFrame([(5.0, 2000, dt.date(2020, 1, 1)), (0.0, 2000, dt.date(2020, 1, 1)), (5.0, 1980, None)],
                               "price double, year int, posting_date date")
    assert [r.vehicle_age for r in cl.base_view(df, 2021).collect()] == [21]
