"""Financing text, by hand-worked cases."""

import pytest
from pyspark.sql import functions as F

from forecourt.functions import text as tx
from forecourt.operators import words as wd


@pytest.fixture(scope="module")
def totals(spark):
    rows = [
        (1, 9000.0, "entrada de 5000 e 48x 750,50"), (2, 9000.0, "12 parcelas de 500"), (3, 9000.0, "1 parcela de 500"),
        (4, 9000.0, "Jeep 4x4 impecável"), (5, 20000.0, "entrada 3000"), (6, 20000.0, None), (7, None, "36 × 400"), (8, 5.0, ""),
    ]
    df = spark.createDataFrame(rows, "id int, price double, description string")
    return {r.id: r for r in wd.with_total_price(df).select("id", "terms.*").collect()}


@pytest.mark.parametrize("key, has, term, monthly, down, total", [
    (1, True, 48, 750.5, 5000.0, 41024.0), (2, True, 12, 500.0, None, 6000.0), (3, True, 48, 500.0, None, 24000.0),
    (4, True, 4, 4.0, None, 16.0), (5, False, None, None, 3000.0, 20000.0), (6, False, None, None, None, None),
    (8, False, None, None, None, None)])
def test_total_price(totals, key, has, term, monthly, down, total):
    r = totals[key]
    assert (r.has_installments, r.installments, r.monthly_payment, r.down_payment, r.total_price) == (has, term, monthly, down, total)


def test_times_sign_without_stated_term(totals):
    # the term pattern knows only the letter x
    assert totals[7].monthly_payment == 400.0 and totals[7].installments == 48


def test_min_payment_rejects_four_by_four(spark):
    df = spark.createDataFrame([(9000.0, "Jeep 4x4 impecável")], "price double, description string")
    t = wd.with_total_price(df, min_payment=50).first().terms
    assert not t.has_installments and t.total_price == 9000.0


def one(spark, fn, text):
    return spark.createDataFrame([(text,)], "d string").select(fn(F.col("d")).alias("x")).first().x


@pytest.mark.parametrize("text, monthly, down, total", [
    ("$299 per month, down payment $1,500", 299.0, 1500.0, None), ("total price $12,500.50", None, None, 12500.5),
    ("350/mo", 350.0, None, None), ("nice car", None, None, None), (None, None, None, None)])
def test_payment_info(spark, text, monthly, down, total):
    r = one(spark, lambda d: tx.payment_info(tx.payment_amounts(d)), text)
    assert (r.monthly_payment, r.down_payment, r.total_price) == (monthly, down, total)
    assert r.has_payment_info == any(x is not None for x in (monthly, down, total))


@pytest.mark.parametrize("text, estimate", [
    ("$299 per month, down payment $1,500", 299 * 48 + 1500), ("price $900 or $20 per month", 900.0), ("down payment $500", None)])
def test_estimate(spark, text, estimate):
    assert one(spark, lambda d: tx.estimated_price(tx.payment_amounts(d)), text) == estimate


def test_price_only_rises(spark):
    df = spark.createDataFrame([(100.0, "$299 per month"), (99999.0, "$299 per month"), (None, "x")], "price double, description string")
    got = [r.x for r in wd.with_raised_price(df, name="x").collect()]
    assert got == [299 * 48, 99999.0, None]


def test_financing_en(spark):
    r = one(spark, tx.financing_en, "$2000 DOWN, $350 monthly, 60 months at 4.9% APR, price of $18,500")
    assert (r.down_payment, r.monthly_payment, r.term_months, r.apr, r.real_price) == (2000, 350, 60, 4.9, 18500)


def test_financing_pt(spark):
    said = ["Entrada de R$ 5.000,00 e 48 parcelas de R$ 1.234,56 com 12,5% a.a.", "48 parcelas de 100"]
    r, other = wd.with_financing_pt(spark.createDataFrame([(t,) for t in said], "description string")).collect()
    assert (r.down_payment, r.monthly_payment, r.term_months, r.apr) == (5000.0, 1234.56, 48, 12.5)
    assert r.real_price == pytest.approx(1234.56 * 48 + 5000)
    assert other.real_price is None and other.monthly_payment == 100.0


def test_price_from_text(spark):
    df = spark.createDataFrame([("$12,500", "nice"), ("$1", "entrada 1000 e 10x 100"), ("call me", None)], "p string, description string")
    got = [r.x for r in wd.with_text_price(df, "p", name="x").collect()]
    assert got == [12500.0, 2000.0, None]


def test_small_text_helpers(spark):
    df = spark.createDataFrame([("6-speed Manual",), ("AUTOMATIC",), ("cvt",), (None,)], "t string")
    assert [r.x for r in df.select(tx.transmission_bucket(F.col("t")).alias("x")).collect()] == ["Manual", "Automatic", "Other", "Other"]
    assert one(spark, tx.ascii_only, "café €5") == "caf 5"
    assert one(spark, tx.words, "Like NEW, 4x4!") == ["like", "new", "4x4"]


def test_title_flags_and_vin(spark):
    from forecourt.operators.features import title_flags

    rows = spark.createDataFrame([(1, "clean", "1FT"), (2, "lien", None), (3, "rebuilt", ""), (4, None, "x"), (5, "Salvage", None), (6, "salvage", "y")],
                                 "id int, title string, vin string")
    got = {r.id: r for r in rows.select("id", *[c.alias(n) for n, c in title_flags(F.col("title")).items()],
                                        tx.description_features(F.col("title"), F.col("vin"))["has_vin"].alias("has_vin")).collect()}
    flags = {i: [t for t in ("clean", "salvage", "rebuilt", "lien") if r[f"is_{t}_title"]] for i, r in got.items()}
    assert flags == {1: ["clean"], 2: ["lien"], 3: ["rebuilt"], 4: [], 5: [], 6: ["salvage"]}
    assert [got[i].has_vin for i in range(1, 7)] == [1, 0, 1, 1, 0, 1]


def test_phrases_are_longest_first_and_negated(spark):
    from forecourt.operators.words import phrase_sentiment

    lexicon = {"new": 0.1, "like new": 0.6, "good": 0.7, "no rust": 0.5, "rust": -0.5, "clean title": 0.5}
    texts = {"LIKE new!": (0.6, 1, 0), "new, like": (0.1, 1, 0), "not like new": (-0.3, 1, 1), "no rust; rust": (0.0, 2, 0), "never good good": (0.175, 2, 1),
             "not, a good one": (0.7, 1, 0), "good good good": (0.7, 3, 0), "newer goods": (0.0, 0, 0), "": (0.0, 0, 0), "without clean title": (-0.25, 1, 1)}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: (r.sentiment, r.hits, r.negated) for r in phrase_sentiment(df, "t", lexicon).collect()}
    assert got.pop(None) == (0.0, 0, 0)
    for t, want in texts.items():
        assert got[t] == pytest.approx(want), t
