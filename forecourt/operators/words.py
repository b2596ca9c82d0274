"""What listing texts say: financing terms, word counts, polarity."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from forecourt.functions.numbers import half_up
from forecourt.functions import text as tx
from forecourt.functions.text import words
from forecourt.operators.aggregates import top_per_group
from forecourt.operators.quantiles import quantile_values

# Common English words that say nothing about a listing.
STOP_WORDS = """i me my we our you your he him his she her it its they them their what which who this that these
those am is are was were be been being have has had do does did a an the and but if or because as until while of at by
for with about to from up down in out on off over under again then here there when where why how all any both each few
more most other some such no nor not only own same so than too very s t can will just don should now""".split()

# Polarity of words used about vehicles, -1 to 1.
POLARITY = {
    "clean": 0.4, "new": 0.1, "like": 0.0, "great": 0.8, "excellent": 1.0, "good": 0.7, "nice": 0.6, "best": 1.0,
    "perfect": 1.0, "reliable": 0.5, "bad": -0.7, "poor": -0.4, "broken": -0.4, "damaged": -0.5, "rough": -0.1,
    "dirty": -0.6, "salvage": -0.3, "terrible": -1.0, "worst": -1.0,
}

# Polarity of what is said of vehicles in several words, and of some more single words.
PHRASES = {
    "like new": 0.6, "clean title": 0.5, "salvage title": -0.6, "rebuilt title": -0.4, "warranty included": 0.5, "no warranty": -0.3,
    "one owner": 0.4, "well maintained": 0.7, "well kept": 0.6, "low miles": 0.4, "low mileage": 0.4, "high miles": -0.3, "high mileage": -0.3,
    "runs great": 0.8, "runs rough": -0.6, "needs work": -0.6, "needs tires": -0.3, "as is": -0.2, "check engine": -0.6, "no accidents": 0.6,
    "accident free": 0.6, "rust free": 0.5, "rust": -0.5, "dents": -0.3, "scratches": -0.2, "leaks": -0.5, "smoke free": 0.4, "garage kept": 0.5,
    "must see": 0.5, "must sell": -0.1, "or best offer": 0.1, "obo": 0.1,
}
# Words that turn what follows round, and by how much.
NEGATIONS = ("not", "no", "never", "without", "hardly")
NEGATED = -0.5


def lexicon_pattern(lexicon: dict[str, float], negations: tuple[str, ...] = NEGATIONS) -> str:
    """Pattern of a phrase, longest first, after a negation if there is one; every word stands between spaces of its own."""
    quoted = [re.escape("  ".join(p.split())).replace("\\ ", " ") for p in sorted(lexicon, key=lambda p: (-len(p.split()), -len(p), p))]
    return f" (?:({'|'.join(negations)})  )??({'|'.join(quoted)}) "


def spaced_words(text: Column) -> Column:
    return F.concat(F.lit(" "), F.array_join(words(text), "  "), F.lit(" "))


def phrase_sentiment(df: DataFrame, text: str, lexicon: dict[str, float] | None = None) -> DataFrame:
    """``sentiment``, ``hits`` and ``negated``: mean polarity of the phrases of each text, 0 where none is known.

    A phrase is the longest of the lexicon from a word on; its words are spent. One that follows a negation counts
    ``NEGATED`` times, a phrase that holds its negation ("no accidents") as it stands. Texts stay in their row; null ones
    hold no phrase.
    """
    lexicon = POLARITY | PHRASES if lexicon is None else lexicon
    pattern, said = F.lit(lexicon_pattern(lexicon)), F.col("_said_words")
    rows = df.withColumn("_said_words", F.coalesce(spaced_words(F.col(text)), F.lit("")))
    rows = rows.withColumns({"_said_turns": F.regexp_extract_all(said, pattern, F.lit(1)), "_said_phrases": F.regexp_extract_all(said, pattern, F.lit(2))})
    table = F.create_map(*[F.lit(x) for p, v in lexicon.items() for x in ("  ".join(p.split()), float(v))])
    rows = rows.withColumn("_said_values", F.zip_with("_said_phrases", "_said_turns", lambda p, t: F.element_at(table, p) * F.when(t == "", 1.0).otherwise(NEGATED)))
    hits, total = F.size("_said_values"), F.aggregate("_said_values", F.lit(0.0), lambda a, v: a + v)
    return _unstaged(rows.withColumns({
        "sentiment": F.coalesce(total / F.nullif(hits, F.lit(0)), F.lit(0.0)), "hits": hits, "negated": F.size(F.filter("_said_turns", lambda t: t != ""))}))


def staged(df: DataFrame, found: dict[str, Column]) -> tuple[DataFrame, dict[str, Column]]:
    """Text searches as columns, so that each pattern runs once per row however often its
    result is used afterwards."""
    names = {k: f"_said_{k}" for k in found}
    return df.withColumns({names[k]: c for k, c in found.items()}), {k: F.col(v) for k, v in names.items()}


def _unstaged(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_said_")])


def with_total_price(df: DataFrame, price: str = "price", description: str = "description", name: str = "terms",
                     **options) -> DataFrame:
    """Add the struct of :func:`total_price_of`."""
    rows, terms = staged(df, tx.instalment_terms(F.col(description)))
    return _unstaged(rows.withColumn(name, tx.total_price_of(F.col(price), F.col(description), terms, **options)))


def with_text_price(df: DataFrame, price_text: str, description: str = "description", name: str = "price") -> DataFrame:
    rows, terms = staged(df, tx.instalment_terms(F.col(description)))
    return _unstaged(rows.withColumn(name, tx.price_from_text(F.col(price_text), terms)))


def with_payment_info(df: DataFrame, description: str = "description", name: str = "payment_info",
                      estimate: str = "estimate") -> DataFrame:
    """Add the payment struct and the price estimated from it."""
    rows, amounts = staged(df, tx.payment_amounts(F.col(description)))
    return _unstaged(rows.withColumns({name: tx.payment_info(amounts), estimate: tx.estimated_price(amounts)}))


def with_raised_price(df: DataFrame, price: str = "price", description: str = "description", name: str = "raised_price") -> DataFrame:
    """Add the estimate where it is above the asked price, else the asked price."""
    rows, amounts = staged(df, tx.payment_amounts(F.col(description)))
    rows = rows.withColumn("_said_estimate", tx.estimated_price(amounts))
    estimate = F.col("_said_estimate")
    return _unstaged(rows.withColumn(name, F.when(estimate > F.col(price), estimate).otherwise(F.col(price))))


def with_financing_pt(df: DataFrame, description: str = "description") -> DataFrame:
    """Add down_payment, monthly_payment, term_months, apr and real_price."""
    rows = df.withColumns(tx.financing_pt(F.col(description)))
    return rows.withColumn("real_price", tx.real_price_pt(F.col("down_payment"), F.col("monthly_payment"), F.col("term_months")))


def top_words_by_price(df: DataFrame, k: int = 10) -> DataFrame:
    """The k most frequent words in each price third, stop words left out."""
    edges = quantile_values(df, "price", {"a": 1 / 3, "b": 2 / 3})
    band = F.when(F.col("price") <= edges["a"], "low").when(F.col("price") <= edges["b"], "mid").otherwise("high")
    rows = df.where(F.col("price").isNotNull() & F.col("description").isNotNull())
    counts = (rows.select(band.alias("band"), F.explode(words(F.col("description"))).alias("word"))
              .where(~F.col("word").isin(STOP_WORDS))
              .groupBy("band", "word").agg(F.count("*").alias("total")))
    return top_per_group(counts, ["band"], "total", "word", k)


def sentiment(df: DataFrame, key: str, text: str) -> DataFrame:
    """Mean polarity of the known words of each text; 0 where none is known.

    The lexicon is a constant of the program, so it is looked up in place: each text stays
    in its row and nothing is exploded or joined.
    """
    lexicon = F.create_map(*[F.lit(x) for pair in POLARITY.items() for x in pair])
    known = F.filter(F.transform(words(F.col(text)), lambda w: F.try_element_at(lexicon, w)), lambda p: p.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, p: a + p)
    return df.withColumn("_hits", F.coalesce(F.size(known), F.lit(0))).withColumn(
        "sentiment", F.coalesce(F.when(F.col("_hits") > 0, total / F.col("_hits")), F.lit(0.0))).withColumn(
        "has_sentiment", F.col("_hits") > 0).drop("_hits")


def sentiment_summary(df: DataFrame) -> DataFrame:
    p = F.col("sentiment")
    return df.agg(F.count("*").alias("texts"), F.count_if("has_sentiment").alias("scored"),
                  half_up(F.avg(p), 6).alias("mean"), half_up(F.stddev_samp(p), 6).alias("std"),
                  F.min(p).alias("minimum"), F.max(p).alias("maximum"))


def low_price_financing(df: DataFrame, suspicious: float = 10_000) -> DataFrame:
    """How many low-priced listings state each financing term."""
    said = lambda c: F.count_if(F.col(c) != 0)
    return df.agg(F.count("*").alias("total_low_price"), said("down_payment").alias("with_down_payment"),
                  said("monthly_payment").alias("with_monthly_payment"), said("term_months").alias("with_term"),
                  said("real_price").alias("with_real_price"),
                  F.count_if(F.col("real_price") > suspicious).alias("suspicious_prices"))
