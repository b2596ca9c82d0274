"""Financing terms and features read from listing text, as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from forecourt.functions.numbers import number

# Patterns of the total-price reader (lower-cased text).
TIMES_VALUE = r"(\$?\d+[.,]\d+|\d+)(?:\s*(?:x|×)\s*|\s+parcelas?\s+de\s+)(\d+[.,]\d+|\d+)"
DOWN_PT = r"entrada\s+(?:de\s+)?(\$?\d+[.,]\d+|\d+)"
TERM_PT = r"(\d+)\s*(?:x|parcelas|vezes)"

# Patterns of the payment reader (lower-cased text).
MONTHLY = r"\$?\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)\s*(?:\/|\s+per\s+)?\s*(?:month|mo|mensal)"
DOWN = r"(?:down\s+payment|entrada)\s*\$?\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"
TOTAL = r"(?:total\s+price|price|valor\s+total)\s*\$?\s*(\d{1,3}(?:,\d{3})*(?:\.\d{2})?)"

# Patterns of the English and Portuguese financing readers, any case.
FINANCING_EN = {
    "down_payment": r"(?i)\$(\d+)\s*(?:down|entrada)",
    "monthly_payment": r"(?i)\$(\d+)\s*(?:monthly|mensal)",
    "term_months": r"(?i)(\d+)\s*(?:months|meses)",
    "apr": r"(?i)(\d+\.?\d*)%\s*APR",
    "real_price": r"(?i)price\s*of\s*\$(\d+,?\d*)",
}
FINANCING_PT = {
    "down_payment": r"(?i)entrada\s*(?:de\s*)?R?\$?\s*(\d+(?:\.\d{3})*(?:,\d{2})?)",
    "monthly_payment": r"(?i)(?:parcela|parcelas)\s*(?:de\s*)?R?\$?\s*(\d+(?:\.\d{3})*(?:,\d{2})?)",
    "term_months": r"(?i)(\d+)\s*(?:x|parcelas|vezes)",
    "apr": r"(?i)(\d+(?:,\d+)?)%\s*(?:a\.a\.|ao ano)",
}


def _without(text: Column, *marks: str) -> Column:
    for mark in marks:
        text = F.replace(text, F.lit(mark), F.lit(""))
    return text


def _dotted(text: Column) -> Column:
    return number(F.replace(_without(text, "$"), F.lit(","), F.lit(".")))


def instalment_terms(description: Column) -> dict[str, Column]:
    """Number of times, payment, down payment and stated term of an instalment phrase.

    Each is one pattern search. Put them into columns of their own before using them in
    several places, or the search is done once per place.
    """
    text = F.lower(description)
    return {
        "times": _dotted(F.regexp_extract(text, TIMES_VALUE, 1)),
        "payment": _dotted(F.regexp_extract(text, TIMES_VALUE, 2)),
        "down": _dotted(F.regexp_extract(text, DOWN_PT, 1)),
        "term": F.nullif(F.regexp_extract(text, TERM_PT, 1), F.lit("")).try_cast("int"),
    }


def total_price_of(price: Column, description: Column, terms: dict[str, Column], default_term: int = 48,
                   min_payment: float = 0.0) -> Column:
    """Struct of financing terms and the total price they imply.

    An instalment phrase gives term x payment + down payment; without one the total is the
    stated price, and without any text it is null. "4x4" reads as four payments of four;
    ``min_payment`` above 0 rejects such phrases.
    """
    financed = F.coalesce(terms["payment"] >= min_payment, F.lit(False))
    payment = F.when(financed, terms["payment"])
    term = F.when(financed, F.coalesce(terms["term"], F.lit(default_term)))
    total = F.when(financed, payment * term + F.coalesce(terms["down"], F.lit(0.0))).when(
        description.isNotNull() & (description != ""), price.cast("double"))
    return F.struct(
        financed.alias("has_installments"), payment.alias("monthly_payment"), terms["down"].alias("down_payment"),
        total.alias("total_price"), term.alias("installments"), price.cast("double").alias("original_price"),
    )


def price_from_text(price_text: Column, terms: dict[str, Column]) -> Column:
    """Price of a listing whose price is text: the instalment sum, else the cleaned price."""
    implied = F.coalesce(terms["times"] * terms["payment"], F.lit(0.0)) + F.coalesce(terms["down"], F.lit(0.0))
    return F.when(implied != 0, implied).otherwise(number(F.trim(_without(price_text, "$", ","))))


def payment_amounts(description: Column) -> dict[str, Column]:
    """Monthly payment, down payment and total price; thousands commas allowed."""
    text = F.lower(description)
    return {name: number(_without(F.regexp_extract(text, pattern, 1), ","))
            for name, pattern in (("monthly", MONTHLY), ("down", DOWN), ("total", TOTAL))}


def payment_info(amounts: dict[str, Column]) -> Column:
    """Struct of the amounts with a flag for any of them being stated."""
    known = F.coalesce(*amounts.values()).isNotNull()
    return F.struct(known.alias("has_payment_info"), amounts["monthly"].alias("monthly_payment"),
                    amounts["down"].alias("down_payment"), amounts["total"].alias("total_price"))


def estimated_price(amounts: dict[str, Column], term: int = 48) -> Column:
    """Total price, else down payment + ``term`` monthly payments, else null. 0 is absent."""
    present = lambda c: F.nullif(c, F.lit(0.0))
    financed = present(amounts["monthly"]) * term + F.coalesce(amounts["down"], F.lit(0.0))
    return F.coalesce(present(amounts["total"]), financed)


def financing_en(description: Column) -> Column:
    """Struct of down, monthly, term, APR and stated real price from English text."""
    return F.struct(*[
        number(_without(F.regexp_extract(description, pattern, 1), ",")).alias(name)
        for name, pattern in FINANCING_EN.items()
    ])


def financing_pt(description: Column) -> dict[str, Column]:
    """Down, monthly, term and APR from Portuguese text (1.234,56)."""
    def amount(name: str) -> Column:
        text = F.regexp_extract(description, FINANCING_PT[name], 1)
        text = _without(text, ".") if name != "apr" else text
        return number(F.replace(text, F.lit(","), F.lit(".")))

    found = {name: amount(name) for name in FINANCING_PT}
    return found | {"term_months": found["term_months"].cast("int")}


def real_price_pt(down: Column, monthly: Column, term: Column) -> Column:
    """monthly x term + down when all three are stated and not 0."""
    return F.when((monthly != 0) & (term != 0) & (down != 0), monthly * term + down)


def mentions(description: Column, word: str) -> Column:
    return F.coalesce(F.contains(F.lower(description), F.lit(word)), F.lit(False)).cast("int")


def description_features(description: Column, vin: Column | None = None) -> dict[str, Column]:
    found = {
        "description_length": F.length(description),
        "has_description": description.isNotNull().cast("int"),
        "description_mentions_new": mentions(description, "new"),
        "description_mentions_warranty": mentions(description, "warranty"),
        "description_mentions_clean": mentions(description, "clean"),
    }
    if vin is not None:
        found["has_vin"] = vin.isNotNull().cast("int")
    return found


def transmission_bucket(transmission: Column) -> Column:
    low = F.lower(transmission)
    return F.when(low.like("%manual%"), "Manual").when(low.like("%auto%"), "Automatic").otherwise("Other")


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
