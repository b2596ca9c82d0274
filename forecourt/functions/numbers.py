"""Number helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HALF_CENT_GUARD = 1e-8


def half_up(value: Column | str, places: int = 2) -> Column:
    """Round half up. The guard keeps a half cent from falling either way with the
    order in which a distributed sum happened to be added."""
    c = F.col(value) if isinstance(value, str) else value
    return F.round(c + F.lit(HALF_CENT_GUARD), places)


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null where bottom is 0 or null."""
    return top / F.nullif(bottom.cast("double"), F.lit(0.0))


def number(text: Column) -> Column:
    """Text to double; unreadable or empty text gives null."""
    return F.nullif(text, F.lit("")).try_cast("double")
