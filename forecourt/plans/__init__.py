"""Named queries: each module registers its own."""

from forecourt.plans import cleaning, features, financing, market, modelling, quality, series  # noqa: F401
from forecourt.plans.registry import ENTRIES

__all__ = ["ENTRIES"]
