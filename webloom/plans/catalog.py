"""All queries of the engine's corpus operators, with their SQL twins."""

from webloom.plans import collection, corpus, fitted, formats, studies  # noqa: F401  (they register their queries)
from webloom.plans.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
