"""All queries of the library."""

from corpusloom.plans import cleaning, corpus, evaluation, extras, more, series, streams  # noqa: F401
from corpusloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
