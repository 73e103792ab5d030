"""All registered queries."""

from tickloom.plans import (  # noqa: F401
    captures, lookups, reports, searches, sequences, similarity, stores, streams, trees,
)
from tickloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
