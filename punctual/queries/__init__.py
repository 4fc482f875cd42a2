"""All registered queries."""

from punctual.queries import cleaning, evaluation, exploration, features, loading, models, monitoring, streams
from punctual.queries.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
