"""All registered queries and their reference SQL."""

from . import dataset_queries, feature_queries, model_queries, monitor_queries, quality_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
