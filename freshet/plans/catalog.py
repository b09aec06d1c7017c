"""All registered queries, gathered from the query modules."""

from freshet.plans import learning_queries, model_queries, panel_queries, window_queries  # noqa: F401
from freshet.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
