"""All registered queries of the core and their SQL."""

from lumisift.plans import contract_queries, feature_queries, score_queries
from lumisift.plans.queries import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "contract_queries", "feature_queries", "score_queries"]
