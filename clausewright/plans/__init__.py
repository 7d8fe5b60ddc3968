"""Named queries over the test tables."""

from . import analysis_queries, evaluation_queries, flow_queries, ledger_queries, match_queries, retrieval_queries, segment_queries, system_queries, text_queries, upkeep_queries  # noqa: F401
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
