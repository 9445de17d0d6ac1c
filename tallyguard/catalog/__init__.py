"""Registered queries and the SQL that checks them."""

from .registry import ORACLE, QUERIES
from . import (  # noqa: F401  (registration)
    rule_queries,
    clean_queries,
    feature_queries,
    evaluation_queries,
    profile_queries,
    network_queries,
    evidence_queries,
    whatif_queries,
    model_queries,
    report_queries,
    scan_queries,
    sink_queries,
)

__all__ = ["ORACLE", "QUERIES"]
