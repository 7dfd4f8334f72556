"""Compilers from small query languages to Spark plans, and the catalogue of queries."""

from sparkloom.plans import analytic_queries, filter_queries, inventory_queries, metric_queries, more_queries, record_queries, source_queries, text_queries, window_queries  # noqa: F401
from sparkloom.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
