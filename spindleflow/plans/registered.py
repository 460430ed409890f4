"""Imports every query module so that the registry is complete."""

from spindleflow.plans import live_queries, metric_queries, model_queries, run_queries, scalar_queries, sequence_queries, signal_queries, source_queries, table_queries
from spindleflow.plans.catalog import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "flagship", "live_queries", "metric_queries", "model_queries", "run_queries", "scalar_queries", "sequence_queries", "signal_queries", "source_queries", "table_queries"]


def flagship(spark, folder):
    """The early-warning report, this engine's headline query."""
    return QUERIES["early_warning_report"](spark, folder)
