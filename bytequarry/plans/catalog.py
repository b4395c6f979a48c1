"""All queries of the library by name, with the SQL that says the same."""

from __future__ import annotations

from bytequarry.plans import corpus_queries, graph_queries, jump_queries, label_queries, layer_queries, metric_queries, report_queries, training_queries  # noqa: F401  they register themselves
from bytequarry.plans.registry import ORACLES, QUERIES

FLAGSHIP = "merge_dedup"
__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
