"""All registered queries; importing this module registers them."""

from brindle.plans import queries_graph, queries_index, queries_ingest, queries_search, queries_store, queries_text  # noqa: F401
from brindle.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
