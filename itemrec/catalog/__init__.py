"""All registered queries."""

from itemrec.catalog import aggregates, clusters, filters, functions, joins, products, scans, streams, topk, windows  # noqa: F401
from itemrec.catalog.registry import ORACLES, QUERIES, expand

__all__ = ["ORACLES", "QUERIES", "expand"]
