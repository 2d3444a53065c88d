"""Registered queries. Importing this package registers them all."""

from . import ingest_queries, product_queries, read_queries, series_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "ingest_queries", "product_queries", "read_queries", "series_queries"]
