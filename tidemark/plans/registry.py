"""Queries of the market engine and their SQL, collected from the query modules."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("candle_queries", "indicator_queries", "portfolio_queries", "quality_queries", "market_queries", "price_queries", "view_queries", "allocation_queries", "desk_queries", "rule_queries", "source_queries", "book_queries", "label_queries", "sequence_queries", "tree_queries", "validation_queries", "stream_queries", "ingestion_queries", "scalar_queries", "candidate_queries")


def _collect(name: str) -> dict:
    out: dict = {}
    for module in MODULES:
        own = getattr(import_module(f"tidemark.plans.{module}"), name)
        assert not out.keys() & own.keys(), f"{module} repeats a query"
        out |= own
    return out


def queries() -> dict[str, Query]:
    return _collect("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _collect("SQL")
