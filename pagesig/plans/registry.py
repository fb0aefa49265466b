"""Registry of named queries (Spark) and their DuckDB oracle SQL.

Each query takes (spark, sf_dir) and returns a DataFrame whose columns are aliased exactly like
the oracle's. Queries read the test tables (or data Spark derives from them) in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from pagesig.plans import queries_core  # noqa: F401
    for mod in ("queries_extract", "queries_match", "queries_net", "queries_store"):
        try:
            __import__(f"pagesig.plans.{mod}")
        except ModuleNotFoundError as exc:  # module not written yet
            if mod not in str(exc):
                raise
