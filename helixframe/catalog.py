"""All queries of the engine's own operators over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries_intervals, queries_model, queries_text
from .plans.adapters import oracle

_MODULES = (queries_text, queries_intervals, queries_model)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: spec[0] for m in _MODULES for name, spec in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle(spec[1]) for m in _MODULES for name, spec in m.QUERIES.items() if spec[1]}
