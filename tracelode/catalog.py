"""All queries of the library by name, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import aggregates, batteries, kernels, scores, structure, texts

_PARTS = (structure.R, aggregates.R, scores.R, texts.R, kernels.R, batteries.R)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Structural violations per rule."""
    return structure.R.queries["t0_rules"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for part in _PARTS for k, f in part.queries.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for part in _PARTS for k, s in part.sql.items()}
