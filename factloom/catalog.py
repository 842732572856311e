"""Every query of the engine by name, with the DuckDB SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .plans import canon_queries, form_queries, memory_queries, registry, relational_queries, resolve_queries, span_queries, store_queries, suggest_queries, text_queries  # noqa: F401  registers its queries

QUERIES = registry.QUERIES
ORACLES = registry.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The query that ``entry`` runs."""
    return QUERIES["clause_concepts"](spark, sf_dir)
