"""All queries of the library, collected from the plan modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.plans import archive_queries, digest_queries, evaluate_queries, extract_queries, fact_queries, keyed_queries, language_queries, materialise_queries, model_queries, ordered_queries, read_queries, route_queries, search_queries, signal_queries, source_queries, text_queries

FLAGSHIP = "j1_facts_current"
MODULES = (fact_queries, signal_queries, read_queries, text_queries, extract_queries, digest_queries, source_queries, evaluate_queries, keyed_queries, route_queries, archive_queries, materialise_queries, ordered_queries, search_queries, model_queries, language_queries)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
