"""Queries of this subpackage, collected from its modules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallywork.llm import collision_ann, decontaminate, line_dedup, ngram_join, periodic_runs, piece_lattice, pii, quality, resampling, sharding, substring_dedup, token_counts, toxicity

MODULES = [substring_dedup, sharding, piece_lattice, collision_ann, decontaminate, pii, token_counts, ngram_join, toxicity, line_dedup, quality, resampling, periodic_runs]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {m.QUERY: m.query for m in MODULES}


def oracle_sql() -> dict[str, str]:
    return {m.QUERY: m.ORACLE_SQL for m in MODULES if m.ORACLE_SQL}
