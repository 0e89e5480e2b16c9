"""Registered queries of the core and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from siltstone.plans import evidence, findings, more, relational, replies, second_search, streams, texts, views

_ALL = relational.QUERIES | texts.QUERIES | evidence.QUERIES | more.QUERIES | views.QUERIES | findings.QUERIES | replies.QUERIES | second_search.QUERIES | streams.QUERIES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every detail question of every sub-question, from audited claims."""
    return evidence.coverage_by_aspect(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _ALL.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _ALL.items() if sql}
