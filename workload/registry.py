"""All registered queries and oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators.score import scored
from quillspark.plans.review import review_rows

from . import document_queries, ops_queries, rule_queries, store_queries
from .drafts import documents


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(review_rows(documents(spark, sf_dir))).select(
        "doc_id", "profile_id", "score", "readiness", "n_issues", "n_severe", "n_fixable")


def queries() -> dict:
    return {**rule_queries.queries(), **document_queries.queries(), **store_queries.queries(), **ops_queries.queries()}


def oracles() -> dict[str, str]:
    return {**rule_queries.oracles(), **document_queries.oracles(), **store_queries.oracles(), **ops_queries.oracles()}
