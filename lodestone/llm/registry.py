"""Queries of this subpackage: the thin ``opN_<name>`` form of each operator, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import common
from lodestone.llm.queries import ORACLES, QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """``name -> (spark, sf_dir) -> DataFrame`` of every query here."""

    def bound(build):
        def query(spark: SparkSession, sf_dir: str) -> DataFrame:
            common.ship(spark)
            return build(spark, sf_dir)

        return query

    return {name: bound(build) for name, build in {**QUERIES, "pipeline": corpus_pipeline.run}.items()}


def oracle_sql() -> dict[str, str]:
    """The DuckDB statement of every query here that SQL can express."""
    return dict(ORACLES) if corpus_pipeline.ORACLE_SQL is None else {**ORACLES, "pipeline": corpus_pipeline.ORACLE_SQL}
