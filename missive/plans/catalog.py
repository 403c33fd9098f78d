"""The queries of the core, by name, and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from missive.operators import timestamps
from missive.plans import decision_queries, linking_queries, metric_queries, relational_queries, text_queries  # noqa: F401
from missive.plans.registry import QUERIES, SQL, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timestamps.p7_found(spark, sf_dir)


def queries() -> dict[str, Query]:
    return {"p7_found": timestamps.p7_found, "p7_zones": timestamps.p7_zones, **QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
