"""All named queries over the test tables and their SQL oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bathyal.plans import areas, buildings, bundle, cloth, cylinders, display, exchange, geometry, linear, marks, robust, sandwave, survey, terrain, tin  # noqa: F401  they register their queries
from bathyal.plans.registry import ORACLES, QUERIES, Query


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth estimates from competing hypotheses at every node of a grid."""
    return survey.cube_density(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
