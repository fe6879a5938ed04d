"""Queries written once in SQL that both engines run."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from . import registry, views


def frames(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views of the tables that ``sql`` names."""
    for name in views.TABLES:
        if re.search(rf"\b{name}\b", sql):
            spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def run(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    full = views.with_views(sql)
    frames(spark, sf_dir, full)
    return spark.sql(full)


def shared(name: str, sql: str, spark_sql: str | None = None) -> None:
    """Register ``sql`` under ``name``; ``spark_sql`` where Spark needs other words."""
    registry.register(name, views.with_views(sql))(lambda spark, sf_dir: run(spark, sf_dir, spark_sql or sql))
