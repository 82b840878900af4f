"""Index tables in the catalogue: building, statistics and checks of plans."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def collection_name(prefix: str, model: str) -> str:
    return f"{prefix}__{re.sub('[^a-z0-9_]', '_', model.lower())}"


def create_database(spark: SparkSession, name: str, reset: bool = False) -> None:
    if reset:
        spark.sql(f"DROP DATABASE IF EXISTS `{name}` CASCADE")
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def build(spark: SparkSession, database: str, table: str, df: DataFrame, key: str, buckets: int = 16) -> None:
    """Writes a table bucketed and sorted by its lookup key, once: later joins on the key shuffle only the other side."""
    if not spark.catalog.tableExists(f"{database}.{table}"):
        df.write.bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(f"{database}.{table}")


def analyze(spark: SparkSession, database: str, table: str) -> None:
    spark.sql(f"ANALYZE TABLE `{database}`.`{table}` COMPUTE STATISTICS FOR ALL COLUMNS")


def plan_of(df: DataFrame) -> str:
    return df._jdf.queryExecution().toString()


def checks(spark: SparkSession, found: list[tuple[str, int, int, str]]) -> DataFrame:
    """(name, got, want, ok) of (name, got, want, '==' or '>=')."""
    rows = [(n, g, w, g == w if op == "==" else g >= w) for n, g, w, op in found]
    return spark.createDataFrame(rows, "name string, got bigint, want bigint, ok boolean")


def candidates(k: int, depth: int) -> int:
    """How many candidates a search keeps: never fewer than it has to return."""
    return max(k, depth)
