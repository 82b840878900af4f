"""The manifest of acquired files: resume predicates, upserts and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], at: str, *tie: str) -> DataFrame:
    """One row a key: the latest, ties by the greatest `tie` columns; nulls lose."""
    order = [F.col(at).desc_nulls_last(), *[F.col(t).desc_nulls_last() for t in tie]]
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def done(manifest: DataFrame) -> DataFrame:
    """Files that need no further pull: done and not empty."""
    return manifest.where((F.col("status") == "done") & (F.coalesce("bytes", F.lit(0)) > 0))


def to_pull(candidates: DataFrame, manifest: DataFrame, keys: list[str], again: bool = False) -> DataFrame:
    """Candidates without a done entry, and, unless `again`, without a failed one."""
    left = candidates.join(done(manifest).select(*keys), keys, "left_anti")
    return left if again else left.join(manifest.where("status = 'failed'").select(*keys), keys, "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace those of `old` with the same key; columns by name."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def status(manifest: DataFrame) -> DataFrame:
    """Files done and failed and their bytes by source, with a TOTAL row."""
    ok, bad = F.count_if(F.col("status") == "done"), F.count_if(F.col("status") == "failed")
    agg = manifest.groupingSets([["source"], []], "source").agg(ok.alias("done"), bad.alias("failed"), F.coalesce(F.sum(F.when(F.col("status") == "done", F.col("bytes"))), F.lit(0)).alias("bytes"), F.grouping_id().alias("g"))
    return agg.select(F.when(F.col("g") == 1, "TOTAL").otherwise(F.col("source")).alias("source"), "done", "failed", "bytes")
