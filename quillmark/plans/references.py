"""Queries on references between tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.operators import references as R
from quillmark.session import table

FIELDS = ["relevant_parent_ids", "relevant_parent_ids_s3"]


def _orphans(spark: SparkSession, sf: str) -> DataFrame:
    refs = R.references(table(spark, sf, "qa"), "id", FIELDS, "added_at")
    parents = R.intervals(table(spark, sf, "sections"), F.concat_ws("#", "source", "section_idx"), "ingested_at", "deleted_at")
    return R.orphans(refs, parents)


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return _orphans(spark, sf).select("id", "field", "parent_id", "state")


def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    return R.orphan_report(_orphans(spark, sf))


_BASE = """
WITH r AS (
  SELECT id, field, regexp_replace(x, '^[\\s\\x{00A0}\\x{FEFF}]+|[\\s\\x{00A0}\\x{FEFF}]+$', '', 'g') AS parent_id, min(added_at) AS added_at
  FROM (SELECT id, added_at, 'relevant_parent_ids' AS field, unnest(relevant_parent_ids) AS x FROM qa
        UNION ALL SELECT id, added_at, 'relevant_parent_ids_s3', unnest(relevant_parent_ids_s3) FROM qa)
  WHERE x IS NOT NULL AND id IS NOT NULL GROUP BY 1, 2, 3),
p AS (
  SELECT parent_id, min(ingested_at) AS first_seen, bool_or(deleted_at IS NOT NULL) FILTER (WHERE ingested_at = last) AS deleted
  FROM (SELECT source || '#' || section_idx AS parent_id, ingested_at, deleted_at, max(ingested_at) OVER (PARTITION BY source || '#' || section_idx) AS last FROM sections)
  GROUP BY 1),
o AS (
  SELECT r.id, r.field, r.parent_id, r.added_at,
    CASE WHEN p.parent_id IS NULL THEN 'missing' WHEN p.deleted THEN 'deleted' WHEN p.first_seen > r.added_at THEN 'late' END AS state
  FROM r LEFT JOIN p ON r.parent_id = p.parent_id)
"""
QUERIES = {"p7_found": p7_found, "p7_report": p7_report}
SQL = {
    "p7_found": _BASE + "SELECT id, field, parent_id, state FROM o WHERE state IS NOT NULL",
    "p7_report": _BASE + "SELECT field, strftime(added_at, '%Y-%m') AS month, state, count(*) AS refs, count(DISTINCT id) AS records FROM o WHERE state IS NOT NULL GROUP BY 1, 2, 3",
}
