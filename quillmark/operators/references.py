"""References to records that do not exist: missing, deleted or late.

References and parents are co-partitioned by key and sorted, and the two streams are merged linearly (sort-merge join; each side is hash-partitioned on the
key once). Parents come as validity intervals, one row a key: from the earliest delivery to the tombstone of the latest one. References are reduced to
distinct ones before the shuffle, and a hot key is split by the engine's skew handling, as the parents' side has one row a key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def trimmed(c: F.Column) -> F.Column:
    """Without white space (of any kind, line breaks included) at both ends."""
    return F.regexp_replace(c, r"(?U)^[\s\p{Z}\x{FEFF}]+|[\s\p{Z}\x{FEFF}]+$", "")


def intervals(parents: DataFrame, key: F.Column, since: str, deleted: str) -> DataFrame:
    """(parent_id, first_seen, deleted): each key's earliest delivery, and whether its latest one is a tombstone (of equally late ones, any)."""
    p = parents.select(key.alias("parent_id"), F.col(since).alias("since"), F.col(deleted).isNotNull().alias("gone")).where("parent_id is not null")
    agg = p.groupBy("parent_id").agg(F.min("since").alias("first_seen"), F.max(F.struct("since", "gone")).alias("last"))
    return agg.select("parent_id", "first_seen", F.col("last.gone").alias("deleted"))


def references(df: DataFrame, id_col: str, fields: list[str], at: str) -> DataFrame:
    """(id, field, parent_id, added_at): the distinct references; of a record delivered more than once, the earliest delivery counts as its time."""
    keep = df.select(F.col(id_col).alias("id"), F.col(at).alias("added_at"), *[F.col(f).alias(f"f{i}") for i, f in enumerate(fields)]).where("id is not null")
    packed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"f{i}").alias("keys")) for i, f in enumerate(fields)])
    flat = keep.select("id", "added_at", F.explode(packed).alias("x")).select("id", "added_at", "x.field", F.explode("x.keys").alias("parent_id"))
    flat = flat.where("parent_id is not null").withColumn("parent_id", trimmed(F.col("parent_id")))
    return flat.groupBy("id", "field", "parent_id").agg(F.min("added_at").alias("added_at"))


def orphans(refs: DataFrame, parents: DataFrame) -> DataFrame:
    """(id, field, parent_id, state, added_at): references (of `references`) whose parent (of `intervals`) is missing, else deleted, else late: first seen
    after the reference was added. Null times are never late. An empty parents table makes every reference missing; empty references give no rows; an empty
    string is a reference like any other."""
    joined = refs.hint("merge").join(parents.withColumn("there", F.lit(True)), "parent_id", "left")
    state = F.when(F.col("there").isNull(), "missing").when(F.col("deleted"), "deleted").when(F.col("first_seen") > F.col("added_at"), "late")
    return joined.withColumn("state", state).where("state is not null").select("id", "field", "parent_id", "state", "added_at")


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphans counted by field, month of added_at and state."""
    return found.groupBy("field", F.date_format(F.date_trunc("month", "added_at"), "yyyy-MM").alias("month"), "state").agg(F.count("*").alias("refs"), F.count_distinct("id").alias("records"))
