"""Fusing and reranking rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.operators.retrieve import ranked


def reciprocal(a: DataFrame, b: DataFrame, qid: str, key: str, c: int = 60, wa: float = 1.0, wb: float = 1.0, fill: bool = False) -> DataFrame:
    """(qid, key, score) from two rankings (qid, key, rank): the sum of w / (c + rank). With `fill`, a key missing on a side has that side's length + 1 as rank;
    else that side adds nothing."""
    x, y = a.select(qid, key, F.col("rank").alias("ra")), b.select(qid, key, F.col("rank").alias("rb"))
    both = x.join(y, [qid, key], "full_outer")
    if fill:
        w = Window.partitionBy(qid)  # the lists' lengths, read off the joined rows
        both = both.withColumn("na", F.max("ra").over(w)).withColumn("nb", F.max("rb").over(w))
        ra, rb = F.coalesce("ra", F.coalesce("na", F.lit(0)) + 1), F.coalesce("rb", F.coalesce("nb", F.lit(0)) + 1)
        score = wa / (c + ra) + wb / (c + rb)
    else:
        score = F.coalesce(wa / (c + F.col("ra")), F.lit(0.0)) + F.coalesce(wb / (c + F.col("rb")), F.lit(0.0))
    return both.select(qid, key, F.round(score, 10).alias("score"))


def reciprocal_columns(scores: DataFrame, qid: str, key: str, a: str, b: str, c: int = 60, fill: bool = False) -> DataFrame:
    """(qid, key, score): the same of two columns of scores of one table, null where a ranking lacks the key; ranks are by score, then key."""
    w = Window.partitionBy(qid)
    ranked_ = scores
    for x in (a, b):
        place = F.row_number().over(w.orderBy(F.col(x).desc_nulls_last(), F.col(key)))
        ranked_ = ranked_.withColumn(f"r_{x}", F.when(F.col(x).isNotNull(), place)).withColumn(f"n_{x}", F.count(x).over(w))
    part = lambda x: 1.0 / (c + F.coalesce(f"r_{x}", F.col(f"n_{x}") + 1)) if fill else F.coalesce(1.0 / (c + F.col(f"r_{x}")), F.lit(0.0))
    return ranked_.select(qid, key, F.round(part(a) + part(b), 10).alias("score"))


def head_tail(order: DataFrame, rescored: DataFrame, qid: str, key: str) -> DataFrame:
    """(qid, key, score, rank): rescored keys first by their new scores, then the rest in their old order with score 0; scores of the two are never mixed."""
    head = ranked(rescored, qid, [F.desc("score"), F.col(key)], "pos").select(qid, key, "score", F.lit(0).alias("segment"), "pos")
    tail = order.join(rescored.select(qid, key), [qid, key], "left_anti").select(qid, key, F.lit(0.0).alias("score"), F.lit(1).alias("segment"), F.col("rank").alias("pos"))
    return ranked(head.unionByName(tail), qid, [F.col("segment"), F.col("pos")]).select(qid, key, "score", "rank")


def first_seen(children: DataFrame, qid: str, parent: Column, name: str) -> DataFrame:
    """(qid, parent, best_rank, score): parents by the best rank of a child, scored 1 / rank."""
    return children.withColumn(name, parent).groupBy(qid, name).agg(F.min("rank").alias("best_rank")).withColumn("score", F.round(1.0 / F.col("best_rank"), 10))
