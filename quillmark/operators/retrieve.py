"""Similarity and ranking of scores of all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import small


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ranked(scores: DataFrame, qid: str, order: list[Column], name: str = "rank", most: int | None = None) -> DataFrame:
    out = scores.withColumn(name, F.row_number().over(Window.partitionBy(qid).orderBy(*order)).cast("bigint"))
    return out if most is None else out.where(F.col(name) <= most)


def best_child(scores: DataFrame, qid: str, parent: Column, name: str) -> DataFrame:
    """(qid, parent, score): a parent scores as its best child."""
    return scores.withColumn(name, parent).groupBy(qid, name).agg(F.max("score").alias("score"))


def zero_filled(scores: DataFrame, qid: str, key: str, questions: DataFrame, universe: DataFrame) -> DataFrame:
    """(qid, key, score, rank) over every parent: those without a score tie at 0 in the order of their key. The whole ranking of every question is the result
    asked for, so its rows are questions times parents."""
    full = universe.select(key).crossJoin(small(questions.select(qid)))
    full = full.join(scores, [qid, key], "left").na.fill({"score": 0.0})
    return ranked(full, qid, [F.desc("score"), F.col(key)])
