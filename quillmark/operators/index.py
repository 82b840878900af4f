"""Indexes as tables: postings, term statistics, weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import tokens


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf, dl): term counts and the length in tokens of each text; counted inside the row, so nothing is shuffled but equal rows' terms."""
    t = df.select(key, tokens(F.col(text)).alias("t"))
    return t.select(key, F.size("t").cast("bigint").alias("dl"), F.explode("t").alias("term")).groupBy(key, "term", "dl").agg(F.count("*").alias("tf")).select(key, "term", "tf", "dl")


def term_stats(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def corpus_stats(df: DataFrame, text: str) -> DataFrame:
    """One row (n, avgdl): texts (empty ones too) and their mean length in tokens."""
    return df.select(F.size(tokens(F.col(text))).alias("dl")).agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))


def query_terms(q: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, qtf): duplicate query terms count."""
    return q.select(key, F.explode(tokens(F.col(text))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("qtf"))
