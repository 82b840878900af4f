"""A table of vectors as a retriever."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.retrieve import dot, ranked


@dataclass
class DenseStore:
    """Vectors (key, parent, embedding) compared by cosine with a set of queries that is small and checked: each vector meets all queries in one pass. Exact, and so for
    collections of any size as long as the queries are few; all vectors against all are searched by lists elsewhere."""

    rows: DataFrame
    key: str
    parent: str
    embedding: str
    most_queries: int = 10_000

    def scores(self, queries: DataFrame) -> DataFrame:
        """(qid, key, parent, score), to 6 places; queries: (qid, vector). Vectors of another length than the query's, with nulls or without a direction have no row."""
        n = queries.count()
        if n > self.most_queries:
            raise ValueError(f"{n} queries are too many to meet every vector")
        v, q = F.col("_v"), F.col("_q")
        rows = self.rows.select(F.col(self.key).alias("key"), F.col(self.parent).alias("parent"), F.col(self.embedding).alias("_v")).where(~F.exists("_v", lambda x: x.isNull()))
        rows = rows.withColumn("_n", F.sqrt(dot(v, v))).where((F.col("_n") > 0) & (F.col("_n") < float("inf")) & ~F.isnan("_n"))
        asked = queries.select("qid", F.col("vector").alias("_q"), F.sqrt(dot(F.col("vector"), F.col("vector"))).alias("_m"))
        both = rows.join(F.broadcast(asked), F.size("_v") == F.size("_q"))
        return both.select("qid", "key", "parent", F.round(dot(v, q) / (F.col("_n") * F.col("_m")), 6).alias("score"))

    def retrieve(self, queries: DataFrame, k: int) -> DataFrame:
        """The k best vectors of each query, ties by key."""
        return ranked(self.scores(queries), "qid", [F.desc("score"), F.col("key")], most=k)

    def parents(self, queries: DataFrame) -> DataFrame:
        """The whole ranking of parents by their best vector, ties by parent."""
        best = self.scores(queries).groupBy("qid", "parent").agg(F.max("score").alias("score"))
        return ranked(best, "qid", [F.desc("score"), F.col("parent")])


def signatures(df: DataFrame, key: str, vector: str, tables: int, bits: int, seed: int = 5) -> DataFrame:
    """(key, tbl, bucket): of each vector and table the side of `bits` random hyperplanes it is on."""
    d = df.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v")).where("size(v) > 0")
    kind = d.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for b in batches:
            col = b.column(1)
            at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
            flat = col.values.to_numpy(zero_copy_only=False)
            for dim in np.unique(np.diff(at)):
                i = np.flatnonzero(np.diff(at) == dim)
                x = np.nan_to_num(flat[at[i][:, None] + np.arange(dim)])
                if dim not in planes:
                    planes[dim] = np.random.default_rng(seed).standard_normal((dim, tables * bits))
                side = (x @ planes[dim] > 0).reshape(len(i), tables, bits)
                bucket = (side * (1 << np.arange(bits))).sum(axis=2)
                yield pa.RecordBatch.from_pydict({"key": b.column(0).take(pa.array(np.repeat(i, tables))), "tbl": pa.array(np.tile(np.arange(tables, dtype=np.int32), len(i))), "bucket": pa.array(bucket.ravel().astype(np.int64))})

    return d.mapInArrow(run, f"key {kind}, tbl int, bucket bigint")


def approximate(df: DataFrame, queries: DataFrame, key: str, vector: str, k: int = 10, tables: int = 48, bits: int = 5) -> DataFrame:
    """(qid, key, score, rank): the k most similar of the vectors that share a bucket with the query in any table, by their real cosine; the query's own key is left
    out. More tables find more, more bits compare less."""
    asked = signatures(queries, "qid", "vector", tables, bits).withColumnRenamed("key", "qid")
    met = signatures(df, key, vector, tables, bits).join(asked, ["tbl", "bucket"]).select("qid", "key").where("key != qid").distinct()
    both = met.join(df.select(F.col(key).alias("key"), F.col(vector).alias("_v")), "key").join(queries.select("qid", F.col("vector").alias("_q")), "qid")
    cosine = dot(F.col("_v"), F.col("_q")) / F.sqrt(dot(F.col("_v"), F.col("_v")) * dot(F.col("_q"), F.col("_q")))
    return ranked(both.select("qid", "key", F.round(cosine, 6).alias("score")), "qid", [F.desc("score"), F.col("key")], most=k)
