"""Scores of many questions against many texts, inside the text's row: a forward index has every text's distinct terms with their counts, the terms of a block of
questions travel to it, and what leaves a task are scores, reduced to parents or to the best of each question. Nothing is joined on a term.

Terms are named by 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.functions.text import tokens
from quillmark.session import written

BLOCK = 256  # questions a block: their terms' weights are in every task
MOST_WEIGHTS = 5_000_000  # question terms that are collected at once; more of them block by block
MOST_TERMS = 4_000_000  # up to so many terms the inverse document frequencies are broadcast for the norms, beyond they are joined
ROWS = 256
K1, B = 1.5, 0.75


def hashed(c: F.Column) -> F.Column:
    return F.transform(c, lambda x: F.xxhash64(x))


def flat(col: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list column."""
    at = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    return at - at[0], col.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].astype(kind, copy=False)


def forward(df: DataFrame, key: str, parent: str, terms: F.Column) -> DataFrame:
    """(key, parent, dl, terms, tf): of each row the hashes of its distinct terms and how often they occur, counted in the row."""
    d = df.select(F.col(key).alias("key"), F.col(parent).alias("parent"), hashed(terms).alias("t"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for z in range(0, b.num_rows, 2048):
                c = b.slice(z, 2048)
                at, t = flat(c.column(2), np.int64)
                dl = np.diff(at)
                row = np.repeat(np.arange(len(dl)), dl)
                by = np.lexsort((t, row))
                t, row = t[by], row[by]
                new = np.ones(len(t), bool)
                new[1:] = (t[1:] != t[:-1]) | (row[1:] != row[:-1])
                first = np.flatnonzero(new)
                tf = np.diff(np.r_[first, len(t)]).astype(np.int32)
                ends = pa.array(np.searchsorted(row[first], np.arange(len(dl) + 1)).astype(np.int32))
                yield pa.RecordBatch.from_pydict({
                    "key": c.column(0), "parent": c.column(1), "dl": pa.array(dl),
                    "terms": pa.ListArray.from_arrays(ends, pa.array(t[first])), "tf": pa.ListArray.from_arrays(ends, pa.array(tf)),
                })

    kinds = [d.schema[k].dataType.simpleString() for k in ("key", "parent")]
    return d.mapInArrow(count, f"key {kinds[0]}, parent {kinds[1]}, dl bigint, terms array<bigint>, tf array<int>")


@dataclass
class Index:
    """A written forward index, its terms' document frequencies as a written table (h, df), how many texts there are and their mean length."""

    rows: DataFrame
    stats: DataFrame
    n: int
    avgdl: float
    _normed: tuple | None = None

    @classmethod
    def build(cls, df: DataFrame, key: str, parent: str, text: str) -> Index:
        rows = written(forward(df, key, parent, tokens(F.col(text))))
        stats = written(rows.select(F.explode("terms").alias("h")).groupBy("h").agg(F.count("*").alias("df")))
        one = rows.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl")).first()
        return cls(rows, stats, one.n, one.avgdl or 1.0)

    def idf(self, mode: str) -> F.Column:
        n, df = F.lit(float(self.n)), F.col("df")
        if mode == "tfidf":
            return F.log((1 + n) / (1 + df)) + 1
        if mode == "okapi":
            return F.log((n - df + 0.5) / (df + 0.5))
        return F.log(1 + (n - df + 0.5) / (df + 0.5))

    def normed(self) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray] | None]:
        """The rows for TF-IDF and, where the terms are few enough, all their inverse document frequencies; else the rows have a norm joined to them."""
        if self._normed is None:
            self._normed = self._find_norms()
        return self._normed

    def _find_norms(self) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray] | None]:
        if self.stats.count() <= MOST_TERMS:
            got = self.stats.select("h", self.idf("tfidf").alias("idf")).toPandas().sort_values("h")  # at most MOST_TERMS rows
            return self.rows, (got["h"].to_numpy(np.int64), got["idf"].to_numpy(np.float64))
        post = self.rows.select("key", "dl", F.explode(F.arrays_zip("terms", "tf")).alias("x")).select("key", "dl", F.col("x.terms").alias("h"), F.col("x.tf").alias("tf"))
        w = F.col("tf") / F.col("dl") * F.col("idf")
        norm = post.join(self.stats.select("h", self.idf("tfidf").alias("idf")), "h").groupBy("key").agg(F.sqrt(F.sum(w * w)).alias("norm"))
        return self.rows.join(norm, "key", "left"), None

    def scores(self, q: DataFrame, mode: str | tuple[str, ...], by: str = "key", most: int | None = None) -> DataFrame:
        """(qid, key or parent, score), rounded to 6 places, of questions q (qid, term, qtf) in any number: in blocks of BLOCK. With several modes, one pass gives a
        column for each, named like it, null where that mode has no score.

        mode: "bm25", "okapi" (frequent terms weigh a quarter of the mean), "tfidf" (cosine), "any" (a tenth for each position that matches), "all" (only texts
        with every term of the question), "share" (of the question's distinct terms). by "parent": a parent scores as its best text. With `most`, at least the
        `most` best of each question, and ties, are given."""
        terms = q.select("qid", F.xxhash64("term").alias("h"), F.col("qtf").cast("double").alias("qtf"))
        kind = terms.schema["qid"].dataType.simpleString()
        rows = terms.limit(MOST_WEIGHTS + 1).collect()
        if len(rows) <= MOST_WEIGHTS:
            ids = sorted({r.qid for r in rows})
            number = {x: k // BLOCK for k, x in enumerate(ids)}
            blocks: list = [[] for _ in range(0, max(1, len(ids)), BLOCK)]
            for r in rows:
                blocks[number[r.qid]].append(r)
        else:
            terms = written(terms)
            ids = [r.qid for r in terms.select("qid").distinct().orderBy("qid").collect()]  # the questions' ids
            blocks = [terms.where(F.col("qid").isin(ids[k : k + BLOCK])) for k in range(0, len(ids), BLOCK)]
        modes = (mode,) if isinstance(mode, str) else mode
        mean = self.stats.agg(F.avg(self.idf("okapi"))).first()[0] if "okapi" in modes else 0.0
        source, every = self.normed() if "tfidf" in modes else (self.rows, None)
        out = None
        for block in blocks:
            one = self._block(source, every, block if isinstance(block, list) else block.collect(), kind, modes, mean, by, most if len(modes) == 1 else None)
            out = one if out is None else out.unionByName(one)
        return out

    def _block(self, rows: DataFrame, every, got: list, kind: str, modes: tuple[str, ...], mean: float, by: str, most: int | None) -> DataFrame:
        spark = rows.sparkSession
        wanted = F.broadcast(spark.createDataFrame([(h,) for h in sorted({r.h for r in got})], "h bigint"))  # of at most BLOCK questions
        df = {r.h: r for r in self.stats.join(wanted, "h").select("h", *[self.idf(m).alias(m) for m in modes]).collect()}
        qids = sorted({r.qid for r in got})
        number = {x: j for j, x in enumerate(qids)}
        vocabulary = np.array(sorted(df), np.int64)
        place = {h: v for v, h in enumerate(vocabulary.tolist())}
        need = np.zeros(len(qids))
        for r in got:
            need[number[r.qid]] += 1
        lists = []
        for mode in modes:
            weight = np.zeros((len(vocabulary), len(qids)))  # of at most BLOCK questions' terms
            for r in got:
                if r.h in place:
                    idf = df[r.h][mode]
                    w = {"any": 0.1, "all": 1.0, "share": 1.0}.get(mode) or r.qtf * (0.25 * mean if mode == "okapi" and idf < 0 else idf)
                    weight[place[r.h], number[r.qid]] += w
            if mode == "tfidf":
                size = np.sqrt((weight * weight).sum(axis=0))
                weight /= np.where(size > 0, size, 1)
            elif mode == "share":
                weight /= np.maximum(need, 1)
            v, j = np.nonzero(weight)
            # of each term its questions and their weights
            lists.append((np.searchsorted(v, np.arange(len(vocabulary) + 1)), j, weight[v, j], np.array([df[h][mode] for h in vocabulary.tolist()])))
        shared = spark.sparkContext.broadcast((qids, vocabulary, lists, need, every))
        avgdl, column, parents = self.avgdl, 0 if by == "key" else 1, by == "parent"
        most = None if parents else most  # a parent may stand in several batches
        labels = ["score"] if len(modes) == 1 else list(modes)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, vocabulary, lists, need, every = shared.value
            if not len(vocabulary):
                return
            names = pa.array(qids)
            floor = np.full(len(qids), -np.inf)
            best = np.full((len(qids), most), -np.inf) if most else None
            for whole in batches:
                for z in range(0, whole.num_rows, ROWS):
                    b = whole.slice(z, ROWS)
                    at, t = flat(b.column(3), np.int64)
                    tf = flat(b.column(4), np.float64)[1]
                    dl = b.column(2).to_numpy().astype(np.float64)
                    row = np.repeat(np.arange(len(dl)), np.diff(at))
                    v = np.minimum(np.searchsorted(vocabulary, t), len(vocabulary) - 1)
                    hit = np.flatnonzero(vocabulary[v] == t)
                    if not len(hit):
                        continue
                    v, r, n = v[hit], row[hit], tf[hit]
                    who, own = np.unique(r, return_inverse=True)
                    if parents:  # children of a parent lie side by side
                        name = b.column(column).take(pa.array(who)).to_numpy(zero_copy_only=False)
                        runs = np.flatnonzero(np.r_[True, name[1:] != name[:-1]])
                    found = []
                    for mode, (begin, asked, weight, idf) in zip(modes, lists):
                        if mode in ("bm25", "okapi"):
                            w = n * (K1 + 1) / (n + K1 * (1 - B + B * dl[r] / avgdl))
                        elif mode == "tfidf":
                            if every is None:
                                norm = b.column(5).to_numpy(zero_copy_only=False)
                            else:
                                x = tf / dl[row] * every[1][np.searchsorted(every[0], t)]
                                norm = np.sqrt(np.bincount(row, x * x, len(dl)))
                            w = n / dl[r] * idf[v] / norm[r]
                        else:
                            w = n if mode == "any" else np.ones(len(n))
                        # of every hit the questions with its term, added up by text and question
                        many = np.diff(begin)[v]
                        at = np.arange(many.sum()) + np.repeat(begin[v] - (np.cumsum(many) - many), many)
                        score = np.bincount(np.repeat(own * len(qids), many) + asked[at], weight[at] * np.repeat(w, many), len(who) * len(qids)).reshape(len(who), len(qids))
                        score[~(score >= need - 1e-9) if mode == "all" else score == 0] = -np.inf
                        found.append(np.maximum.reduceat(score, runs, axis=0) if parents else score)
                    if parents:
                        who = who[runs]
                    keep = np.any([x > -np.inf for x in found], axis=0)
                    if most:
                        keep &= found[0] >= floor - 2e-6
                        best = np.sort(np.concatenate([best, np.where(keep, found[0], -np.inf).T], axis=1), axis=1)[:, -most:]
                        floor = best[:, 0]
                    i, j = np.nonzero(keep)
                    if len(i):
                        columns = [pa.array(x[i, j], mask=x[i, j] == -np.inf) for x in found]
                        yield pa.RecordBatch.from_arrays([names.take(pa.array(j)), b.column(column).take(pa.array(who[i])), *columns], ["qid", by, *labels])

        kinds = kind, rows.schema[by].dataType.simpleString()
        out = rows.mapInArrow(run, f"qid {kinds[0]}, {by} {kinds[1]}, " + ", ".join(f"{x} double" for x in labels))
        if parents:  # by question at once, as the rankings are: one exchange for both
            out = out.repartition("qid").groupBy("qid", by).agg(*[F.max(x).alias(x) for x in labels])
        return out.select("qid", by, *[F.round(x, 6).alias(x) for x in labels])
