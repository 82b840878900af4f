"""Filling containers of fixed capacity with whole items: optimal length buckets, token-budget batches inside them, best fit for what is left over.

1. Lengths (tokens of a public tokenizer) are counted into a histogram, which has at most `capacity` + 1 bars, whatever the number of items.
2. Dynamic programming over the histogram chooses bucket bounds that minimise padding, among the shares of the capacity (capacity // k for k items).
3. Batches form inside each bucket: a container starts with the longest length its bucket has left and goes on with the longest that still fit, of this bucket
   alone, up to the token budget. A batch that uses at least `full` of the capacity is closed; lengths that give no such batch are left over.
4. What all buckets left over (the long items that only short ones would complete, and the ends) is filled in the same way over all lengths.
   Both work on the histogram: a pattern of lengths is repeated as often as the scarcest of them allows, so there are few patterns, however many items.
5. The items of each length are numbered (in salted parts, as many as its count asks for) and take their places in the patterns by number.

Items larger than the capacity come in parts of the capacity and a rest; all others stay whole. Only the histogram reaches the driver.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.session import spread, written

TOKENIZER = os.environ.get("QUILLMARK_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value: the public pattern of this vocabulary
_loaded: dict[str, object] = {}
_added: set[tuple[str, str]] = set()
SALT_ROWS = 200_000  # items of one length in one part


def encoding(path: str):
    """A byte-pair encoding from a file of ranks, once a process."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _loaded[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(df: DataFrame, key: str, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """(key, tokens): tokens of whole texts; null texts have none."""
    d = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")))
    kind = d.schema["key"].dataType.simpleString()
    context = df.sparkSession.sparkContext
    if (context.applicationId, tokenizer) not in _added:  # executors need not have the file
        context.addFile(tokenizer)
        _added.add((context.applicationId, tokenizer))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoding(SparkFiles.get(os.path.basename(tokenizer)))
        for b in batches:
            yield pd.DataFrame({"key": b["key"], "tokens": [len(enc.encode_ordinary(t)) if t else 0 for t in b["text"]]})

    return d.mapInPandas(run, f"key {kind}, tokens bigint").withColumnRenamed("key", key)


def optimal_bounds(histogram: dict[int, int], capacity: int, buckets: int) -> list[int]:
    """At most `buckets` upper bounds, the last one `capacity`, that minimise the padding of all items. Bounds are shares capacity // k, so that k items of a
    bucket fill a container. O(shares^2 * buckets) with at most 2 sqrt(capacity) shares."""
    shares = sorted({capacity // k for k in range(1, capacity + 1)} - {0})
    lengths = np.array(sorted(x for x in histogram if 0 < x <= capacity), np.int64)
    if not len(lengths):
        return [capacity]
    counts = np.array([histogram[int(x)] for x in lengths], np.float64)
    n = np.r_[0, np.cumsum(counts)][np.searchsorted(lengths, [0, *shares], side="right")]
    total = np.r_[0, np.cumsum(counts * lengths)][np.searchsorted(lengths, [0, *shares], side="right")]
    m = len(shares)
    # what one item of bound u really costs: its part of a container
    price = np.array([capacity / (capacity // u) for u in shares])
    best = np.full((buckets + 1, m + 1), np.inf)
    from_ = np.zeros((buckets + 1, m + 1), np.int64)
    best[0, 0] = 0
    for b in range(1, buckets + 1):
        for j in range(1, m + 1):
            cost = best[b - 1, :j] + price[j - 1] * (n[j] - n[:j]) - (total[j] - total[:j])
            i = int(np.argmin(cost))
            best[b, j], from_[b, j] = cost[i], i
    b = int(np.argmin(best[:, m]))
    out, j = [], m
    while j:
        out.append(shares[j - 1])
        j, b = int(from_[b, j]), b - 1
    return sorted(out)


def pack(sizes: DataFrame, key: str, size: str, capacity: int = 2048, buckets: int = 24, full: float = 0.98) -> DataFrame:
    """(key, part, first_token, tokens, container_id, bucket): every item in a container, whole unless it is larger than the capacity: then parts 0, 1, ... of at
    most `capacity`, which begin at `first_token` of the item. bucket is the upper bound of the bucket whose batch the container is, null where it was filled
    from what the buckets left over.

    Items of size 0 (empty and null texts) share containers with others like any item, at no cost; null keys are items; repeated keys are separate items;
    an empty table gives no rows. No container holds more than `capacity`."""
    s = sizes.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("n"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n") / capacity)).cast("int")
    cut = s.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    cut = cut.select("key", "part", F.least(F.lit(capacity).cast("bigint"), F.col("n") - F.col("part").cast("bigint") * capacity).alias("tokens"))
    cut = written(cut)
    hist = {r.tokens: r.n for r in cut.groupBy("tokens").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 bars
    placed = _placed(cut, patterns(hist, capacity, buckets, full), {k: -(-n // SALT_ROWS) for k, n in hist.items()})
    return placed.select(F.col("key").alias(key), "part", (F.col("part").cast("bigint") * capacity).alias("first_token"), "tokens", "container_id", "bucket")


def _placed(cut: DataFrame, rows: list[tuple], salts: dict[int, int]) -> DataFrame:
    """Items take their places in the patterns by number; both small tables have a row or a few for each length."""
    spark = cut.sparkSession
    plan = spark.createDataFrame(rows, "tokens bigint, first bigint, times bigint, each bigint, base bigint, bucket int")
    wide = spark.createDataFrame(sorted(salts.items()), "tokens bigint, salts int")
    # numbered by salted parts, then offsets, so that a hot length is no single task
    salted = cut.join(F.broadcast(wide), "tokens").withColumn("salt", F.pmod(F.xxhash64("key", "part"), F.col("salts")).cast("int")).drop("salts")
    numbered = salted.withColumn("i", F.row_number().over(Window.partitionBy("tokens", "salt").orderBy("key", "part")) - 1)
    offs = salted.groupBy("tokens", "salt").agg(F.count("*").alias("n"))
    offs = offs.withColumn("off", F.sum("n").over(Window.partitionBy("tokens").orderBy("salt").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n"))
    placed = numbered.join(offs.select("tokens", "salt", "off"), ["tokens", "salt"]).withColumn("pos", F.col("i") + F.col("off"))
    # a length has few patterns, found by its position
    own = plan.groupBy("tokens").agg(F.sort_array(F.collect_list(F.struct("first", "times", "each", "base", "bucket"))).alias("plan"))
    got = placed.join(F.broadcast(own), "tokens").withColumn("x", F.expr("element_at(filter(plan, x -> x.first <= pos), -1)"))
    within = (F.col("pos") - F.col("x.first")) / F.col("x.each")
    return got.select("key", "part", "tokens", (F.col("x.base") + F.floor(within)).cast("bigint").alias("container_id"), F.col("x.bucket").alias("bucket"))


class _Stock:
    """What is left of each length, and the patterns made of it so far."""

    def __init__(self, hist: dict[int, int], capacity: int):
        self.keys = np.array(sorted(k for k, v in hist.items() if k > 0 and v > 0), np.int64)
        self.count = np.array([hist[int(k)] for k in self.keys], np.int64)
        self.taken = np.zeros(len(self.keys), np.int64)
        self.capacity, self.base, self.out = capacity, 0, []

    def batch(self, live: np.ndarray, top: int) -> tuple[dict[int, int], int]:
        """The lengths (of those `live` says may be used) that fill a container that starts with `top`: the longest that still fit; and its use of room."""
        room, use = self.capacity, {}
        j = top
        while room > 0 and j >= 0:
            fit = np.flatnonzero(live[: j + 1] & (self.count[: j + 1] > 0) & (self.keys[: j + 1] <= room))
            if not len(fit):
                break
            j = int(fit[-1])
            use[j] = min(room // int(self.keys[j]), int(self.count[j]))
            room -= use[j] * int(self.keys[j])
            j -= 1
        return use, self.capacity - room

    def close(self, use: dict[int, int], bucket: int | None) -> None:
        times = min(int(self.count[i]) // k for i, k in use.items())
        for i, k in use.items():
            self.out.append((int(self.keys[i]), int(self.taken[i]), times, k, self.base, bucket))
            self.taken[i] += times * k
            self.count[i] -= times * k
        self.base += times


def patterns(hist: dict[int, int], capacity: int, buckets: int, full: float = 0.98) -> list[tuple]:
    """(length, first position, times, each, container base, bucket): positions first, first + 1, ... of that length go, `each` a container, into the containers
    base, base + 1, ..., base + times - 1."""
    stock = _Stock(hist, capacity)
    lower = 0
    for bound in optimal_bounds(hist, capacity, buckets):
        live = (stock.keys > lower) & (stock.keys <= bound)
        lower = bound
        while (left := np.flatnonzero(live & (stock.count > 0))).size:
            use, used = stock.batch(live, int(left[-1]))
            if used >= full * capacity:
                stock.close(use, bound)
            else:
                live[left[-1]] = False
    every = np.ones(len(stock.keys), bool)
    while (left := np.flatnonzero(stock.count)).size:
        stock.close(stock.batch(every, int(left[-1]))[0], None)
    if zero := int(hist.get(0, 0)):
        stock.out.append((0, 0, max(1, stock.base), -(-zero // max(1, stock.base)), 0, None))
    return stock.out


def waste(packed: DataFrame, capacity: int) -> DataFrame:
    """(containers, tokens, fill, bucket_containers, bucket_padding): how many containers there are, what share of them is used, how many of them are batches of a
    bucket, and what share of those is padding."""
    per = packed.groupBy("container_id").agg(F.sum("tokens").alias("t"), F.max(F.col("bucket").isNotNull()).alias("inside"))
    mine = F.count_if("inside")
    padding = 1 - F.sum(F.when(F.col("inside"), F.col("t"))) / (mine * capacity)
    return per.agg(F.count("*").alias("containers"), F.sum("t").alias("tokens"), (F.sum("t") / (F.count("*") * capacity)).alias("fill"), mine.alias("bucket_containers"), padding.alias("bucket_padding"))
