"""Near-duplicate texts: exact Jaccard join over word shingles, size-aware (light sets enumerate
fixed-size subsets, heavy sets scan inverted lists).

Every text becomes the set of its runs of `width` consecutive tokens. Shingles get one global
order, rarest first, by a counting sketch over *all* texts, sized from their number (any order
gives the same result; the sketch only makes the lists short). If two sets a, b reach similarity t,
their overlap is at least o = ceil(t * max(|a|, |b|)), and the first |s| - ceil(t |s|) + c shingles
of each share at least min(c, o): an overlap join with the fixed threshold c (2; up to 12 for
large sets). For it

* light sets (short prefix) emit every c-subset of the prefix: sharing one is enough;
* heavy sets, and light sets that a heavy one may match, emit single shingles into inverted lists,
  which are scanned in the order of size; a pair counts when it was met c times;
* the boundary is the prefix length at which C(p, c) passes the expected cost of list scans, taken
  from the histogram of prefix lengths and from the sketch.

A list that the sketch says is longer than `HOT` is divided by hash into blocks, and every pair of
blocks is a list of its own, so that it spreads over the tasks; each pair of its sets meets in one.
Long lists are compared block against block, short ones all at once by distance.

Postings carry an exclusive-or bitmap of the whole set; its Hamming distance is a lower bound of
the sets' difference, so pairs that cannot reach t are dropped where they are met, exactly.
Copies of one set are one class, so a hot group of copies costs one representative. Candidates
are verified on the whole sets. Nothing is sampled or capped.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.filters import Filter, bloom
from quillmark.llm.shingles import HASH_BITS, M1, blocks, mix, shingle_sets
from quillmark.session import small, spread, written

LEAST_SKETCH, MOST_SKETCH = 16, 24  # bits; at most 16 MB are broadcast
HOT = 1 << 15  # sets in a block of a divided list
LONG = 48  # a list longer than this is compared block against block
SUBSET, MOST_MEETINGS = 2, 12
LOW = np.uint64((1 << HASH_BITS) - 1)
LEVEL_SHIFT = np.uint64(HASH_BITS - 8)
REST = np.uint64((1 << (HASH_BITS - 8)) - 1)


def required(n: np.ndarray) -> np.ndarray:
    """How often a pair must meet whose smaller set has n shingles: 2, and for larger sets up to 12, which costs little longer prefixes and drops most chance pairs."""
    return np.clip(SUBSET + (n - 64) // 16, SUBSET, MOST_MEETINGS)


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    return np.minimum(n, n - np.ceil(t * n - 1e-9).astype(np.int64) + required(n))


def _merged(parts: DataFrame, bits: int, block: int) -> tuple[np.ndarray, int]:
    """Adds up arrays that tasks sent in blocks, block by block, and the sum of all; 2^bits bytes reach the driver, however many tasks there were."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << block, np.int64)
        for b in batches:
            for at, n in zip(b.column("at"), b.column("part")):
                n = np.frombuffer(n.as_buffer(), np.int32)
                total[np.frombuffer(at.as_buffer(), np.uint16) if at.is_valid else slice(None)] += n
        level = np.minimum(255, np.round(8 * np.log2(1 + total))).astype(np.uint8)
        yield pa.RecordBatch.from_pydict({"k": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([level.tobytes()], pa.binary()), "n": pa.array([int(total.sum())])})

    out, n = np.zeros(1 << bits, np.uint8), 0
    for r in parts.groupBy("k").applyInArrow(add, "k int, part binary, n bigint").collect():
        out[r.k << block : (r.k << block) + len(r.part)] = np.frombuffer(r.part, np.uint8)
        n += r.n if r.k < 1 << (bits - block - 1) else 0
    return out, n


def sketch(df: DataFrame, width: int, least: int, t: float, bits: int | None = None, block: int = 16) -> tuple[np.ndarray, np.ndarray, float]:
    """Logarithms (a byte each, 8 a doubling) of how many shingles fall into each of 2^bits buckets, over all rows of df (text), of how many sets have which
    prefix length (65,536 of them, longer ones in the last), and the mean of the buckets. By default about two buckets a row."""
    if bits is None:
        bits = int(min(MOST_SKETCH, max(LEAST_SKETCH, math.ceil(math.log2(1 + df.count())) + 1)))
    size, step = 1 << bits, 1 << block

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, lengths = np.zeros(size, np.int32), np.zeros(step, np.int32)
        for whole in batches:
            for b in blocks(whole):
                key, n = shingle_sets(b.column(0), width, least)
                np.add.at(total, ((key & LOW) >> np.uint64(HASH_BITS - bits)).astype(np.int64), 1)
                lengths += np.bincount(np.minimum(prefix_length(n[n > 0], t), step - 1), minlength=step).astype(np.int32)
        for k in range(size // step + 1):
            part = total[k * step : (k + 1) * step] if k < size // step else lengths
            some = np.flatnonzero(part)
            if len(some):  # whole, or only what is not 0
                sparse = 6 * len(some) < 4 * step
                yield pa.RecordBatch.from_pydict({
                    "k": pa.array([k], pa.int32()), "at": pa.array([some.astype(np.uint16).tobytes() if sparse else None], pa.binary()),
                    "part": pa.array([(part[some] if sparse else part).tobytes()], pa.binary()),
                })

    both, n = _merged(df.mapInArrow(count, "k int, at binary, part binary"), bits + 1, block)
    return both[:size], both[size : size + step], n / size


def divisions(levels: np.ndarray, mean: float, hot: int) -> np.ndarray:
    """Of each bucket the binary logarithm of the number of blocks that its lists are divided into: what it holds beyond the mean may be one list."""
    n = np.exp2(np.arange(256) / 8.0) - 1 - mean
    return np.where(n > max(hot, mean), np.ceil(np.log2(np.maximum(n, 1) / hot)), 0).astype(np.uint8)[levels]


def list_names(hash_: np.ndarray, subset: bool, log_blocks: np.ndarray | None, block: int) -> np.ndarray:
    """Names of the lists that a set's postings go to: 54 bits of hash and whether it is a subset's. Those of a divided list name a pair of blocks and say into how
    many it is divided and whether the two are the same one."""
    name = (hash_ << np.uint64(1)) | np.uint64(subset)
    if log_blocks is None or not log_blocks.any():
        return name
    out = [name[log_blocks == 0]]
    for k in np.flatnonzero(log_blocks).tolist():
        n = 1 << int(log_blocks[k])
        own, other = np.uint64(block % n), np.arange(n, dtype=np.uint64)
        pair = mix(hash_[k] * M1 + (np.minimum(own, other) << np.uint64(32)) + np.maximum(own, other)) >> np.uint64(64 - HASH_BITS)
        out.append((pair << np.uint64(1)) | np.uint64(subset) | (log_blocks[k].astype(np.uint64) << np.uint64(55)) | ((own == other).astype(np.uint64) << np.uint64(60)))
    return np.concatenate(out)


def set_block(h: np.ndarray) -> np.ndarray:
    """The number by which the set named h belongs to a block of a divided list."""
    return (mix(h.view(np.uint64) ^ M1) >> np.uint64(40)).astype(np.int64)


def boundary(lengths: np.ndarray, levels: np.ndarray, c: int = SUBSET) -> int:
    """The prefix length up to which c-subsets cost less than list scans. The expected list is a quarter of the mean bucket of the sketch that a shingle
    of a prefix sees (prefixes hold the rarer ones)."""
    n = np.exp2(lengths / 8.0) - 1
    buckets = np.exp2(levels / 8.0) - 1
    if not buckets.sum():
        return 0
    scan = 1 + np.median(buckets[buckets > 0]) / 4
    p = np.arange(len(n), dtype=np.float64)
    subsets = np.array([math.comb(k, c) for k in range(256)] + [1e18] * max(0, len(n) - 256), dtype=np.float64)[: len(n)]
    gain = np.cumsum(n * (p * scan - 1.5 * subsets))
    return int(np.argmax(gain)) if gain.max() > 0 else 0


def bitmap_bytes(n: int) -> int:
    return 16 if n <= 100 else 32 if n <= 400 else 64


def _xor_bitmaps(h: np.ndarray, starts: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Of each set: bit (hash mod width) toggled by every element."""
    bits = (mix(h) & np.uint64(511)).astype(np.int64)
    table = np.zeros((len(n), 512), np.uint8)
    np.add.at(table, (np.repeat(np.arange(len(n)), n), bits), 1)
    table &= 1
    out = []
    packed = {512: np.packbits(table, axis=1)}
    half = table
    for w in (256, 128):
        half = half[:, :w] ^ half[:, w:]
        packed[w] = np.packbits(half, axis=1)
    for i, k in enumerate(n):
        out.append(packed[8 * bitmap_bytes(int(k))][i].tobytes())
    return out


def signatures(df: DataFrame, width: int, least: int, t: float, levels, limit: int, mean: float = 0.0, hot: int = HOT) -> DataFrame:
    """df (key, text) -> (key, h, n, sigs, bits): h names the set, sigs are its postings. One pass, no shuffle."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.frombuffer(levels.value, np.uint8)
        shift = np.uint64(HASH_BITS - int(math.log2(len(table))))
        logs = divisions(table, mean, hot)
        divided = bool(logs.any())
        seen: set[int] = set()  # sets this task has sent already: a hot group of copies sends its postings about once a task
        for whole in batches:
            if len(seen) > 500_000:
                seen.clear()
            for b in blocks(whole):
                key, n = shingle_sets(b.column(1), width, least)
                has = np.flatnonzero(n)
                if not len(has):
                    continue
                n = n[has]
                s = key & LOW
                starts = np.cumsum(n) - n
                name = mix(np.add.reduceat(mix(s), starts)) ^ np.add.reduceat(mix(s ^ M1), starts)
                bits = _xor_bitmaps(s, starts, n)
                by = np.argsort((key & ~LOW) | (table[(s >> shift).astype(np.int64)].astype(np.uint64) << LEVEL_SHIFT) | (s & REST))
                ordered = s[by]
                p = prefix_length(n, t)
                single = (p > limit) | (prefix_length(np.floor(n / t + 1e-9).astype(np.int64), t) > limit)
                block = set_block(name)
                sigs = []
                for i, h in enumerate(name.tolist()):
                    if h in seen:
                        sigs.append(ordered[:0])
                        continue
                    seen.add(h)
                    x = ordered[starts[i] : starts[i] + p[i]]
                    lb = logs[(x >> shift).astype(np.int64)] if divided else None
                    out = [list_names(x, False, lb, int(block[i]))] if single[i] else []
                    if 1 < p[i] <= limit:
                        a, z = np.triu_indices(int(p[i]), 1)
                        both = mix(x[a] * M1 + x[z]) >> np.uint64(64 - HASH_BITS)
                        out.append(list_names(both, True, np.minimum(lb[a], lb[z]) if divided else None, int(block[i])))
                    sigs.append(np.concatenate(out) if out else x[:0])
                flat = np.concatenate(sigs).view(np.int64)
                offsets = np.zeros(len(n) + 1, np.int32)
                np.cumsum([len(x) for x in sigs], out=offsets[1:])
                yield pa.RecordBatch.from_pydict({
                    "key": b.column(0).take(pa.array(has)), "h": pa.array(name.view(np.int64)), "n": pa.array(n.astype(np.int32)),
                    "sigs": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), "bits": pa.array(bits, pa.binary()),
                })

    return df.mapInArrow(make, f"key {df.schema['key'].dataType.simpleString()}, h bigint, n int, sigs array<bigint>, bits binary")


class Postings:
    """Rows of lists, in the order of list, size and set: list name, size, set, and the set's bitmap at its own width and folded to the narrower ones."""

    def __init__(self, sig: np.ndarray, n: np.ndarray, h: np.ndarray, words: np.ndarray, wide: np.ndarray):
        self.sig, self.n, self.h, self.words, self.wide = sig, n, h, words, wide

    @classmethod
    def read(cls, b: pa.RecordBatch) -> Postings:
        sig, n, h = (b.column(k).to_numpy() for k in range(3))
        raw = b.column(3)
        wide = np.zeros((len(sig), 64), np.uint8)
        offsets = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
        data, size = np.frombuffer(raw.buffers()[2], np.uint8), np.diff(offsets)
        for w in (16, 32, 64):
            i = np.flatnonzero(size == w)
            if len(i):
                wide[i, :w] = data[offsets[i][:, None] + np.arange(w)]
        once = np.ones(len(sig), bool)  # copies of a set lie side by side
        once[1:] = (sig[1:] != sig[:-1]) | (h[1:] != h[:-1])
        return cls(*(x[once] for x in (sig, n, h, size.astype(np.int64) // 8, wide.view(np.uint64))))

    def take(self, i) -> Postings:
        return Postings(self.sig[i], self.n[i], self.h[i], self.words[i], self.wide[i])

    def after(self, first: Postings) -> Postings:
        return Postings(*(np.concatenate(x) for x in zip(first.columns(), self.columns())))

    def columns(self) -> tuple[np.ndarray, ...]:
        return self.sig, self.n, self.h, self.words, self.wide

    def folded(self, k: int) -> np.ndarray:
        """Bitmaps of k words; of use for rows whose own are as wide or wider."""
        x = self.wide
        out = x[:, :k].copy()
        for w in (2, 4, 8):
            if w > k:
                i = np.flatnonzero(self.words == w)
                y = x[i, :w]
                while y.shape[1] > k:
                    y = y[:, : y.shape[1] // 2] ^ y[:, y.shape[1] // 2 :]
                out[i] = y
        return out


def _close(p: Postings, fresh: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(z, y): rows of one list, the later one fresh, that size and bitmap allow to be similar."""
    share = (1 - t) / (1 + t)
    maps = {k: p.folded(k) for k in (2, 4, 8)}
    name = p.sig.view(np.uint64)
    parted = ((name >> np.uint64(55)) & np.uint64(31)).astype(np.int64)  # of a divided list
    parted[((name >> np.uint64(60)) & np.uint64(1)).astype(bool)] = 0  # a block with itself
    block = np.where(parted > 0, set_block(p.h) & ((np.int64(1) << parted) - 1), -1) if parted.any() else None

    first = np.flatnonzero(np.diff(p.sig, prepend=p.sig[:1] - 1))
    length = np.diff(np.r_[first, len(p.sig)])
    is_long = np.repeat(length > LONG, length)
    # short lists, all at once: the earlier row is d before the later one
    live = np.flatnonzero(fresh & ~is_long)
    for d in range(1, LONG + 1):
        live = live[live >= d]
        live = live[(p.sig[live] == p.sig[live - d]) & (p.n[live - d] >= t * p.n[live] - 1e-9)]
        if not len(live):
            break
        z = live[p.h[live] != p.h[live - d]]
        if block is not None:
            z = z[(parted[z] == 0) | (block[z] != block[z - d])]
        y = z - d
        w = np.minimum(p.words[z], p.words[y])
        far = np.zeros(len(z), np.int64)
        for k in (2, 4, 8):
            i = np.flatnonzero(w == k)
            if len(i):
                far[i] = np.bitwise_count(maps[k][z[i]] ^ maps[k][y[i]]).sum(axis=1, dtype=np.int64)
        good = far <= (p.n[z] + p.n[y]) * share + 1e-9
        yield z[good], y[good]
    # long lists, block against block
    for a, m in zip(first[length > LONG].tolist(), length[length > LONG].tolist()):
        new = a + np.flatnonzero(fresh[a : a + m])
        for s in range(0, len(new), 256):
            z = new[s : s + 256]
            low = a + int(np.searchsorted(p.n[a : a + m], t * p.n[z[0]] - 1e-9))
            for y0 in range(low, int(z[-1]), 2048):
                y = np.arange(y0, min(int(z[-1]), y0 + 2048))
                far = np.empty((len(z), len(y)), np.int32)
                for k in (2, 4, 8):
                    c = np.flatnonzero(p.words[y] == k)
                    if len(c):  # sizes grow, so the earlier one's bitmap is the narrower
                        c = slice(int(c[0]), int(c[-1]) + 1)
                        one, two = maps[k][z], maps[k][y[c]]
                        total = np.bitwise_count(one[:, :1] ^ two[:, 0]).astype(np.int16)
                        for x in range(1, k):
                            total += np.bitwise_count(one[:, x : x + 1] ^ two[:, x])
                        far[:, c] = total
                good = far <= (p.n[z][:, None] + p.n[y]) * share + 1e-9
                good &= (y < z[:, None]) & (p.n[y] >= t * p.n[z][:, None] - 1e-9)
                i, j = np.nonzero(good)
                i, j = z[i], y[j]
                ok = p.h[i] != p.h[j]
                if block is not None:
                    ok &= (parted[i] == 0) | (block[i] != block[j])
                yield i[ok], j[ok]


def scan(postings: DataFrame, t: float, partitions: int) -> DataFrame:
    """postings (sig, n, h, bits) -> (a, b, times, need): pairs of sets that meet in a list and that size and bitmap allow, once a list. Lists are streamed in the
    order of size; only the part of the current list that the size bound still reaches is kept."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Postings | None = None
        for b in batches:
            if not b.num_rows:
                continue
            now = Postings.read(b)
            fresh = np.ones(len(now.sig), bool)
            if kept is not None and len(kept.sig) and kept.sig[-1] == now.sig[0]:
                fresh = np.r_[np.zeros(len(kept.sig), bool), fresh]
                now = now.after(kept)
            for z, y in _close(now, fresh, t):
                if len(z):
                    h, other = now.h[z], now.h[y]
                    yield pa.RecordBatch.from_pydict({"a": pa.array(np.minimum(h, other)), "b": pa.array(np.maximum(h, other)), "times": pa.array(np.where(now.sig[z] & 1, MOST_MEETINGS, 1).astype(np.int32)), "need": pa.array(required(now.n[y]).astype(np.int32))})
            kept = now.take((now.sig == now.sig[-1]) & (now.n >= t * now.n[-1] - 1e-9))

    ordered = postings.repartition(partitions, "sig").sortWithinPartitions("sig", "n", "h")
    return ordered.mapInArrow(walk, "a bigint, b bigint, times int, need int")


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = 0.8, width: int = 5, least_tokens: int | None = None, partitions: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs): classes (key, h) names the set of every text of at least `least_tokens` tokens (default: width); pairs (a, b, similarity) are all
    pairs of different sets with a Jaccard similarity of at least `threshold`, a < b.

    Null, empty and shorter texts are in no class. A key with several different texts is in several classes; repeated rows count once. Other columns of df
    are ignored, whatever their names. An empty df gives two empty tables.
    """
    assert 0.5 <= threshold <= 1
    spark = df.sparkSession
    least = width if least_tokens is None else least_tokens
    partitions = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    src = spread(df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("key is not null and text is not null"))
    levels, lengths, mean = sketch(src.select("text"), width, least, threshold)
    limit = boundary(lengths, levels)
    shared = spark.sparkContext.broadcast(levels.tobytes())
    sets = signatures(src, width, least, threshold, shared, limit, mean, HOT)
    postings = sets.select(F.explode("sigs").alias("sig"), "n", "h", "bits")
    met = scan(postings, threshold, partitions)
    pairs = written(met.groupBy("a", "b").agg(F.sum("times").alias("times"), F.max("need").alias("need")).where("times >= need").select("a", "b"))
    classes = written(sets.select("key", "h").distinct())
    return classes, _verified(src, classes, pairs, width, least, threshold)


def _verified(src: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, least: int, t: float) -> DataFrame:
    """The pairs whose whole sets reach t. Sets travel as the low 32 bits of their hashes (two of a pair's few hundred shingles fall together about once in
    100,000 pairs, and then count as one). Only texts that are in a candidate (by a filter of their keys, sized by their number, then exactly) are read into sets again."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct()
    owners = written(classes.groupBy("h").agg(F.min("key").alias("key")).join(wanted, "h").withColumn("kh", F.xxhash64("key")))
    near = bloom(owners.select(F.col("kh").alias("h")), owners.count())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(near.value)
        for whole in batches:
            for b in blocks(whole.take(pa.array(np.flatnonzero(known.maybe(whole.column(1).to_numpy()))))):
                key, n = shingle_sets(b.column(2), width, least)
                has = np.flatnonzero(n)
                if not len(has):
                    continue
                s = key & LOW
                n = n[has]
                starts = np.cumsum(n) - n
                name = mix(np.add.reduceat(mix(s), starts)) ^ np.add.reduceat(mix(s ^ M1), starts)
                offsets = np.r_[0, np.cumsum(n)].astype(np.int32)
                yield pa.RecordBatch.from_pydict({"key": b.column(0).take(pa.array(has)), "h": pa.array(name.view(np.int64)), "s": pa.ListArray.from_arrays(pa.array(offsets), pa.array((s & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32)))})

    kind = src.schema["key"].dataType.simpleString()
    again = src.select("key", F.xxhash64("key").alias("kh"), "text").mapInArrow(read, f"key {kind}, h bigint, s array<int>")
    sets = again.join(owners.select("key", "h"), ["key", "h"], "left_semi").dropDuplicates(["h"]).select("h", "s")
    both = pairs.join(sets.select(F.col("h").alias("a"), F.col("s").alias("sa")), "a").join(sets.select(F.col("h").alias("b"), F.col("s").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    similar = F.col("common") / (F.size("sa") + F.size("sb") - F.col("common"))
    return both.withColumn("common", common).withColumn("similarity", similar).where(F.col("similarity") >= t - 1e-12).select("a", "b", "similarity")


def linked_keys(classes: DataFrame, pairs: DataFrame, whole: int | None = None, block: int = 256) -> DataFrame:
    """Pairs of different keys (key_a < key_b) of similar or equal sets: every one, also inside a class and between all members of two similar classes. A
    class is an equal set, not an equal text, so none of its members stands for another. Classes of more than `block` keys are joined block by block, so
    that the pairs of a hot class spread over the tasks.

    Only if asked for by `whole`, a class of more than `whole` keys gives every key with the class's first key alone, and that one for links outside."""
    of = classes.groupBy("h").agg(F.min("key").alias("rep"), F.count("*").alias("size"))
    inside = of.where("size > 1").select(F.col("h").alias("a"), F.col("h").alias("b"))
    star, shown = None, classes.select("h", "key")
    if whole is not None:
        sized = classes.join(of, "h")
        star = sized.where((F.col("size") > whole) & (F.col("key") != F.col("rep"))).select(F.col("rep").alias("x"), F.col("key").alias("y"))
        shown = sized.where((F.col("size") <= whole) | (F.col("key") == F.col("rep"))).select("h", "key")
    large = written(of.where(F.col("size") > block).select("h", F.ceil(F.col("size") / block).cast("int").alias("blocks")))
    large = small(large)
    part = F.pmod(F.xxhash64("key"), F.coalesce("blocks", F.lit(1))).cast("int")
    members = shown.join(large, "h", "left").select("h", part.alias("part"), "key")
    links = pairs.select("a", "b").unionByName(inside)
    for end in ("a", "b"):
        links = links.join(large.select(F.col("h").alias(end), "blocks"), end, "left").withColumn(f"part_{end}", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1))).drop("blocks")
    ends = lambda c, k: members.select(F.col("h").alias(c), F.col("part").alias(f"part_{c}"), F.col("key").alias(k))
    links = links.where("a != b or part_a <= part_b")
    every = links.join(ends("a", "x"), ["a", "part_a"]).join(ends("b", "y"), ["b", "part_b"]).where("x != y and (a != b or part_a < part_b or x < y)").select("x", "y")
    every = every if star is None else every.unionByName(star)
    return every.select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()


def groups(classes: DataFrame, pairs: DataFrame, rounds: int | None = None) -> DataFrame:
    """(key, group_id, links): connected groups of similar texts; group_id is the least class name, links counts the similar classes. Labels spread along
    links and jump to their label's label, until nothing changes; every round is a written table. If `rounds` bounds them and does not suffice, it raises."""
    edges = written(pairs.select("a", "b").union(pairs.select(F.col("b"), F.col("a"))).distinct())
    degree = edges.groupBy("a").agg(F.count("*").alias("links"))
    label = written(edges.select(F.col("a").alias("h"), F.col("a").alias("l")).distinct())
    done = 0
    while True:
        spread = edges.join(label.select(F.col("h").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        nxt = label.join(spread, label.h == spread.a).select("h", F.least("l", "m").alias("l"))
        jump = nxt.select(F.col("h").alias("l"), F.col("l").alias("j"))
        nxt = written(nxt.join(jump, "l").select("h", F.least("l", "j").alias("l")))
        changed = nxt.join(label.withColumnRenamed("l", "old"), "h").where("l != old").limit(1).count()
        label = nxt
        if not changed:
            break
        done += 1
        if done == rounds:
            raise RuntimeError(f"groups still change after {rounds} rounds")
    return classes.join(label, "h", "left").join(degree, F.col("h") == F.col("a"), "left").select("key", F.coalesce("l", "h").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
