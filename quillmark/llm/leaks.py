"""Held-out passages inside training text: character q-gram lemma in diagonal bands, then banded alignment.

Both sides are reduced to their tokens (runs of a-z and 0-9 of the lower-cased text) with single spaces, a space before the first and after the last. A
passage is a run of `tokens` tokens of an item; L is the length of the item's shortest passage. A region of a document within e edits of a passage shares
at least L - q + 1 - q e of the passage's q-grams on diagonals at most e apart. So:

1. the q-grams of a document (all positions, by a rolling hash) are looked up in the items' q-grams; positions survive where a window that a passage could
   fill holds enough hits;
2. the surviving hits are counted by item and by overlapping diagonal band; bands below the item's bound are dropped;
3. each remaining band is aligned within the band: exactly (e = 0) by the runs of equal characters on its diagonal, which have to hold `tokens` whole
   tokens; else by the edit distance of each passage to the band's text, of all passages of all bands at once.

All documents are read whole and once. Items of at most `most_bytes` are one index in every task. More of them are a filter of their q-grams first, which one
scan of the documents asks; only documents with a window dense enough in it are kept, and those meet the items in groups of `most_bytes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.llm.filters import Filter, bloom
from quillmark.llm.shingles import TOKEN_CLASS, _power, mix
from quillmark.session import spread, written

FILTER_BITS = 22
PLACES = 1 << 36  # more than an item has characters


def normal(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tokens of all texts as one buffer ' tok tok ... ', and where each text's part starts and ends in it (with a space on both sides; equal: no token)."""
    from quillmark.llm.shingles import lowered

    raw, offsets = lowered(texts)
    c = TOKEN_CLASS[raw]
    ok = c != 0
    start = ok.copy()
    start[1:] &= ~ok[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < len(raw)]
    start[inner] |= ok[inner]
    number = np.cumsum(start)[ok]  # from 1
    out = np.full(len(number) + (int(number[-1]) if len(number) else 0) + 1, 32, np.uint8)
    out[np.arange(len(number)) + number] = c[ok]
    # of each text: tokens and bytes before it
    before = np.r_[0, np.cumsum(start)][offsets] + np.r_[0, np.cumsum(ok)][offsets]
    return out, before[:-1], np.where(before[1:] > before[:-1], before[1:] + 1, before[:-1])


def gram_hashes(buf: np.ndarray, q: int) -> np.ndarray:
    n = len(buf) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    up, down = _power(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(buf.astype(np.uint64) * up[: len(buf)], out=total[1:])
    return mix((total[q:] - total[:-q]) * down[:n])


def gram_length(shortest: int, edits: int, q: int) -> int:
    """The longest q of which a passage of `shortest` characters keeps one after that many edits."""
    return max(1, min(q, (shortest - 1) // (edits + 1) if edits else shortest))


def shortest_passages(texts: pa.Array, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The normal text of all, where each begins and ends in it, and the length of its shortest passage (0: it has none)."""
    buf, lo, hi = normal(texts)
    least = np.zeros(len(lo), np.int64)
    for k, (a, z) in enumerate(zip(lo, hi)):
        space = np.flatnonzero(buf[a:z] == 32)
        if len(space) > tokens:
            least[k] = int((space[tokens:] - space[:-tokens]).min()) + 1
    return buf, lo, hi, least


def dense(at: np.ndarray, need: int, window: int) -> np.ndarray:
    """Which of the sorted places stand in a window with `need` of them."""
    keep = np.zeros(len(at), bool)
    if len(at) >= need:
        close = np.flatnonzero(at[need - 1 :] - at[: len(at) - need + 1] < window)
        edge = np.zeros(len(at) + 1, np.int64)
        np.add.at(edge, close, 1)
        np.add.at(edge, close + need, -1)
        keep = np.cumsum(edge)[:-1] > 0
    return keep


class Items:
    """The index of a group of items."""

    def __init__(self, ids: list[int], texts: list[str], tokens: int, edits: int, q: int):
        self.tokens, self.edits = tokens, edits
        buf, lo, hi, least = shortest_passages(pa.array(texts, pa.large_string()), tokens)
        has = np.flatnonzero(least)
        self.ids, self.text, self.least = [ids[k] for k in has], [buf[lo[k] : hi[k]] for k in has], least[has]
        cuts = [np.flatnonzero(t == 32) for t in self.text]
        self.passages = [(x[:-tokens], x[tokens:] + 1 - x[:-tokens]) for x in cuts] if edits else []  # where each begins, and its length
        self.q = gram_length(int(self.least.min()) if len(has) else q, edits, q)
        self.need = self.least - self.q + 1 - self.q * edits
        grams = [gram_hashes(t, self.q) for t in self.text]
        h = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])
        at = np.concatenate([np.arange(len(g)) for g in grams]) if grams else np.empty(0, np.int64)
        order = np.argsort(h, kind="stable")
        self.h, self.item, self.at = h[order], item[order], at[order]
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def find(self, texts: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
        """(row, item, first and last character in the normal text, edits) of the passages found."""
        if not self.ids:
            return
        buf, lo, hi = normal(texts)
        h = gram_hashes(buf, self.q)
        at = np.flatnonzero(self.filter[(h >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        left, right = np.searchsorted(self.h, h[at], "left"), np.searchsorted(self.h, h[at], "right")
        at, left, n = at[right > left], left[right > left], (right - left)[right > left]
        need = int(self.need.min())
        # a window of one passage's grams with room for e more holds `need` hits
        window = int(self.least.max()) - self.q + 1 + self.edits if self.edits else need
        keep = dense(at, need, window)
        at, left, n = at[keep], left[keep], n[keep]
        if not len(at):
            return
        row = np.searchsorted(lo, at, side="right") - 1
        for a in range(0, len(at), 1 << 18):
            z = min(len(at), a + (1 << 18))
            while z < len(at) and row[z] == row[z - 1]:  # rows stay whole
                z += 1
            if a and row[a] == row[a - 1]:
                a += int(np.searchsorted(row[a:z], row[a - 1], side="right"))
            if a < z:
                yield from self._bands(buf, lo, hi, row[a:z], at[a:z], left[a:z], n[a:z])

    def _bands(self, buf, lo, hi, row, at, left, n) -> Iterator[tuple[int, int, int, int, int]]:
        which = np.repeat(np.arange(len(at)), n)
        k = left[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        item, diagonal, r = self.item[k], at[which] - self.at[k], row[which]
        step = self.edits + 1
        base = diagonal.min() - step
        span = int(diagonal.max() - base) // step + 3
        band = (diagonal - base) // step
        key = (r.astype(np.int64) * len(self.ids) + item) * span + band
        keys, inverse, counts = np.unique(key, return_inverse=True, return_counts=True)
        if self.edits:  # overlapping bands: this one and the next
            nxt = np.zeros(len(keys), np.int64)
            follow = np.flatnonzero(np.diff(keys) == 1)
            nxt[follow] = counts[follow + 1]
            counts = counts + nxt
        owner = (keys // span) % len(self.ids)
        good = counts >= self.need[owner]
        pair, d = keys[good] // span, keys[good] % span * step + base
        rows, items = pair // len(self.ids), pair % len(self.ids)
        if self.edits:
            bands = np.stack([np.flatnonzero(good), np.where(nxt[good] > 0, np.flatnonzero(good) + 1, len(keys))])
            yield from self._aligned(buf, lo, hi, rows, items, d, d + 2 * step - 1, bands, np.sort(inverse * PLACES + self.at[k]))
            return
        seen = set()
        for r0, i, d0 in zip(rows.tolist(), items.tolist(), d.tolist()):
            if (r0, i) in seen:
                continue
            hit = self._exact(buf, lo[r0], hi[r0], i, d0)
            if hit is not None:
                seen.add((r0, i))
                yield r0, i, int(hit[0] - lo[r0]), int(hit[1] - lo[r0]), hit[2]

    def _exact(self, buf, a: int, z: int, i: int, d: int) -> tuple[int, int, int] | None:
        t = self.text[i]
        first, last = max(0, a - d), min(len(t), z - d)
        if last - first < self.least[i]:
            return None
        x = t[first:last]
        same = x == buf[first + d : last + d]
        cuts = np.flatnonzero(np.diff(np.r_[False, same, False].astype(np.int8)))
        for s, e in zip(cuts[::2], cuts[1::2]):
            if e - s >= self.least[i] and (x[s:e] == 32).sum() > self.tokens:
                return first + d + s, first + d + e, 0
        return None

    def _aligned(self, buf, lo, hi, rows, items, d0, d1, bands, places) -> Iterator[tuple[int, int, int, int, int]]:
        """Of each (row, item) the passage of fewest edits within its bands, if they are at most e. Only passages with q-grams enough of their own in the band
        are aligned."""
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for k in range(0, len(rows), 256):
            part = slice(k, k + 256)
            where = [self.passages[i] for i in items[part]]
            many = np.array([len(x) for x, _ in where])
            owner = np.repeat(np.arange(many.size), many) + k
            begin, length = np.concatenate([x for x, _ in where]), np.concatenate([x for _, x in where])
            own = np.zeros(len(begin), np.int64)
            for band in bands:
                first = band[owner] * PLACES + begin
                own += np.searchsorted(places, first + length - self.q, "right") - np.searchsorted(places, first, "left")
            flat = np.concatenate([self.text[i] for i in items[part]])
            at = np.repeat(np.cumsum([len(self.text[i]) for i in items[part]]) - [len(self.text[i]) for i in items[part]], many) + begin
            some = np.flatnonzero(own >= length - self.q + 1 - self.q * self.edits)
            owner, begin, length, at = owner[some], begin[some], length[some], at[some]
            for z in range(0, len(at), 1 << 13):
                c = slice(z, z + (1 << 13))
                r = rows[owner[c]]
                ends, cost = banded(flat, at[c], length[c], buf, begin[c] + d0[owner[c]] - self.edits, int((d1 - d0).max()) + 2 * self.edits + 1, lo[r], hi[r], self.edits)
                for x in np.flatnonzero(cost <= self.edits):
                    pair = (int(r[x]), int(items[owner[c][x]]))
                    if pair not in best or cost[x] < best[pair][2]:
                        best[pair] = (max(int(lo[r[x]]), int(ends[x] - length[c][x])), int(ends[x]), int(cost[x]))
        for (r0, i), (s, e, n) in best.items():
            yield r0, i, int(s - lo[r0]), int(e - lo[r0]), n


def banded(patterns: np.ndarray, at: np.ndarray, length: np.ndarray, text: np.ndarray, start: np.ndarray, width: int, low: np.ndarray, high: np.ndarray, e: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each pattern (patterns[at : at + length]) the fewest edits with which it stands in text, on the `width` diagonals from `start` on and between low and
    high, and where it ends there. All patterns go on together, a character a step; those beyond `e` edits on every diagonal drop out."""
    n = len(at)
    ends, cost = np.zeros(n, np.int64), np.full(n, e + 1, np.int64)
    live = np.arange(n)
    step = np.arange(width, dtype=np.int32)
    far = np.zeros((n, width), np.int32)
    for i in range(int(length.max()) if n else 0):
        p = patterns[at[live] + i]
        j = start[live][:, None] + i + step
        inside = (j >= low[live][:, None]) & (j < high[live][:, None])
        same = inside & (text[np.clip(j, 0, len(text) - 1)] == p[:, None])
        now = far + ~same  # a step along the diagonal
        now[:, :-1] = np.minimum(now[:, :-1], far[:, 1:] + 1)  # the pattern's character has none in the text
        now[~inside] = np.minimum(now[~inside], e + 1)
        far = np.minimum.accumulate(now - step, axis=1) + step  # the text has one more
        done = length[live] == i + 1
        if done.any():
            k = np.argmin(far[done], axis=1)
            ends[live[done]] = start[live[done]] + i + 1 + k
            cost[live[done]] = far[done][np.arange(len(k)), k]
        stay = ~done & (far.min(axis=1) <= e)
        live, far = live[stay], far[stay]
        if not len(live):
            break
    return ends, cost


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", doc_text: str = "text", item_id: str = "item_id", item_text: str = "text", tokens: int = 12, edits: int = 0, q: int = 20, most_bytes: int = 4 << 20) -> DataFrame:
    """(item_id, doc_id, edits): the documents that hold a passage of `tokens` consecutive tokens of an item, with at most `edits` character edits in it.

    Null and empty texts and items of fewer tokens have no rows; repeated rows count once; extra columns are ignored; an empty side gives no rows. Texts of
    any length are read whole.
    """
    spark = documents.sparkSession
    d = documents.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(doc_text).alias("text")).where("doc_id is not null and text is not null")
    d = spread(d)
    i = items.select(F.col(item_id).cast("bigint").alias("item_id"), F.col(item_text).alias("text")).where("item_id is not null and length(text) > 0").distinct()
    total = i.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    groups = max(1, -(-total // most_bytes))
    if groups > 1:
        d = _suspects(d, i, tokens, edits, q)
    schema = "item_id bigint, doc_id bigint, edits int"
    out = None
    for g in range(groups):
        part = i if groups == 1 else i.where(F.pmod(F.xxhash64("item_id"), F.lit(groups)) == g)
        rows = [(r.item_id, r.text) for r in part.collect()]  # about most_bytes
        shared = spark.sparkContext.broadcast(rows)

        def scan(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = Items([x for x, _ in shared.value], [t for _, t in shared.value], tokens, edits, q)
            for whole in batches:
                for k in range(0, whole.num_rows, 512):
                    b = whole.slice(k, 512)
                    found = [(index.ids[m], r, e) for r, m, _, _, e in index.find(b.column(1))]
                    if found:
                        ids = b.column(0).to_numpy()
                        yield pa.RecordBatch.from_pydict({"item_id": pa.array([x for x, _, _ in found], pa.int64()), "doc_id": pa.array([int(ids[r]) for _, r, _ in found], pa.int64()), "edits": pa.array([e for _, _, e in found], pa.int32())})

        one = d.mapInArrow(scan, schema)
        out = one if out is None else out.unionByName(one)
    return out.groupBy("item_id", "doc_id").agg(F.min("edits").alias("edits"))


def _suspects(d: DataFrame, items: DataFrame, tokens: int, edits: int, q: int) -> DataFrame:
    """The documents (doc_id, text) that have a window dense enough in q-grams of any item, as a written table; one scan, whatever the number of items."""

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            least = shortest_passages(b.column(0), tokens)[3]
            least = least[least > 0]
            if len(least):
                yield pa.RecordBatch.from_pydict({"least": pa.array([int(least.min())], pa.int64()), "most": pa.array([int(least.max())], pa.int64())})

    one = items.select("text").mapInArrow(passages, "least bigint, most bigint").agg(F.min("least").alias("least"), F.max("most").alias("most")).first()
    if one.least is None:
        return d.limit(0)
    size = gram_length(one.least, edits, q)
    need = one.least - size + 1 - size * edits
    window = one.most - size + 1 + edits if edits else need

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            buf, lo, hi, least = shortest_passages(b.column(0), tokens)
            for a, z in zip(lo[least > 0], hi[least > 0]):
                yield pa.RecordBatch.from_pydict({"h": pa.array(np.unique(gram_hashes(buf[a:z], size)).view(np.int64))})

    h = written(items.select("text").mapInArrow(grams, "h bigint").distinct())
    near = bloom(h, h.count())

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Filter(near.value)
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                b = whole.slice(k, 512)
                buf, lo, _ = normal(b.column(1))
                at = np.flatnonzero(known.maybe(gram_hashes(buf, size)))
                rows = np.unique(np.searchsorted(lo, at[dense(at, need, window)], side="right") - 1)
                if len(rows):
                    yield b.take(pa.array(rows))

    return written(d.mapInArrow(ask, d.schema))
