"""Splitting oversized texts at topic boundaries, with an overlap.

Lexical cohesion: a text is cut into units (paragraphs, lines, sentences, words; characters where nothing else fits). At every gap between units the word
vectors of a block before and a block after are compared; valleys of the similarity, scored by their depth, mark topic boundaries. Inside each window that
the limit allows, the cut goes to the best gap: depth of the valley first, then the rank of the boundary (paragraph over sentence over word). Each piece
but the first begins with the last `overlap` characters of the text before it, moved forward to the beginning of a word where there is one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOUNDARY = re.compile(r"(?P<par>\n\s*\n\s*)|(?P<line>\n\s*)|(?P<sent>(?<=[.!?。！？;])[\"'”’»)]*\s+)")
TOKEN = re.compile(r"[^\W_]+")
RANK = {"par": 1.0, "line": 0.45, "sent": 0.6}
BLOCK, STEM = 3, 5


def gaps(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places where a new unit begins, in characters, and how natural each is (0 to 1)."""
    at, rank = [], []
    for m in BOUNDARY.finditer(text):
        if 0 < m.end() < len(text):
            at.append(m.end())
            rank.append(RANK[m.lastgroup])
    return np.array(at, np.int64), np.array(rank)


def depths(text: str, at: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """Depth of the similarity valley at each gap: how much the blocks around it agree less than at the peaks on both sides."""
    edges = [0, *at.tolist(), len(text)]
    bags = [Counter(w[:STEM].lower() for w in TOKEN.findall(text[a:z]) if len(w) > 3) for a, z in zip(edges, edges[1:])]
    n = len(at)
    sim = np.zeros(n)
    left, right = _Block(), _Block()
    for b in bags[1 : 1 + block]:
        right.add(b, 1)
    for i in range(n):  # both blocks slide by a unit
        left.add(bags[i], 1)
        if i >= block:
            left.add(bags[i - block], -1)
        if i:
            right.add(bags[i], -1)
            if i + block < len(bags):
                right.add(bags[i + block], 1)
        few, many = sorted((left.count, right.count), key=len)
        dot = sum(c * many[w] for w, c in few.items() if w in many)
        norm = (left.squares * right.squares) ** 0.5
        sim[i] = dot / norm if norm else 0.0
    peak = sim.copy(), sim.copy()  # the height reached by climbing to the left, and to the right
    for i in range(1, n):
        if sim[i - 1] >= sim[i]:
            peak[0][i] = peak[0][i - 1]
    for i in range(n - 2, -1, -1):
        if sim[i + 1] >= sim[i]:
            peak[1][i] = peak[1][i + 1]
    return (peak[0] + peak[1]) / 2 - sim


class _Block:
    """Words of the units in a block, and the sum of their counts' squares."""

    def __init__(self):
        self.count: dict[str, int] = {}
        self.squares = 0

    def add(self, bag: Counter, sign: int) -> None:
        for w, c in bag.items():
            old = self.count.get(w, 0)
            new = old + sign * c
            self.squares += new * new - old * old
            if new:
                self.count[w] = new
            else:
                del self.count[w]


def cut(text: str, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, own start, end) of consecutive pieces: text[own start:end] are its parts in order, text[start:end] the pieces with overlap, each within the
    limit. A text within the limit is one piece."""
    n = len(text)
    if n <= limit:
        return [(0, 0, n)] if n else []
    at, rank = gaps(text)
    score = depths(text, at) + 0.25 * rank if len(at) else rank
    out, own = [], 0
    while True:
        start = 0
        if own:
            start = max(0, own - overlap)
            m = re.compile(r"(?<=\s)\S").search(text, start, own)
            if start and not text[start - 1].isspace() and m:
                start = m.start()
        room = start + limit
        if n <= room:
            out.append((start, own, n))
            return out
        low = own + max(1, (room - own) // 2)
        i, j = np.searchsorted(at, low), np.searchsorted(at, room, side="right")
        if i >= j:
            i = np.searchsorted(at, own, side="right")
        if i < j:
            # a little is added for a fuller piece
            best = i + int(np.argmax(score[i:j] + 0.1 * (at[i:j] - own) / (room - own)))
            end = int(at[best])
        else:
            space = max(text.rfind(" ", own + 1, room), text.rfind("\t", own + 1, room))
            end = space + 1 if space > own else room
        out.append((start, own, end))
        own = end


def pieces(df: DataFrame, key: str, text: str, limit: int, overlap: int) -> DataFrame:
    """(key, piece_no, pieces, start_pos, own_pos, piece): all texts in pieces of at most `limit` characters (code points), positions from 1; the text is
    what the pieces hold from own_pos on, in order. Texts within the limit come out as one piece, by column expressions; only larger ones are cut in Python.

    Null texts have no rows, empty ones one empty piece; null keys stay; repeated rows come out once; extra columns are ignored; a text without any
    boundary is cut at the limit. `overlap` has to be less than half of `limit`."""
    assert 0 <= 2 * overlap < limit
    d = df.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    kind = d.schema["key"].dataType.simpleString()
    schema = f"key {kind}, piece_no int, pieces int, start_pos int, own_pos int, piece string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k0 in range(0, len(b), 64):  # a text may be far larger than its row's share of a batch
                out = []
                for k, t in zip(b["key"][k0 : k0 + 64], b["text"][k0 : k0 + 64]):
                    parts = cut(t, limit, overlap)
                    out += [(k, i, len(parts), s + 1, o + 1, t[s:e]) for i, (s, o, e) in enumerate(parts)]
                yield pd.DataFrame(out, columns=["key", "piece_no", "pieces", "start_pos", "own_pos", "piece"])

    one = lambda c: F.lit(c).cast("int")
    small = d.where(F.length("text") <= limit).distinct().select("key", one(0).alias("piece_no"), one(1).alias("pieces"), one(1).alias("start_pos"), one(1).alias("own_pos"), F.col("text").alias("piece"))
    large = d.where(F.length("text") > limit).distinct().mapInPandas(run, schema)
    return small.unionByName(large).withColumnRenamed("key", key)


def oversized(cut_up: DataFrame, key: str) -> DataFrame:
    """The keys that came out in more than one piece."""
    return cut_up.where("piece_no = 1").select(key).where(F.col(key).isNotNull()).distinct()
