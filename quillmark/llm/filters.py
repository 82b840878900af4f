"""A filter of hashes whose size follows their number, built in blocks by the tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from quillmark.llm.shingles import mix

LEAST_BITS, MOST_BITS, BLOCK_BITS = 16, 30, 19  # from 8 KB to 128 MB; beyond about 67 million hashes it passes more, and what is exact follows it


def bits_for(count: int, per: int = 16) -> int:
    return int(min(MOST_BITS, max(LEAST_BITS, np.ceil(np.log2(max(1, per * count))))))


def bloom(hashes: DataFrame, count: int) -> Broadcast:
    """Broadcast bytes of a filter over a column h (bigint) of about `count` rows. Hashes are brought together by block, so that a task builds whole blocks
    and what is shuffled are the hashes, not a filter a task."""
    bits = bits_for(count)
    block = min(bits, BLOCK_BITS)
    size = 1 << (bits - 3)
    # the block that slot_of's high bits name
    placed = hashes.select("h").mapInArrow(lambda batches: _placed(batches, bits, block), "k int, slot int")

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hit = np.zeros(1 << block, np.uint8)
        for b in batches:
            hit[b.column("slot").to_numpy()] = 1
        yield pa.RecordBatch.from_pydict({"k": pa.array([key[0].as_py()], pa.int32()), "part": pa.array([np.packbits(hit).tobytes()], pa.binary())})

    out = np.zeros(size, np.uint8)
    step = 1 << (block - 3)
    for r in placed.distinct().groupBy("k").applyInArrow(build, "k int, part binary").collect():  # at most 128 MB in all
        out[r.k * step : (r.k + 1) * step] = np.frombuffer(r.part, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out.tobytes())


def _placed(batches: Iterator[pa.RecordBatch], bits: int, block: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        slot = slots(b.column(0).to_numpy(), bits)
        yield pa.RecordBatch.from_pydict({"k": pa.array((slot >> block).astype(np.int32)), "slot": pa.array((slot & ((1 << block) - 1)).astype(np.int32))})


def slots(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


class Filter:
    """Asks a broadcast filter."""

    def __init__(self, raw: bytes):
        self.bytes = np.frombuffer(raw, np.uint8)
        self.bits = int(np.log2(8 * len(self.bytes)))

    def maybe(self, h: np.ndarray) -> np.ndarray:
        s = slots(h, self.bits)
        return ((self.bytes[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1).astype(bool)
