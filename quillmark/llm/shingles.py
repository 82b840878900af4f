"""Tokens and shingle hashes of whole Arrow batches, by numpy on the UTF-8 buffers.

Tokens are the maximal runs of a-z and 0-9 of the lower-cased text. Hashes are the same in every
process and at every batch size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
HASH_BITS = 54
ROWS = 1 << (64 - HASH_BITS)  # rows a block, so that row and hash fit one word
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

TOKEN_CLASS = np.zeros(256, np.uint8)
for _a, _b in ((48, 58), (97, 123)):
    TOKEN_CLASS[_a:_b] = np.arange(_a, _b)
TOKEN_CLASS[65:91] = np.arange(97, 123)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * M1
    x = (x ^ (x >> np.uint64(29))) * M2
    return x ^ (x >> np.uint64(32))


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        n = max(n, 1 << 20)
        for k, base in enumerate((BASE, INVERSE)):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.cumprod(p, dtype=np.uint64)
    return _powers[0], _powers[1]


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and each text's offset in them; texts with one of the two letters outside ASCII whose lower case holds an ASCII letter (Kelvin
    sign, dotted capital I) are lower-cased first, all others may be by their ASCII letters alone."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or offsets[-1] == offsets[0]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    if ((raw[:-2] == 0xE2) & (raw[1:-1] == 0x84) & (raw[2:] == 0xAA)).any() or ((raw[:-1] == 0xC4) & (raw[1:] == 0xB0)).any():
        return lowered(pa.array([None if t is None else t.lower() for t in texts.to_pylist()], pa.large_string()))
    return raw, offsets - offsets[0]


def token_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an array of strings: row of each token, its hash, and its ordinal's first byte in the joined buffer; in order."""
    raw, offsets = lowered(texts)
    if not len(raw):
        e = np.empty(0, np.int64)
        return e, np.empty(0, np.uint64), e
    c = np.empty(len(raw) + 1, np.uint8)
    c[0], c[1:] = 0, TOKEN_CLASS[raw]
    ok = c != 0
    start = np.zeros(len(raw), bool)
    start |= ok[1:] & ~ok[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(raw))]
    start[inner] |= ok[1:][inner]  # a new text starts a new token
    starts = np.flatnonzero(start)
    if not len(starts):
        e = np.empty(0, np.int64)
        return e, np.empty(0, np.uint64), e
    ends_at = np.zeros(len(raw) + 1, bool)
    ends_at[1:] = ok[1:]
    nxt = np.ones(len(raw), bool)
    nxt[:-1] = ~ok[2:] | start[1:]
    ends = np.flatnonzero(ok[1:] & nxt) + 1
    up, down = _power(len(raw) + 1)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(c[1:].astype(np.uint64) * up[: len(raw)], out=total[1:])
    h = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64) * M3)
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return rows, h, starts


def run_hashes(rows: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and hashes of every run of `width` tokens inside one row; the k-th belongs to the run that begins at its own token."""
    n = len(h) - width + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    s = h[:n].copy()
    for k in range(1, width):
        s = mix(s * M3 + h[k : k + n])
    ok = rows[:n] == rows[width - 1 :]
    return np.flatnonzero(ok), s[ok]


def shingle_sets(texts: pa.Array, width: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of at most ROWS texts: sorted words row << 54 | hash, each once, of the texts with at least `least` tokens; and how many each row has."""
    assert len(texts) <= ROWS
    rows, h, _ = token_hashes(texts)
    n = np.bincount(rows, minlength=len(texts))
    at, s = run_hashes(rows, h, width)
    r = rows[at]
    good = n[r] >= least
    key = (r[good].astype(np.uint64) << np.uint64(HASH_BITS)) | (s[good] >> np.uint64(64 - HASH_BITS))
    key = np.unique(key)
    return key, np.bincount((key >> np.uint64(HASH_BITS)).astype(np.int64), minlength=len(texts))


def blocks(batch: pa.RecordBatch):
    for k in range(0, batch.num_rows, ROWS):
        yield batch.slice(k, ROWS)
