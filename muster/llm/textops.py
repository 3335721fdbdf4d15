"""Byte-level text kernels that the Arrow operators of this subpackage share.

A block is a run of whole documents of one Arrow batch: their UTF-8 bytes in one array and the
offsets between them.  Blocks are kept near ``CHUNK`` bytes so that the numpy work stays in cache and
bounded in memory; one document is never cut, so a longer document makes a block of its own.

Spans are fingerprinted with a polynomial over the bytes modulo 2**64, taken from prefix sums, so the
fingerprint of any span costs O(1) after one pass.  Equal spans always have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK = 2 << 20
BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
INVERSE = pow(BASE, -1, 1 << 64)

#: The blanks of the word pattern [^\x20\x09-\x0D]+.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK + 1), np.uint64(base), np.uint64)
        steps[0] = 1
        have = np.multiply.accumulate(steps)
        if len(have) <= 8 * CHUNK:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over the word."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def prefix(buf: np.ndarray) -> np.ndarray:
    """P with P[e] - P[s] a polynomial in the bytes s..e."""
    out = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(buf)), out=out[1:])
    return out


def span_hash(p: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Fingerprints of the spans [start, end), which don't depend on where a span stands."""
    back = powers(INVERSE, len(p))
    return mix((p[end] - p[start]) * back[start])


def column(batch: pa.RecordBatch, name: str):
    """Bytes, offsets and null mask of a string column."""
    col = batch.column(batch.schema.get_field_index(name))
    nulls = np.asarray(col.is_null())
    if col.null_count:
        col = col.fill_null("")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    offs = np.frombuffer(col.buffers()[1], kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, offs, nulls


def blocks(batch: pa.RecordBatch, name: str = "text", limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets from 0, null mask) of each block of a batch."""
    if not batch.num_rows:
        return
    data, offs, nulls = column(batch, name)
    i, n = 0, len(offs) - 1
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1))
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i], nulls[i:j]
        i = j


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of a block, and the document (row in the block) of each."""
    if not len(buf):
        return (np.zeros(0, np.int64),) * 3
    solid = ~BLANK[buf]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    edges = offs[:-1][offs[:-1] < len(buf)]
    first[edges] = solid[edges]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    ends = offs[1:][offs[1:] > 0] - 1
    last[ends] = solid[ends]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offs, starts, "right") - 1


def ngrams(hashes: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of the n-word windows that lie within one document, and each window's first word."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    acc = hashes[:m].copy()
    for k in range(1, n):
        acc = acc * np.uint64(WORD_BASE) + hashes[k : k + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 : n - 1 + m])
    return mix(acc[at]), at


def distinct(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct (doc, fingerprint) pairs, by doc, then fingerprint."""
    order = np.lexsort((h, doc))
    doc, h = doc[order], h[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    return doc[keep], h[keep]


def per_doc(doc: np.ndarray, n: int) -> np.ndarray:
    """Bounds of each document's rows in an array that is sorted by document."""
    return np.searchsorted(doc, np.arange(n + 1))
