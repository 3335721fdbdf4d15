"""Benchmark decontamination: size-partitioned MinHash containment search.

Items and documents are sets of five-word shingles (words are ``[^\\x20\\x09-\\x0D]+``, ASCII capitals
folded).  An item of fewer words is one shingle of all of them, which is looked for among the runs of as many words
of a document.  A document is contaminated by an item if it holds at least ``threshold`` of the item's distinct
shingles, however long the document is.

Method.  A MinHash sketch of the whole document would drown a short item, so the sketch is taken of the
item and looked up in the document's full shingle set (containment, not resemblance).  Items are
partitioned by size into classes [2^k, 2^(k+1)), each with a table of its own; a class with upper bound u keeps
for each item its ``u - ceil(threshold * u) + 1`` smallest hash values.  A document that holds ``threshold`` of the
shingles must hold one of those, so the search loses nothing (a value that is equal is looked for, which
replaces comparing sketches).  Each (document, item) candidate is then verified by exact counting of the item's
shingles in the document.

Plan.  Items are taken in blocks of at most ``block_shingles`` shingles, broadcast one at a time, and the
documents are scanned once a block: no shuffle, no bound on the benchmark, and memory that depends on
neither.  An ordinary benchmark is one block.

Defined results: a null or blank text has no shingles and is never hit, and such an item hits nothing; repeated
items and documents each get their own rows; a null item_id or doc_id is kept as null; an empty table
gives no rows; columns besides the two keys and the texts are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textops as T

HITS = "doc_id long, item_id long, n_item long, n_shared long, containment double"


def sketch_size(n: int, threshold: float) -> int:
    """Smallest hash values to keep for an item of n shingles: what its size class asks for."""
    upper = (1 << n.bit_length()) - 1
    return min(n, upper - math.ceil(threshold * upper - 1e-9) + 1)


def _shingles(buf: np.ndarray, offs: np.ndarray, n: int, shorter: tuple[int, ...] = ()) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, shingle) of the runs of n words and of those of each ``shorter`` number, by document; and the
    number of words of each document."""
    buf = T.LOWER[buf]
    start, end, doc = T.words(buf, offs)
    words = T.span_hash(T.prefix(buf), start, end)
    found = [(doc[at], h) for h, at in (T.ngrams(words, doc, k) for k in (n, *shorter))]
    count = np.bincount(doc, minlength=len(offs) - 1)
    if len(found) == 1:
        return *found[0], count
    own, h = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(own, kind="stable")
    return own[order], h[order], count


def _item_shingles(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("item_id").cast(pa.int64())
            for i, j, buf, offs, _ in T.blocks(batch):
                size = np.minimum(_shingles(buf, offs, n)[2], n)
                doc, h = [], []
                for k in np.unique(size[size > 0]).tolist():  # an item's shingles are of as many words as it has, n at most
                    d, x, _ = _shingles(buf, offs, k)
                    doc.append(d[size[d] == k])
                    h.append(x[size[d] == k])
                doc, h = T.distinct(np.concatenate(doc), np.concatenate(h)) if doc else (np.zeros(0, np.int64), np.zeros(0, np.uint64))
                bounds = T.per_doc(doc, j - i)
                yield pa.record_batch({
                    "item_id": ids.slice(i, j - i), "words": pa.array(size, pa.int32()),
                    "shingles": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(h.view(np.int64))),
                })

    return run


class _SizeClass:
    """The sketches of the items of one size class."""

    def __init__(self, items: list[tuple[int, np.ndarray]], threshold: float):
        keys = [s[: sketch_size(len(s), threshold)] for _, s in items]
        owner = np.repeat([k for k, _ in items], [len(x) for x in keys])
        order = np.argsort(keys := np.concatenate(keys), kind="stable")
        self.keys, self.owner = keys[order], owner[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.keys >> np.uint64(44)).astype(np.int64)] = True

    def candidates(self, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
        near = np.flatnonzero(self.seen[(h >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(self.keys, h[near], "left"), np.searchsorted(self.keys, h[near], "right")
        count = hi - lo
        at = np.repeat(lo, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        return np.stack([np.repeat(doc[near], count), self.owner[at]], 1)


class _Block:
    """Items of one block, partitioned by size and ready for lookup."""

    def __init__(self, items: list[tuple[int, int, np.ndarray]], n: int, threshold: float):
        self.ids = [i for i, _, _ in items]
        self.sets = [s for _, _, s in items]
        self.shorter = tuple(sorted({w for _, w, _ in items if w < n}))
        classes: dict[int, list] = {}
        for k, s in enumerate(self.sets):
            classes.setdefault(len(s).bit_length(), []).append((k, s))
        self.classes = [_SizeClass(x, threshold) for _, x in sorted(classes.items())]

    def candidates(self, doc: np.ndarray, h: np.ndarray) -> np.ndarray:
        """Distinct (doc, item) pairs that share a sketch value."""
        return np.unique(np.concatenate([c.candidates(doc, h) for c in self.classes]), axis=0)


def _hits(items: _Block, batch: pa.RecordBatch, n: int, threshold: float) -> Iterator[tuple[int, int, int, int]]:
    """(row, item_id, shingles of the item, those found) of each item that a row's document holds."""
    for i, j, buf, offs, _ in T.blocks(batch):
        doc, h, _ = _shingles(buf, offs, n, items.shorter)
        bounds, last, own = T.per_doc(doc, j - i), -1, None
        for d, k in items.candidates(doc, h).tolist():
            if d != last:
                last, own = d, np.unique(h[bounds[d] : bounds[d + 1]])
            want = items.sets[k]
            at = np.minimum(np.searchsorted(own, want), len(own) - 1)
            found = int((own[at] == want).sum())
            if found >= threshold * len(want) - 1e-9:
                yield i + d, items.ids[k], len(want), found


def _search(block, n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").to_pylist()
            rows = [(ids[r], item, want, found, found / want) for r, item, want, found in _hits(block.value, batch, n, threshold)]
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.float64()], strict=True)], ["doc_id", "item_id", "n_item", "n_shared", "containment"])

    return run


def _drop(block, n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stay = np.ones(batch.num_rows, bool)
            stay[[r for r, *_ in _hits(block.value, batch, n, threshold)]] = False
            yield batch.filter(pa.array(stay))

    return run


def _item_blocks(items: DataFrame, n: int, threshold: float, block_shingles: int) -> Iterator[_Block]:
    shingled = items.select("item_id", "text").mapInArrow(_item_shingles(n), "item_id long, words int, shingles array<long>").where(F.size("shingles") > 0)
    block, held = [], 0
    for row in shingled.toLocalIterator():
        s = np.sort(np.array(row["shingles"], np.int64).view(np.uint64))
        if block and held + len(s) > block_shingles:
            yield _Block(block, n, threshold)
            block, held = [], 0
        block.append((row["item_id"], row["words"], s))
        held += len(s)
    if block:
        yield _Block(block, n, threshold)


def contaminated(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, block_shingles: int = 2_000_000) -> DataFrame:
    """One row per (document, item) with at least ``threshold`` of the item's shingles in the document.

    docs: doc_id, text.  items: item_id, text.  At most ``block_shingles`` item shingles (16 MB) are
    broadcast at a time; an item longer than that is a block of its own.
    """
    spark, out = docs.sparkSession, None
    texts = docs.select("doc_id", "text")
    for block in _item_blocks(items, n, threshold, block_shingles):
        hits = texts.mapInArrow(_search(spark.sparkContext.broadcast(block), n, threshold), HITS)
        out = hits if out is None else out.unionByName(hits)
    return spark.createDataFrame([], HITS) if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.8, block_shingles: int = 2_000_000) -> DataFrame:
    """The documents that no item contaminates, with all their columns; no shuffle."""
    for block in _item_blocks(items, n, threshold, block_shingles):
        docs = docs.mapInArrow(_drop(docs.sparkSession.sparkContext.broadcast(block), n, threshold), docs.schema)
    return docs
