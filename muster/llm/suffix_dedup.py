"""Removal of repeated byte strings by bucket-pointer refinement of sampled suffixes.

Each text is its UTF-8 bytes.  A byte goes if it lies in a ``length``-byte string (100) that also starts
earlier: at a smaller doc_id, or earlier in the same document.  All strings are judged on the input.

Method.  Suffixes are put into buckets by their first q-gram.  A bucket is refined by sorting on (own bucket, bucket of the
suffix h bytes later), which decides 2 h bytes; the new identifiers are written back and used for the next round, until
``length`` bytes decide.  As sorting all suffixes would be a shuffle of many times the text, they are sampled first: of the
``length - Q + 1`` q-grams of every string, the one of the least hash (the leftmost of equal ones) is an anchor, so equal
strings have their anchor at the same place, and about 2 in 70 suffixes suffice to bring together all that is to be
sorted, without losing any string.

1. One pass emits the anchors: (bucket of its q-gram, fingerprint of all bytes that the strings with this
   anchor can reach, position).  Within a task, anchors that agree in both are settled: all but the first are covered,
   which collapses copies before the shuffle; a bucket that has several fingerprints there is open, and its anchors are
   dealt by bucket and fingerprint, with one marker of it dealt by bucket.  So a hot bucket gathers a row a task.
2. All other anchors are dealt by bucket and sorted by (bucket, fingerprint, position).  A scan settles every anchor
   but the first of each fingerprint as covered; a bucket with one fingerprint and no marker is done.
3. The firsts of open buckets (where repeats begin and end) get their bytes by a join on doc_id, and whole buckets
   are refined in tasks (``_refine_buckets``): all suffixes in their reach, one for each (document, position), start with
   buckets of 8 bytes; a round looks up the bucket of the suffix 8, 16, 32 bytes later and names the pairs; suffixes alone in
   their bucket drop out.  A string of 100 bytes is the pair of its 64-byte bucket and the one 36 bytes later; all but the
   first of a bucket of strings are repeats.
4. A bucket of over ``hot`` anchors is split by further identifiers, those of the bytes that all strings of a range of
   offsets share: its anchors' strings start 0 to 68 bytes before the anchor; halves of this range share more bytes, whose
   fingerprint is the anchor's bucket in the half.  Anchors whose whole reach in a half is equal are settled like those of
   step 1, by a minimum; of the others, buckets that are still hot are split again, in the end down to one string, which
   settles all.  So no task holds a hot bucket.
5. Intervals are joined to the documents and merged there.

No task holds more than a block of documents, a batch of anchors or ``hot`` contexts; numpy needs about 60 bytes a
byte of the longest text.

Defined results: a null text is empty; texts of under ``length`` bytes lose nothing; rows that repeat a
doc_id aren't earlier than each other and get the same spans (doc_id is a key: it mustn't repeat with
another text); rows with a null doc_id keep everything and don't count; extra columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textops as T
from .ngram_join import _by_group
from .tables import join_groups, kept, merged, scratch, table

Q = 32
#: What a task holds at once: anchors to settle, bytes of text to find them in, rows and bytes of contexts to refine (whole
#: buckets). Two tasks of an executor and its heap share little memory, and smaller blocks are no slower.
FLUSH, BLOCK, ROWS, REFINE = 400_000, 1 << 19, 2000, 1 << 19
#: A text of 2**32 bytes would be too long for an Arrow column, so 32 bits hold a place in a block.
PLACE = np.uint64(32)
COVERED, OPEN, USUAL = 0, 1, 2
#: The fingerprint that markers have instead of one; what they have besides is never read.
MARKER = np.iinfo(np.int64).min
ANCHORS = "route long, kind int, bucket long, context long, doc_id long, pos int, before int, after int"
SETTLED = "bucket long, doc_id long, pos int, before int, after int"


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values."""
    have = 1
    while 2 * have <= width:
        key = np.minimum(key[:-have], key[have:])
        have *= 2
    return np.minimum(key[: len(key) - (width - have)], key[width - have :]) if have < width else key


def find_anchors(buf: np.ndarray, offs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchors of a block: place in the block, document, bytes before and after it (from it on) in reach."""
    none = (np.zeros(0, np.int64),) * 4
    size = np.diff(offs)
    if not (size >= length).any():
        return none
    p = T.prefix(buf)
    grams = len(buf) - Q + 1
    raw = T.mix((p[Q:] - p[:-Q]) * T.powers(T.INVERSE, len(p))[:grams])
    key = ((raw >> PLACE) << PLACE) | np.arange(grams, dtype=np.uint64)
    low = _sliding_min(key, length - Q + 1)
    inside = np.zeros(len(buf) + 1, np.int32)
    long = np.flatnonzero(size >= length)
    np.add.at(inside, offs[long], 1)
    np.add.at(inside, offs[long + 1] - length + 1, -1)
    windows = np.cumsum(inside[:-1])[: len(low)] > 0
    chosen = np.zeros(grams, bool)
    chosen[(low[windows] & ((np.uint64(1) << PLACE) - np.uint64(1))).astype(np.int64)] = True
    at = np.flatnonzero(chosen)
    doc = np.searchsorted(offs, at, "right") - 1
    return at, doc, np.minimum(length - Q, at - offs[doc]), np.minimum(length, offs[doc + 1] - at)


def _later(doc: np.ndarray, pos: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Whether each row stands after the row ``first`` (its index), not at the same place."""
    return (doc != doc[first]) | (pos != pos[first])


def _settle(bucket, context, doc, pos, before, after) -> pa.RecordBatch:
    """Anchors of a task with their kind and where they go, and markers."""
    order = np.lexsort((pos, doc, context, bucket))
    bucket, context, doc, pos, before, after = (x[order] for x in (bucket, context, doc, pos, before, after))
    fresh = np.append(True, bucket[1:] != bucket[:-1])
    new = fresh | np.append(True, context[1:] != context[:-1])
    first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
    starts = np.flatnonzero(fresh)
    several = np.repeat(np.add.reduceat(new.astype(np.int64), starts) > 1, np.diff(np.append(starts, len(new))))
    kind = np.where(_later(doc, pos, first), COVERED, np.where(several, OPEN, USUAL))
    spread = T.mix(doc.astype(np.uint64) * np.uint64(T.BASE) + pos.astype(np.uint64))
    route = np.where(kind == COVERED, spread, np.where(kind == OPEN, T.mix(bucket ^ context), bucket))
    mark = starts[several[starts]]
    add = lambda x, y: np.append(x, np.broadcast_to(y, len(mark)).astype(x.dtype))
    return pa.record_batch({
        "route": pa.array(add(route, bucket[mark]).view(np.int64)), "kind": pa.array(add(kind, USUAL).astype(np.int32)), "bucket": pa.array(add(bucket, bucket[mark]).view(np.int64)),
        "context": pa.array(add(context.view(np.int64), MARKER)), "doc_id": pa.array(add(doc, 0)), "pos": pa.array(add(pos, 0).astype(np.int32)),
        "before": pa.array(add(before, 0).astype(np.int32)), "after": pa.array(add(after, 0).astype(np.int32)),
    })


def _anchors(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            ids = batch.column("doc_id").to_numpy()
            for i, _, buf, offs, _ in T.blocks(batch, limit=BLOCK):
                at, doc, before, after = find_anchors(buf, offs, length)
                if not len(at):
                    continue
                p = T.prefix(buf)
                reach = T.span_hash(p, at - before, at + after)
                context = T.mix(reach + (before * 65536 + after).astype(np.uint64) * np.uint64(T.WORD_BASE))
                held.append((T.span_hash(p, at, at + Q), context, ids[i + doc], *(x.astype(np.int32) for x in (at - offs[doc], before, after))))
                rows += len(at)
                if rows >= FLUSH:
                    yield _settle(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, rows = [], 0
        if held:
            yield _settle(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by (kind, bucket, context, doc_id, pos): covered anchors with a null bucket, and the
    first of each context of the open buckets. A bucket may span any number of batches."""
    names = ("kind", "bucket", "context", "doc_id", "pos", "before", "after")
    open_, waits = None, False  # the first row of the open context; whether it still waits for a second context
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(n).to_numpy() for n in names]
        if open_ is not None:
            cols = [np.append(x, y).astype(y.dtype) for x, y in zip(open_, cols, strict=True)]
        kind, bucket, context, doc, pos, before, after = cols
        fresh = np.append(True, (bucket[1:] != bucket[:-1]) | (kind[1:] != kind[:-1]))
        new = fresh | np.append(True, context[1:] != context[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        covered = _later(doc, pos, first) | (kind == COVERED)
        classes = np.add.reduceat(new.astype(np.int64), starts := np.flatnonzero(fresh))
        if open_ is not None and not waits:
            classes[0] += 1  # its bucket had a context before
        several = np.repeat(classes > 1, np.diff(np.append(starts, len(new)))) | (kind == OPEN)
        emit = (covered | (new & several)) & ((context != MARKER) | (kind == COVERED))
        if open_ is not None and not waits:
            emit[0] = False  # it went out before
        yield pa.record_batch({"bucket": pa.array(bucket[emit], mask=covered[emit]), "doc_id": pa.array(doc[emit]), "pos": pa.array(pos[emit]), "before": pa.array(before[emit]), "after": pa.array(after[emit])})
        open_, waits = [x[first[-1] : first[-1] + 1] for x in cols], not (several[-1] or kind[-1] == COVERED)


def _contexts(length: int):
    """Each open anchor's bytes in reach."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs, _ = T.column(batch, "text")
            data = data.tobytes() if len(data) < 1 << 26 else memoryview(data)
            lists = batch.column("anchors")
            flat, bounds = lists.flatten(), np.append(0, np.cumsum(np.diff(np.asarray(lists.offsets))))
            row = np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            pos, before, after = (flat.field(n).to_numpy() for n in ("pos", "before", "after"))
            start = offs[row] + pos
            for k in range(0, len(start), 20_000):
                w = slice(k, k + 20_000)
                ctx = [bytes(data[s - b : s + a]) for s, b, a in zip(start[w].tolist(), before[w].tolist(), after[w].tolist(), strict=True)]
                yield pa.record_batch({
                    "bucket": flat.field("bucket").slice(k, 20_000), "doc_id": pa.array(batch.column("doc_id").to_numpy()[row[w]]),
                    "pos": pa.array(pos[w]), "before": pa.array(before[w]), "bytes": pa.array(ctx, pa.binary()),
                })

    return run


def _suffixes(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes that the contexts cover, each (document, position) once and in order: document, position, byte, and the
    place behind the last byte that follows without a gap."""
    doc, start = rows.column("doc_id").to_numpy(), rows.column("pos").to_numpy().astype(np.int64) - rows.column("before").to_numpy()
    col = rows.column("bytes").combine_chunks()
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0] : offs[-1]]
    size = np.diff(offs)
    at = np.arange(len(data)) - np.repeat(offs[:-1] - offs[0], size) + np.repeat(start, size)
    names, doc = np.unique(doc, return_inverse=True)
    doc = np.repeat(doc, size)
    order = np.lexsort((at, doc))
    doc, at, data = doc[order], at[order], data[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (at[1:] != at[:-1]))
    doc, at, data = doc[new], at[new], data[new]
    ends = np.flatnonzero(np.append((doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1), True)) + 1
    return names[doc], at, data, np.repeat(ends, np.diff(np.append(0, ends)))


def _named(key: np.ndarray, live: np.ndarray, n: int) -> np.ndarray:
    """A bucket number for each of n suffixes: equal keys of the ``live`` ones share one; -1 for those alone or not live."""
    out = np.full(n, -1)
    if len(live):
        _, name, count = np.unique(key, return_inverse=True, return_counts=True)
        out[live] = np.where(count[name] > 1, name, -1)
    return out


def _refined(bucket: np.ndarray, later: int, end: np.ndarray, reach: int) -> np.ndarray:
    """Buckets sorted on the buckets of the suffixes ``later`` bytes on; ``end``: the place behind each suffix's last byte;
    reach: how many bytes a suffix must have for it."""
    n = len(bucket)
    live = np.flatnonzero((bucket >= 0) & (np.arange(n) + reach <= end))
    live = live[bucket[live + later] >= 0]
    return _named(bucket[live] * n + bucket[live + later], live, n)


def string_buckets(data: np.ndarray, end: np.ndarray, length: int) -> np.ndarray:
    """The bucket of the ``length``-byte string at each place, -1 if it is the only one."""
    n, h = len(data), 8
    live = np.flatnonzero(np.arange(n) + h <= end)
    gram = np.zeros(n, np.uint64)
    for k in range(h):
        gram[: n - k] |= data[k:].astype(np.uint64) << np.uint64(8 * k)
    bucket = _named(gram[live], live, n)
    while 2 * h <= length:
        bucket = _refined(bucket, h, end, 2 * h)
        h *= 2
    return _refined(bucket, length - h, end, length) if h < length else bucket


def _refine_buckets(length: int):
    """Over whole buckets: the intervals of repeated strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = (b.slice(k, ROWS).rename_columns(["group", *b.schema.names[1:]]) for b in batches for k in range(0, b.num_rows, ROWS))
        for rows in _by_group(pieces, REFINE):
            doc, at, data, end = _suffixes(rows)
            bucket = string_buckets(data, end, length)
            own = np.flatnonzero(bucket >= 0)  # by document and position, so the first of a bucket is its earliest
            order = own[np.argsort(bucket[own], kind="stable")]
            hit = np.sort(order[1:][bucket[order[1:]] == bucket[order[:-1]]])
            if len(hit):
                fresh = np.append(True, (np.diff(hit) > 1) | (doc[hit[1:]] != doc[hit[:-1]]) | (at[hit[1:]] != at[hit[:-1]] + 1))
                last = np.append(np.flatnonzero(fresh)[1:] - 1, len(hit) - 1)
                yield pa.record_batch({"doc_id": pa.array(doc[hit[fresh]]), "start": pa.array(at[hit[fresh]].astype(np.int32)), "end": pa.array((at[hit[last]] + length).astype(np.int32))})

    return run


CONTEXTS = "bucket long, doc_id long, pos int, before int, bytes binary, low int, high int"


def _split(length: int):
    """Each context twice, in the buckets of the two halves of its range of offsets (low to high: how far before the anchor
    a string starts), named by the bytes that all strings of the half share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                middle, before, text = (row["low"] + row["high"]) // 2, row["before"], row["bytes"]
                after = len(text) - before
                for low, high in ((row["low"], middle), (middle + 1, row["high"])):
                    if max(low, length - after) <= min(high, before):
                        shared = text[before - low : before + length - high]
                        name = hashlib.blake2b(shared, digest_size=8, salt=low.to_bytes(8, "little") + high.to_bytes(8, "little")).digest()
                        reach = min(before, high)
                        out.append((int.from_bytes(name, "little", signed=True), row["doc_id"], row["pos"], reach, text[before - reach : before + length - low], low, high))
            names = [c.split()[0] for c in CONTEXTS.split(", ")]
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.int32(), pa.int32()]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names)

    return run


def _merge(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of the union of intervals."""
    order = np.argsort(start, kind="stable")
    start, top = start[order], np.maximum.accumulate(end[order])
    new = np.append(True, start[1:] > top[:-1])
    return start[new], top[np.append(np.flatnonzero(new)[1:] - 1, len(top) - 1)]


def _cut(digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offs, _ = T.column(batch, "text")
            lists = batch.column("spans")
            flat, bounds = lists.flatten(), np.append(0, np.cumsum(np.diff(np.asarray(lists.offsets)) if not lists.null_count else np.asarray(lists.value_lengths().fill_null(0))))
            starts, ends = flat.field("start").to_numpy(), flat.field("end").to_numpy()
            size, removed, spans, out = np.diff(offs), [], [], []
            for k in range(batch.num_rows):
                text = data[offs[k] : offs[k + 1]]
                if bounds[k] == bounds[k + 1]:
                    removed.append(0)
                    spans.append(0)
                    stay = text.tobytes()
                else:
                    s, e = _merge(starts[bounds[k] : bounds[k + 1]], ends[bounds[k] : bounds[k + 1]])
                    removed.append(int((e - s).sum()))
                    spans.append(len(s))
                    stay = b"".join(text[a:b].tobytes() for a, b in zip(np.append(0, e).tolist(), np.append(s, len(text)).tolist(), strict=True))
                out.append(hashlib.sha256(stay).hexdigest() if digest else stay)
            yield pa.record_batch([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(out, pa.string() if digest else pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    return run


def repeated_spans(docs: DataFrame, length: int = 100, hot: int = 1000) -> DataFrame:
    """doc_id, start, end: byte intervals whose union is all that is to be removed."""
    texts = docs.selectExpr("cast(doc_id as long) doc_id", "text").where("doc_id is not null and text is not null")
    with scratch(docs.sparkSession) as keep:
        anchors = texts.mapInArrow(_anchors(length), ANCHORS).repartition("route").drop("route")
        settled = keep(anchors.sortWithinPartitions("kind", "bucket", "context", "doc_id", "pos").mapInArrow(_scan, SETTLED))
        spans = settled.where("bucket is null").selectExpr("doc_id", "pos - before start", "pos + after end")

        rest = settled.where("bucket is not null")
        per_doc = rest.groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "pos", "before", "after")).alias("anchors"))
        found = texts.join(merged(per_doc), "doc_id").mapInArrow(_contexts(length), "bucket long, doc_id long, pos int, before int, bytes binary")
        open_ = keep(found.withColumns({"low": F.lit(0), "high": F.lit(length - Q)}))
        while True:
            sizes = keep(open_.groupBy("bucket").agg(F.count("*").alias("size")).where("size > 1"))
            large = sizes.where(f"size > {hot}")
            usual = open_.join(merged(sizes.where(f"size <= {hot}").select("bucket")), "bucket", "left_semi")  # those alone in their bucket drop out
            dealt = usual.select("bucket", "doc_id", "pos", "before", "bytes").repartition("bucket").sortWithinPartitions("bucket")
            spans = spans.union(keep(dealt.mapInArrow(_refine_buckets(length), "doc_id long, start int, end int")))
            if large.isEmpty():
                break
            halves = keep(join_groups(open_, large, ["bucket"], open_.count()).drop("size").select(*[c.split()[0] for c in CONTEXTS.split(", ")]).mapInArrow(_split(length), CONTEXTS))
            halves = halves.withColumn("context", F.xxhash64("before", "bytes"))
            # contexts that agree in a half are settled: all but the first are covered, by one interval
            alike = keep(halves.groupBy("bucket", "context").agg(F.min(F.struct("doc_id", "pos", "before", "bytes", "low", "high")).alias("first"), F.count("*").alias("size")))
            several = alike.where("size > 1").select("bucket", "context", "size", F.col("first.doc_id").alias("first_doc"), F.col("first.pos").alias("first_pos"))
            places = halves.select("bucket", "context", "doc_id", "pos", "before", F.octet_length("bytes").alias("n"))
            covered = join_groups(places, several, ["bucket", "context"], halves.count()).where("doc_id <> first_doc or pos <> first_pos")
            spans = spans.union(keep(covered.selectExpr("doc_id", "pos - before start", "pos - before + n end")))
            open_ = alike.select("bucket", "first.*")
        return kept(spans)


def remove_repeats(docs: DataFrame, length: int = 100, hot: int = 1000, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the remaining bytes (kept) or their SHA-256 (digest)."""
    spans = repeated_spans(docs, length, hot).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").join(merged(spans), "doc_id", "left")
    last = "kept_sha256 string" if digest else "kept binary"
    return rows.mapInArrow(_cut(digest), f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)
