"""Hard-negative mining by distributed radix selection.

Anchors are compared with all rows in blocks: a block of rows meets a block of anchors, and one integer matrix product gives
their scores; no score is stored.  What is wanted of a window (an anchor's rows of its label, or its rows of other
labels with scores in a range) is the first k rows by falling score, then by rising id:

1. Every task reports a histogram of a window's scores over ``buckets`` equal parts of its range, summed over its blocks.  A
   task stops a window's report at the bucket where its own rows reach k: the bucket of the kth row of all can't lie beyond.
2. The histograms are added, and the bucket of the kth row becomes the window's new range.  Again, digit by digit,
   until the range's end falls on the kth row, or one score is left.  Then the digits of the ids of the rows with that
   score are refined in the same way, so ties of any number cost the same.
3. With the bounds known, one more pass gathers just the rows that qualify: k a window or fewer.

Step 1 to 3 run for the positives, then for the windows around them; positives of equal score share one.  A pass reads the
blocks and moves histograms; its results are written, so a lost executor costs a part of one pass.  Blocks of anchors are
broadcast where all anchors are within ``broadcast`` bytes; beyond, both kinds of blocks meet by a shuffle, salted by row
block.  Products are exact: in doubles below 2**53, else in 64-bit integers.

Defined results: rows with a null id, label or vector or with a null or non-finite component take no part; a vector's missing
components count as 0; of rows that repeat an id the one of the smallest label, then vector, takes part; an anchor
with less than ``n_positives`` other rows of its label has fewer positives, one with none gives no row; so does a pair whose
window is empty, as a negative positive_score's always is.  If products could exceed 2**56 the call raises ValueError.
An empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import kept, merged, scratch, table

SALTS = 16
#: A task sums the histograms of so many windows before it reports them.
HELD = 20_000
LARGEST = (1 << 63) - 1

#: A window: its rows' scores are from lo to hi, k are wanted.  axis 0: the kth has a score from low to high; axis 1: it has the
#: score ``score`` and an id from low to high.  need: the how manieth of these it is.
STATE = "anchor_id long, block int, w long, same boolean, lo long, hi long, axis int, score long, low long, high long, need long"
FIELDS = [x.split()[0] for x in STATE.split(", ")]


@contextmanager
def _small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows of whole blocks go to Python a few at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def quantised(vectors: DataFrame, key: str, label: str, vector: str, scale: int, label_of: Column | None) -> DataFrame:
    """id, label, q: the rows that take part, one an id."""
    top = F.lit(float("inf"))
    named = vectors.select(F.col(key).cast("long").alias("id"), (F.col(label) if label_of is None else label_of).cast("long").alias("label"), F.col(vector).alias("vector"))
    finite = F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < top))
    whole = named.where("id is not null and label is not null and vector is not null").where(finite)
    q = F.transform("vector", lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return whole.select("id", F.struct("label", q.alias("q")).alias("row")).groupBy("id").agg(F.min("row").alias("row")).select("id", "row.*")


def _pack(dim: int, size: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, rows = [], [], []

        def block():
            q = np.zeros((len(ids), dim), np.int64)
            for k, row in enumerate(rows):
                q[k, : len(row)] = row
            columns = [pa.array([x.tobytes()], pa.binary()) for x in (np.array(ids, np.int64), np.array(labels, np.int64), q)]
            return pa.RecordBatch.from_arrays(columns, ["ids", "labels", "q"])

        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for into, value in zip((ids, labels, rows), row, strict=True):
                    into.append(value)
                if len(ids) == size:
                    yield block()
                    ids, labels, rows = [], [], []
        if ids:
            yield block()

    return pack


class _Table:
    """The packed rows, the packed anchors, and how they meet."""

    def __init__(self, rows: DataFrame, every: int, keep, row_block: int = 4096, anchor_block: int = 512, buckets: int = 256, broadcast: int = 64 << 20):
        self.keep, self.spark, self.buckets = keep, rows.sparkSession, buckets
        rows = keep(rows)
        square = F.aggregate("q", F.lit(0.0), lambda a, c: a + c.cast("double") * c)
        peak = F.array_max(F.transform("q", lambda c: F.abs(c.cast("double"))))
        got = rows.select("id", F.size("q").alias("dim"), square.alias("square"), peak.alias("peak")).agg(
            F.count("*").alias("n"), F.max("dim").alias("dim"), F.max("square").alias("square"), F.max("peak").alias("peak"),
            F.min("id").alias("first"), F.max("id").alias("last"), F.count_if(F.col("id") % every == 0).alias("anchors"),
        ).first()
        self.n, self.dim, self.square, self.first, self.last, self.n_anchors = got.n, max(got.dim or 0, 1), got.square or 0.0, got.first, got.last, got.anchors
        most = self.dim * (got.peak or 0.0) ** 2
        if most >= 2.0**56:
            raise ValueError("inner products of these vectors don't fit")
        self.kind = np.float64 if most < 2.0**53 else np.int64
        if not self.n_anchors:
            return
        n_blocks = -(-self.n_anchors // anchor_block)
        self.anchors = keep(rows.where(F.col("id") % every == 0).withColumn("block", F.pmod(F.xxhash64("id"), F.lit(n_blocks)).cast("int")).withColumn("square", square))
        tasks = min(-(-self.n // row_block), 10_000)
        packed = rows.repartition(tasks, "id").mapInArrow(_pack(self.dim, row_block), "ids binary, labels binary, q binary")
        self.blocks = keep(packed.withColumn("first", F.monotonically_increasing_id() == 0).withColumn("salt", F.pmod(F.xxhash64("ids"), F.lit(SALTS)).cast("int")))
        per_block = self.anchors.groupBy("block").agg(F.collect_list(F.struct("id", "label", "q")).alias("anchors"))
        self.anchor_blocks = keep(per_block)
        self.n_blocks = n_blocks
        self.broadcast = self.n_anchors * (8 * self.dim + 1024) <= broadcast

    def met(self, windows: DataFrame) -> DataFrame:
        """Each block of rows with each block of anchors and its windows."""
        dealt = self.anchor_blocks.join(windows.groupBy("block").agg(F.collect_list(F.struct(*FIELDS)).alias("windows")), "block")
        rows = self.blocks.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(self.n_blocks - 1))))
        if self.broadcast:
            return rows.join(F.broadcast(dealt), "block")
        salted = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        return rows.join(merged(salted), ["block", "salt"])

    def passed(self, windows: DataFrame, run, schema: str, then=lambda df: df) -> DataFrame:
        """What ``run`` makes of all blocks, written after ``then``."""
        with _small_batches(self.spark, 4):
            return self.keep(then(self.met(windows).mapInArrow(run, schema)))


def _scored(batches: Iterator[pa.RecordBatch], dim: int, kind: type):
    """Each window with a block's scores and ids, the rows that it may have, and whether the block is the first."""
    for batch in batches:
        for row in batch.to_pylist():
            ids, labels = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64)
            x = np.frombuffer(row["q"], np.int64).reshape(-1, dim).astype(kind)
            anchors = {a["id"]: k for k, a in enumerate(row["anchors"])}
            q = np.zeros((len(anchors), dim), kind)
            for k, a in enumerate(row["anchors"]):
                q[k, : len(a["q"])] = a["q"]
            scores = (q @ x.T).astype(np.int64)
            for w in row["windows"]:
                k = anchors[w["anchor_id"]]
                same = labels == row["anchors"][k]["label"]
                yield w, scores[k], ids, same & (ids != w["anchor_id"]) if w["same"] else ~same, row["first"]


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


HISTOGRAM = f"{STATE}, bucket long, count long"


def _histograms(dim: int, kind: type, buckets: int):
    """A window's state with each bucket that has rows, up to the one where the task's rows reach what it needs; the
    task of the first block reports a window even without rows."""

    def offsets(w: dict, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        if w["axis"]:
            near = rows & (scores == w["score"]) & (ids >= w["low"]) & (ids <= w["high"])
            return ids[near].astype(np.uint64) - np.uint64(w["low"] % (1 << 64))
        return (w["high"] - scores[rows & (scores >= w["low"]) & (scores <= w["high"])]).astype(np.uint64)

    def report(held: dict) -> pa.RecordBatch:
        out: list[list] = [[] for _ in range(len(FIELDS) + 2)]
        for w, counts, first in held.values():
            last = int(np.searchsorted(counts.cumsum(), w["need"]))
            full = np.flatnonzero(counts[: last + 1]).tolist() or ([0] if first[0] else [])
            for into, f in zip(out, FIELDS):
                into += [w[f]] * len(full)
            out[-2] += full
            out[-1] += counts[full].tolist()
        return _batch(out, HISTOGRAM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        for w, scores, ids, rows, first in _scored(batches, dim, kind):
            key = w["anchor_id"], w["w"]
            if key not in held:
                if len(held) == HELD:
                    yield report(held)
                    held = {}
                held[key] = w, np.zeros(buckets, np.int64), [False]
            width = np.uint64((w["high"] - w["low"]) // buckets + 1)
            held[key][1][:] += np.bincount((offsets(w, scores, ids, rows) // width).astype(np.int64), minlength=buckets)
            held[key][2][0] |= first
        if held:
            yield report(held)

    return run


GATHERED = "anchor_id long, w long, id long, score long"


def _gather(dim: int, kind: type):
    """The rows of windows whose bounds are known: low is the least score, high the largest id that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for w, scores, ids, rows, _ in _scored(batches, dim, kind):
            at = np.flatnonzero(rows & (scores <= w["hi"]) & ((scores > w["low"]) | (scores == w["low"]) & (ids <= w["high"])))
            if len(at):
                yield _batch([np.full(len(at), w["anchor_id"]), np.full(len(at), w["w"]), ids[at], scores[at]], GATHERED)

    return run


def _refined(first: int, last: int, buckets: int):
    """From histogram rows to the windows' next state: ``open`` ones go on, of the others low and high are as _gather has them."""

    def then(rows: DataFrame) -> DataFrame:
        key = ["anchor_id", "w"]
        dealt = rows.repartition("anchor_id")  # groups and running sums by anchor and window need no other exchange
        added = dealt.groupBy(*FIELDS, "bucket").agg(F.sum("count").alias("count"))
        summed = added.withColumn("cum", F.sum("count").over(Window.partitionBy(*key).orderBy("bucket")))
        hit = F.min(F.when(F.col("cum") >= F.col("need"), F.struct("bucket", "cum", "count")))
        found = summed.groupBy(*FIELDS).agg(hit.alias("hit"))
        wide = lambda c: F.col(c).cast("decimal(38,0)")
        width = F.floor((wide("high") - wide("low")) / buckets).cast("decimal(38,0)") + 1
        step = F.col("hit.bucket").cast("decimal(20,0)") * width
        long = lambda c: c.cast("long")
        by_score, none, ends = F.col("axis") == 0, F.col("hit").isNull(), F.col("hit.cum") == F.col("need")
        high = F.when(by_score, wide("high") - step).otherwise(F.least(wide("high"), wide("low") + step + width - 1))
        low = F.when(by_score, F.greatest(wide("low"), wide("high") - step - width + 1)).otherwise(wide("low") + step)
        moved = found.select("*", long(low).alias("to_low"), long(high).alias("to_high"), none.alias("none"), ends.alias("ends"))
        moved = moved.withColumn("need", F.when(F.col("none"), F.col("need")).otherwise(F.col("need") - (F.col("hit.cum") - F.col("hit.count"))))
        over = F.col("none") | F.col("ends")
        one_score = by_score & (F.col("to_low") == F.col("to_high"))
        out = moved.select(
            "anchor_id", "block", "w", "same", "lo", "hi", F.when(~over & one_score, 1).otherwise(F.col("axis")).alias("axis"),
            F.when(~over & one_score, F.col("to_low")).otherwise(F.col("score")).alias("score"),
            F.when(F.col("none"), F.col("lo")).when(F.col("ends"), F.when(by_score, F.col("to_low")).otherwise(F.col("score")))
            .when(one_score, F.lit(first)).otherwise(F.col("to_low")).alias("low"),
            F.when(F.col("none") | (F.col("ends") & by_score), F.lit(LARGEST)).when(F.col("ends"), F.col("to_high")).when(one_score, F.lit(last)).otherwise(F.col("to_high")).alias("high"),
            "need", (~over).alias("open"),
        )
        return out

    return then


def select(rows: _Table, windows: DataFrame) -> DataFrame:
    """anchor_id, w, id, score: the first ``need`` rows of each window. windows: anchor_id, block, w, same, lo, hi, need."""
    state = windows.where("lo <= hi").select(
        "anchor_id", "block", "w", "same", "lo", "hi", F.lit(0).alias("axis"), F.lit(LARGEST).alias("score"), F.col("lo").alias("low"), F.col("hi").alias("high"), "need"
    )
    closed = None
    while True:
        state = rows.passed(state, _histograms(rows.dim, rows.kind, rows.buckets), HISTOGRAM, _refined(rows.first, rows.last, rows.buckets))
        done = state.where("not open")
        closed = done if closed is None else closed.unionByName(done)
        state = state.where("open")
        if state.isEmpty():
            break
    return rows.passed(closed, _gather(rows.dim, rows.kind), GATHERED)


def mine(
    vectors: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", label_of: Column | None = None,
    every: int = 100, scale: int = 256, n_positives: int = 5, n_negatives: int = 10, least: int = 30, most: int = 90, **sizes: int,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose id ``every`` divides; the negatives of a pair have least to most percent of its positive's
    score. label_of: a column to take for the label. sizes: row_block, anchor_block, buckets and broadcast; they don't change
    results.
    """
    with scratch(vectors.sparkSession) as keep:
        rows = _Table(quantised(vectors, key, label, vector, scale, label_of), every, keep, **sizes)
        if not rows.n_anchors:
            names = ["anchor_id long", "positive_id long", "rank int", "negative_id long", "positive_score long", "negative_score long"]
            return vectors.sparkSession.createDataFrame([], ", ".join(names))
        bound = F.ceil(F.sqrt(F.col("square")) * float(rows.square) ** 0.5).cast("long") + 1
        by_label = rows.anchors.select(
            F.col("id").alias("anchor_id"), "block", F.lit(0).cast("long").alias("w"), F.lit(True).alias("same"),
            (-bound).alias("lo"), bound.alias("hi"), F.lit(n_positives).cast("long").alias("need"),
        )
        positives = keep(select(rows, by_label).select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))
        score = F.col("w")
        around = positives.where("positive_score >= 0").select("anchor_id", F.col("positive_score").alias("w")).distinct()
        around = around.join(rows.anchors.select(F.col("id").alias("anchor_id"), "block"), "anchor_id").select(
            "anchor_id", "block", "w", F.lit(False).alias("same"), F.ceil(score * least / F.lit(100).cast("decimal(3,0)")).cast("long").alias("lo"),
            F.floor(score * most / F.lit(100).cast("decimal(3,0)")).cast("long").alias("hi"), F.lit(n_negatives).cast("long").alias("need"),
        )
        negatives = select(rows, around)
        rank = F.row_number().over(Window.partitionBy("anchor_id", "w").orderBy(F.desc("score"), "id"))
        ranked = negatives.select("anchor_id", F.col("w").alias("positive_score"), rank.alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
        return kept(positives.join(ranked, ["anchor_id", "positive_score"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), label_of=label)


SQL = r"""
WITH q AS MATERIALIZED (
  SELECT vec_id, (CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END)::BIGINT AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND NOT list_bool_or(list_transform(embedding, lambda x: x IS NULL OR NOT isfinite(x)))),
s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER w::INTEGER AS rank, id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) QUALIFY row_number() OVER w <= 10
"""
