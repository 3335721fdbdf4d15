"""Mixing sources to target weights.

Tokens (words) are summed per source; each source's target is its share by weight of all tokens, but at
most ``most`` times what it has, and what is cut off is shared again by weight until no source is above
its bound.  A source's rate is target / tokens, and each of its documents is emitted floor(rate) times,
and once more if a hash of (seed, doc_id) falls under the fraction of the rate.

The shares are water-filling: a source is cut if its bound over its weight, r = most * tokens / weight, is
at most the level that the rest shares.  Sorted by r, a source is cut if the level that it would share,
(total - bounds of those before it) / (weights from it on), is at least r; the cut ones come first.  Two
sorts of the sources give all targets, with no loop.  Sources may be as many as hosts: their sums are sorted by
ranges, summed up within each, and the sums of the ranges (one row a range) are added (``_running``), so no task gathers
all sources.  Targets are written, counted, and broadcast to the documents if they are few.

Sources are ordered by code point, null last, and weigh ``weights`` in turn.  Empty and null texts have
size 0 and are still emitted at their source's rate; a source whose size is 0 has target 0 and rate 0.
plan() has the columns of docs and adds size, source_size, target and copies; of these it overwrites what docs has.
mix() returns the columns of docs, whatever their names, and ``copy``.  Rows that repeat a doc_id draw the same hash.
Copies are independent draws: a source's taken words scatter around its target by at most half the root of the sum of
its documents' squared sizes (one standard deviation).  An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import WORD, kept, scratch, table

WEIGHTS = (1, 2, 3)
#: Targets of up to so many sources (a few MB) are broadcast, so that the documents stay where they are; more are
#: joined by a shuffle, where adaptive execution splits a hot source.
BROADCAST_SOURCES = 50_000


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int) -> Column:
    """A number in [0, 1) that depends on seed and doc_id only: 32 bits of an md5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _running(rows: DataFrame, order: list, sums: dict[str, str], keep) -> DataFrame:
    """rows with the sum of each column of ``sums`` over all rows before, in the order; sums: name of the sum to column.

    The order is a total one. Ranges of it are tasks; only a row a range meets in one.
    """
    ranges = keep(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()))
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    per_range = ranges.groupBy("_range").agg(*[F.sum(c).alias(c) for c in sums.values()])
    starts = per_range.select("_range", *[F.coalesce(F.sum(c).over(whole), F.lit(0)).alias(f"_{name}") for name, c in sums.items()])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    joined = ranges.join(F.broadcast(starts), "_range")
    return joined.select(*rows.columns, *[(F.col(f"_{name}") + F.coalesce(F.sum(c).over(within), F.lit(0))).alias(name) for name, c in sums.items()])


def source_targets(sized: DataFrame, weights=WEIGHTS, most: int = 3) -> DataFrame:
    """source, source_size, target: one row a source, written. sized: source, size."""
    by_name = [F.col("source").isNull(), F.col("source")]
    with scratch(sized.sparkSession) as keep:
        sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).alias("one"))
        turn = _running(sums, by_name, {"turn": "one"}, keep)
        weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("turn") % len(weights) + 1).cast("int"))
        weighed = turn.withColumn("weight", weight).withColumn("bound", F.col("source_size") * most).withColumn("level", F.col("bound") / F.col("weight"))
        tried = keep(_running(weighed, [F.col("level"), *by_name], {"bounds": "bound", "weights": "weight"}, keep))
        total, weights_ = (int(x or 0) for x in tried.agg(F.sum("source_size"), F.sum("weight")).first())
        rest, left = F.lit(total) - F.col("bounds"), F.lit(weights_) - F.col("weights")
        tried = tried.withColumn("rest", rest.cast("long")).withColumn("left", left.cast("long")).withColumn("cut", rest >= F.col("level") * left)
        shared = tried.where("not cut").agg(F.min(F.struct("level", "rest", "left")).alias("shared")).select("shared.*").first()
        target = F.col("bound").cast("double")
        if shared["left"] is not None:
            target = F.when(F.col("cut"), target).otherwise(F.lit(shared["rest"]).cast("long") * F.col("weight") / F.lit(shared["left"]).cast("long"))
        return kept(tried.select("source", "source_size", target.alias("target")))


def plan(docs: DataFrame, weights=WEIGHTS, most: int = 3, seed: int = 8, prefix: str = "") -> DataFrame:
    """docs with size, source_size, target and copies (under names that start with prefix), the number of times that
    each is taken."""
    size, source_size, target, copies = (prefix + c for c in ("size", "source_size", "target", "copies"))
    targets = source_targets(docs.select("source", n_words().alias("size")), weights, most)
    few = targets.count() <= BROADCAST_SOURCES
    targets = targets.select(F.col("source").alias("_muster_source"), F.col("source_size").alias("_muster_size"), F.col("target").alias("_muster_target"))
    joined = docs.join(F.broadcast(targets) if few else targets, docs["source"].eqNullSafe(targets["_muster_source"]), "left")
    rate = F.when(F.col("_muster_size") > 0, F.col("_muster_target") / F.col("_muster_size")).otherwise(F.lit(0.0))
    taken = (F.floor(rate) + F.when(draw(seed) < rate - F.floor(rate), 1).otherwise(0)).cast("long")
    return joined.withColumns({size: n_words(), source_size: F.col("_muster_size"), target: F.col("_muster_target"), copies: taken}).drop("_muster_source", "_muster_size", "_muster_target")


def mix(docs: DataFrame, weights=WEIGHTS, most: int = 3, seed: int = 8) -> DataFrame:
    """The mixed corpus: every document repeated as its source's rate asks, numbered by ``copy``."""
    planned = plan(docs, weights, most, seed, prefix="_muster_plan_").where("_muster_plan_copies > 0")
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "copy"]
    return planned.select(*columns, F.explode(F.sequence(F.lit(1).cast("long"), F.col("_muster_plan_copies"))).alias("copy"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
  FROM documents),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size,
         ((row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 + 1)::BIGINT AS weight
  FROM sums),
levels AS (SELECT *, (source_size * 3)::DOUBLE / weight AS level FROM weighed),
tried AS (
  SELECT *,
         (sum(source_size) OVER () - coalesce(sum(source_size * 3) OVER (ORDER BY level, source IS NULL, source
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS rest,
         (sum(weight) OVER (ORDER BY level, source IS NULL, source
            ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::BIGINT AS w_left
  FROM levels),
flagged AS (SELECT *, rest >= level * w_left AS cut FROM tried),
shared AS (SELECT rest, w_left FROM flagged WHERE NOT cut ORDER BY level, rest, w_left LIMIT 1),
targets AS (
  SELECT f.source, f.source_size,
         CASE WHEN cut THEN (f.source_size * 3)::DOUBLE
              ELSE (SELECT rest FROM shared) * f.weight / (SELECT w_left FROM shared) END AS target
  FROM flagged f),
rated AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN ('0x' || substr(md5('8:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT
                 / 4294967296.0 < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
