"""Exact dedup by stateful streaming: keyed state on disk that never expires, and bytes that are compared on hits.

Texts are equal if they are identical without ``[\\x20\\x09-\\x0D]`` (null counts as empty).  Of equal texts the row
with the most code points in the original text stays, then the one of the smallest doc_id (null last), then the first
by place in the files.

Method.

1. The table is read as a stream of files.  Its state (a streaming aggregation in RocksDB, no watermark, so nothing
   expires) holds for each digest of a normalised text: the identifier of the row that stays, its content locator (file
   and row in it) and the number of rows.  No text is in the state.  Rows are combined before the shuffle, so a
   text that a third of all rows have is one row a task.  A state folder given by ``where`` goes on from earlier runs:
   only files that are new are read into it; a lost executor is replaced from the last committed batch.
2. Hits: rows whose digest has more than one row are compared byte by byte, as groups of (digest, text) that are
   combined before the shuffle.  Texts alone with their digest are neither shuffled nor compared.  Equal digests of
   different texts (a weak ``digest``) are told apart here, and those rows are judged by their text.
3. Each row takes what the state says of its digest: a join of digests, without texts.  The locator tells the
   row that stays from its repetitions.

No Python runs on the executors.  Defined results: empty and null texts are one group; rows with a null doc_id take
part, and keep_id is null where such a row stays; of rows that repeat doc_id and text one stays; columns of
any other name may be there (also ``_metadata``, ``digest``); an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .tables import delete, kept, merged, scratch, shared_dir

BLANKS = " \t\n\x0b\x0c\r"
#: Fewer groups of copies than this (16 bytes each) are broadcast, so that texts without a copy stay where they are.
BROADCAST_GROUPS = 1_000_000
#: The state is in RocksDB; the memory of all its stores in an executor is bounded, and a store allocates no disk ahead (else
#: several MB each, whatever it holds).
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def normalised(text: str | Column = "text") -> Column:
    return F.translate(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), BLANKS, "")


def _rows(docs: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """digest, norm, text_sha256 (bytes), and ``row``: what orders the rows of a group, and where the row is found.

    docs: read from files.
    """
    at = docs.metadataColumn("_metadata")
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(
        (-F.length(text)).alias("chars"), F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id"),
        at["file_path"].alias("file"), at["row_index"].alias("place"),
    )
    named = docs.select(row.alias("row"), normalised(text).alias("norm"))
    return named.select("row", "norm", digest(F.col("norm")).alias("digest"), sha256(F.col("norm")).alias("text_sha256"))


def _as_pattern(path: str) -> str:
    """A pattern that matches just this path: the streaming source takes a single file only by a pattern."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def run_stream(spark: SparkSession, path: str, schema: StructType, where: str, digest: Callable[[Column], Column] = sha256, **limits: str) -> None:
    """Takes the files of ``path`` that ``where`` (a checkpoint folder) hasn't seen into its state, and returns when all
    are in.  limits: options of the file source, such as maxFilesPerTrigger or maxBytesPerTrigger."""
    docs = spark.readStream.schema(schema).options(**limits).parquet(_as_pattern(path))
    state = _rows(docs, digest).groupBy("digest").agg(F.min("row").alias("best"), F.count("*").alias("n"))
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        query = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", where).trigger(availableNow=True).start()
        try:
            query.awaitTermination()
        finally:
            query.stop()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def read_state(spark: SparkSession, where: str) -> DataFrame:
    """digest, best (the row that stays: chars negated, doc_id, file, place) and n, as the state in ``where`` holds them."""
    stored = spark.read.format("statestore").load(where)
    best, n = (f.name for f in stored.schema["value"].dataType.fields)
    return stored.select(F.col("key.digest"), F.col("value")[best].alias("best"), F.col("value")[n].alias("n"))


def _texts(rows: DataFrame, groups: DataFrame, n_groups: int) -> DataFrame:
    """digest, norm, best, n: the texts of the digests in ``groups``, told apart by all their bytes."""
    keys = groups.select(F.xxhash64("digest").alias("key"))
    hits = rows.select("digest", "norm", "row", F.xxhash64("digest").alias("key"))
    hits = hits.join(F.broadcast(keys) if n_groups <= BROADCAST_GROUPS else merged(keys), "key", "left_semi")
    return hits.groupBy("digest", "norm").agg(F.min("row").alias("best"), F.count("*").alias("n"))


def _judged(rows: DataFrame, groups: DataFrame, on: list[str]) -> DataFrame:
    """Each row with what its group says; a row without a group stays."""
    joined = rows.join(merged(groups.select(*on, "best", "n")), on, "left").withColumn("best", F.coalesce("best", "row"))
    return joined.select(
        F.col("row.doc_id").alias("doc_id"), F.col("best.doc_id").alias("keep_id"), F.coalesce("n", F.lit(1).cast("long")).alias("group_size"),
        F.col("row").eqNullSafe(F.col("best")).alias("kept"), F.lower(F.hex("text_sha256")).alias("text_sha256"), "row.file", "row.place",
    )


def deduplicate(spark: SparkSession, path: str, where: str | None = None, digest: Callable[[Column], Column] = sha256, **limits: str) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, and file and place of the row: one row a document of the Parquet
    table at ``path`` (columns doc_id and text).

    where: the folder of the state, which is kept; without it one is made in the shared folder and deleted.
    """
    docs = spark.read.parquet(path)
    rows = _rows(docs, digest)
    if docs.isEmpty():
        return _judged(rows, rows.select("digest", F.col("row").alias("best"), F.lit(1).cast("long").alias("n")), ["digest"])
    own = where is None
    where = where or f"{shared_dir(spark)}/state-{uuid.uuid4().hex}"
    try:
        run_stream(spark, path, docs.schema, where, digest, **limits)
        with scratch(spark) as keep:
            groups = keep(read_state(spark, where).where("n > 1"))
            mixed = keep(_texts(rows, groups, groups.count()).groupBy("digest").agg(F.count("*").alias("n_texts")).where("n_texts > 1").select("digest"))
            n = mixed.count()
            if not n:
                return kept(_judged(rows.drop("norm"), groups, ["digest"]))
            usual = _judged(rows.drop("norm").join(merged(mixed), "digest", "left_anti"), groups, ["digest"])
            told_apart = _judged(rows.join(merged(mixed), "digest", "left_semi"), _texts(rows, mixed, n), ["digest", "norm"])
            return kept(usual.unionByName(told_apart))
    finally:
        if own:
            delete(spark, where)


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark, f"{sf_dir}/documents.parquet").drop("file", "place")


SQL = r"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size, row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY chars DESC, doc_id)
"""
