"""Where the operators of this subpackage read their tables and keep their intermediate ones."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of every operator here, as a Java and as a DuckDB pattern.
BLANKS = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"

#: Shuffle files of a finished write go at once, not when the driver next collects garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key is hot if it has more than one in so many rows; there are fewer hot keys than this.
HOT = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only where none is set (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.gettempdir() + "/muster-shared"
    return f"{where}/{spark.sparkContext.applicationId}"


def _write(df: DataFrame) -> tuple[str, DataFrame]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return path, spark.read.schema(df.schema).parquet(path)


def kept(df: DataFrame) -> DataFrame:
    """The frame written to the shared folder and read again: cuts the lineage, outlives executors.

    Parquet rather than checkpoint(), as it is compressed and later steps read only their columns.
    """
    return _write(df)[1]


def delete(spark: SparkSession, where: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """``keep``, which works like kept(), but what it wrote is deleted at the end of the block.

    So that nothing needs a deleted table, what leaves the block has to be kept() in it.
    """
    paths = []

    def keep(df: DataFrame) -> DataFrame:
        path, out = _write(df)
        paths.append(path)
        return out

    try:
        yield keep
    finally:
        for path in paths:
            delete(spark, path)


def drop_kept(spark: SparkSession) -> None:
    """Deletes all that kept() has written for this application; earlier results can't be read after."""
    delete(spark, shared_dir(spark))


def merged(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data: joined by sorting at every size, never by a broadcast, so that small
    runs do what large ones do."""
    return df.hint("merge")


def join_groups(rows: DataFrame, groups: DataFrame, on: list[str], n: int, least: int = 1000) -> DataFrame:
    """rows joined (inner) to groups, of which each key has one row and its number of rows in ``size``.

    A key with more than one in HOT of the ``n`` rows (and ``least``) is joined by a broadcast, so that its rows stay
    where they are; there are fewer than HOT such keys, whatever the data. The others meet by a shuffle (merged()).
    Give tables that are cheap to read twice.
    """
    bound = max(n / HOT, least)
    hot = groups.where(F.col("size") > bound)
    if hot.isEmpty():
        return rows.join(merged(groups), on)
    usual = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(merged(groups.where(F.col("size") <= bound)), on)
    return rows.join(F.broadcast(hot), on).unionByName(usual)


def crc_mod(column: str, m: int):
    """crc32 of the column as text, modulo m: the folds of the query contracts."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % m
