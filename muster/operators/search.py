"""Search, sort and preview of results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import fold
from .records import reason_label
from .scan import RANGE, in_ranges, look, total


def _hit(columns: list[str], query: str) -> Column:
    """A reason is found by its label."""
    if not query.strip():
        return F.lit(True)
    wanted = fold(F.lit(query))
    shown = lambda c: reason_label(F.col(c)) if c == "reason" else F.col(c).cast("string")
    return F.exists(F.array(*[fold(F.coalesce(shown(c), F.lit(""))) for c in columns]), lambda x: F.contains(x, wanted))


def search(rows: DataFrame, columns: list[str], query: str) -> DataFrame:
    """Rows of which one of the columns contains the query, without regard to accents and case."""
    return rows.where(_hit(columns, query)) if query.strip() else rows


def counts(rows: DataFrame, columns: list[str], query: str) -> DataFrame:
    """total and filtered, the rows and those that search() finds, in one pass."""
    return rows.agg(F.count("*").alias("total"), F.count_if(_hit(columns, query)).alias("filtered"))


def natural_key(c: Column) -> Column:
    """A text that sorts as people sort: without regard to accents and case, and runs of digits by their value (a2 before
    a10).  A run is its digits without leading zeros, behind their number."""
    runs = F.regexp_extract_all(fold(F.coalesce(c.cast("string"), F.lit(""))), F.lit(r"\d+|\D+"), F.lit(0))
    number = lambda x: F.regexp_replace(x, r"^0+(?=\d)", "")
    return F.array_join(F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lpad(F.length(number(x)).cast("string"), 5, "0"), number(x))).otherwise(x)), "")


def preview(rows: DataFrame, column: str, tie: list[str], descending: bool = False, limit: int = 200, start: dict | None = None) -> DataFrame:
    """The first ``limit`` rows in the natural order of a column (top-k: Spark keeps k rows a task).

    start: a row of the page before (its column and ties): the page goes on behind it, whatever its number.
    """
    key = natural_key(F.col(column))
    if start is not None:
        last = rows.sparkSession.createDataFrame([tuple(start[c] for c in (column, *tie))], rows.select(column, *tie).schema)
        bound = last.select(natural_key(F.col(column)).alias("k")).first()["k"]
        ties = F.struct(*[F.col(c) for c in tie]) > F.struct(*[F.lit(start[c]).cast(rows.schema[c].dataType).alias(c) for c in tie])
        rows = rows.where(((key < bound) if descending else (key > bound)) | ((key == bound) & ties))
    return rows.orderBy(key.desc() if descending else key.asc(), *tie).limit(limit)


def paged(rows: DataFrame, column: str, tie: list[str], stage: Callable[[DataFrame], DataFrame], size: int = 200) -> DataFrame:
    """rows with nth (from 1, in the natural order of a column) and page (from 1): all pages at once.

    The rows are sorted by ranges; a range adds its rows to the number of those before it, so no task holds all.
    """
    keyed = rows.withColumn("_key", natural_key(F.col(column)))
    order = ("_key", *tie)
    counted = look(in_ranges(keyed, [], stage, order=order), [], order, nth=total(F.lit(1)))
    return counted.withColumn("page", F.ceil(F.col("nth") / size)).drop("_key", RANGE)
