"""Looking up and down the rows of a list: the last value above, running sums, the next row.

Order is row_pos (or other columns, ``order``) within the keys ``by``.  On plain rows these are windows by the keys: one task a list, which suits
many lists.  ``in_ranges`` deals rows in ranges of keys and row_pos instead, so that a list of any length is many tasks;
``look`` then works range by range (a segmented scan):

1. Each range gives a row a list: its last value, its sums, its first and last row.
2. What a range takes over from those before (or after) it is found over these rows alone.
3. It is broadcast and put in front of each range's own windows.

Only lists that go over a border take anything over, and a border cuts one list at most, so step 3 broadcasts two rows a range
or fewer, whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGE = "_range"


@dataclass
class Look:
    """kind: above (last value that isn't null, before this row), upto (with this row), total (sum, with this row), before
    (the row above's value, null or not) or after (the row below's)."""

    kind: str
    value: Column


def above(value: Column) -> Look:
    return Look("above", value)


def upto(value: Column) -> Look:
    return Look("upto", value)


def total(value: Column) -> Look:
    return Look("total", value)


def before(value: Column) -> Look:
    return Look("before", value)


def after(value: Column) -> Look:
    return Look("after", value)


def in_ranges(rows: DataFrame, by: list[str], stage: Callable[[DataFrame], DataFrame], n: int | None = None, order: tuple[str, ...] = ("row_pos",)) -> DataFrame:
    """rows in ranges of (by, order), n of them or as many as their size asks for, written by ``stage`` so that each row
    keeps its range."""
    keys = [*by, *order]
    dealt = rows.repartitionByRange(n, *keys) if n else rows.repartitionByRange(*keys)
    return stage(dealt.withColumn(RANGE, F.spark_partition_id()))


def keys(rows: DataFrame, by: list[str]) -> list[str]:
    """What windows over a list's neighbouring rows are partitioned by."""
    return [*by, RANGE] if RANGE in rows.columns else by


def look(rows: DataFrame, by: list[str], order: tuple[str, ...] = ("row_pos",), **looks: Look) -> DataFrame:
    """rows with a column for each look, in a list's order."""
    own = Window.partitionBy(*keys(rows, by)).orderBy(*order)
    earlier, so_far = own.rowsBetween(Window.unboundedPreceding, -1), own.rowsBetween(Window.unboundedPreceding, 0)
    inside = {
        "above": lambda v: F.last(v, ignorenulls=True).over(earlier), "upto": lambda v: F.last(v, ignorenulls=True).over(so_far), "total": lambda v: F.sum(v).over(so_far),
        "before": lambda v: F.lag(F.struct(v.alias("v"))).over(own), "after": lambda v: F.lead(F.struct(v.alias("v"))).over(own),
    }
    if RANGE not in rows.columns:
        return rows.withColumns({name: inside[x.kind](x.value)["v"] if x.kind in ("before", "after") else inside[x.kind](x.value) for name, x in looks.items()})

    place = F.struct(*order)
    last = lambda v: F.max_by(F.struct(v.alias("v")), F.when(v.isNotNull(), place))
    give = {"above": last, "upto": last, "total": F.sum, "before": lambda v: F.max_by(F.struct(v.alias("v")), place), "after": lambda v: F.min_by(F.struct(v.alias("v")), place)}
    given = rows.groupBy(*by, RANGE).agg(*[give[x.kind](x.value).alias(name) for name, x in looks.items()])
    ranges = Window.partitionBy(*by).orderBy(RANGE)
    gone = ranges.rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(c, ignorenulls=True).over(gone)["v"]
    take = {"above": last, "upto": last, "total": lambda c: F.sum(c).over(gone), "before": lambda c: F.lag(c).over(ranges), "after": lambda c: F.lead(c).over(ranges)}
    taken = given.withColumn("_ranges", F.count("*").over(Window.partitionBy(*by))).select(*by, RANGE, "_ranges", *[take[x.kind](F.col(name)).alias(f"_{name}") for name, x in looks.items()]).where("_ranges > 1").drop("_ranges")
    met = rows.withColumns({name: inside[x.kind](x.value) for name, x in looks.items()}).join(F.broadcast(taken), [*by, RANGE], "left")
    neighbour = lambda a, b: F.coalesce(a, b)["v"]
    join = {"above": F.coalesce, "upto": F.coalesce, "total": lambda a, b: a + F.coalesce(b, F.lit(0)), "before": neighbour, "after": neighbour}
    both = {name: join[x.kind](F.col(name), F.col(f"_{name}")) for name, x in looks.items()}
    return met.withColumns(both).select(*[c for c in rows.columns if c not in looks], *looks)
