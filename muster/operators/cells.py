"""Addresses and numbers that stand in another column than their header's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.email import normalize_email
from ..functions.phone import normalize_phone

# The end of an address that was cut over two cells, and a cell of a number and nothing else.
TAIL = r"^[A-Za-z0-9.\-]{1,15}$"
ONLY_PHONE = r"^[\d\s.+\-()]{9,20}$"


def _numbered(cells: Column, test) -> Column:
    """(i, cell) of the cells that pass."""
    each = F.transform(cells, lambda c, i: F.struct(i.alias("i"), F.trim(F.coalesce(c, F.lit(""))).alias("c")))
    return F.filter(each, lambda x: test(x["i"], x["c"]))


def search_cells(rows: DataFrame) -> DataFrame:
    """rows with raw_email and raw_phone taken from other cells of the row where their own cell holds none.

    rows: cells (an array), email_col, phone_col, stt_col, name_col (places in it, null if unknown), raw_email, raw_phone.
    An address in another cell is taken as it is; one that was cut is joined with the cell after it if that makes
    it one. Numbers are looked for only if the row is shifted: the address stood elsewhere, or the phone's cell
    holds something else. Nothing found leaves what the own cells hold.
    """
    known = F.array_compact(F.array("stt_col", "name_col"))
    other = lambda i: ~F.array_contains(known, i)
    own = normalize_email(F.col("raw_email")).isNotNull()
    found = _numbered(F.col("cells"), lambda i, c: F.contains(c, F.lit("@")) & other(i) & (i != F.coalesce("email_col", F.lit(-1))) & normalize_email(c).isNotNull())
    after = F.slice("cells", 2, F.greatest(F.size("cells"), F.lit(1)))
    both = F.transform(F.arrays_zip(F.col("cells").alias("a"), after.alias("b")), lambda x: F.struct(F.trim(F.coalesce(x["a"], F.lit(""))).alias("a"), F.trim(F.coalesce(x["b"], F.lit(""))).alias("b")))
    cut = F.filter(both, lambda x: F.contains(x["a"], F.lit("@")) & x["b"].rlike(TAIL) & normalize_email(x["a"]).isNull() & normalize_email(F.concat(x["a"], x["b"])).isNotNull())
    looked = rows.withColumn("_own", own)
    looked = looked.withColumn("_found", F.when(~F.col("_own"), F.try_element_at(found, F.lit(1)))).withColumn("_cut", F.when(~F.col("_own") & F.col("_found").isNull(), F.try_element_at(cut, F.lit(1))))
    used = F.when(F.col("_found").isNotNull(), F.col("_found.i")).when(F.col("_cut").isNotNull(), F.lit(-1)).otherwise(F.coalesce("email_col", F.lit(-2)))
    email = F.coalesce("_found.c", F.concat("_cut.a", "_cut.b"), "raw_email")
    moved = (used != F.coalesce("email_col", F.lit(-2))) | (F.trim(F.coalesce("raw_phone", F.lit(""))) != "")
    looked = looked.withColumn("_used", used).withColumn("_moved", moved & (normalize_phone(F.col("raw_phone")) == "")).withColumn("raw_email", email)
    numbers = _numbered(F.col("cells"), lambda i, c: c.rlike(ONLY_PHONE) & other(i) & (i != F.coalesce("phone_col", F.lit(-1))) & (i != F.col("_used")) & (normalize_phone(c) != ""))
    phone = F.coalesce(F.when(F.col("_moved"), F.try_element_at(numbers, F.lit(1))["c"]), F.col("raw_phone"))
    return looked.withColumn("raw_phone", phone).drop("_own", "_found", "_cut", "_used", "_moved")
