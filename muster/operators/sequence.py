"""Operators over the order of rows in a table: repair, ordinals, groups, fill-down.

Order is row_pos within the keys ``by`` (a source, sheet or table).  Rows of ``scan.in_ranges`` are worked on range by range, so
that one list of any length is many tasks; other rows list by list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordinal import is_group_stt, parse_stt, stt_list
from ..functions.phone import NUMBER, is_full_phone
from ..functions.text import fold
from .scan import above, after, before, look, total, upto

# Words that start the name of an agency in a group's title (without accents).
AGENCY = r"^(?:so|ban|phong|trung tam|van phong|vien|truong|tram|hoi|ubnd|hdnd|uy ban|co quan|dang uy|benh vien|chi cuc|cuc|cong an|xa|phuong|thi tran)(?![a-z])"


def blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def ordinals(rows: DataFrame, by: list[str] = ["source"]) -> DataFrame:  # noqa: B006
    """rows with stt_no and row_label: the ordinal, 'sau STT N' after the last one, or 'đầu bảng'.

    If rows have stt_col, those of a table without an ordinal column (null) are numbered from 1 instead.
    """
    numbered = rows.withColumn("stt_no", parse_stt(F.col("stt")))
    looks = {"last_stt": above(F.col("stt_no"))} | ({"_nth": total(F.lit(1))} if "stt_col" in rows.columns else {})
    seen = look(numbered, by, **looks)
    label = F.when(F.col("stt_no").isNotNull(), F.col("stt_no").cast("string"))
    if "stt_col" in rows.columns:
        label = label.when(F.col("stt_col").isNull(), F.col("_nth").cast("string"))
    label = label.when(F.col("last_stt").isNotNull(), F.concat(F.lit("sau STT "), F.col("last_stt").cast("string"))).otherwise("đầu bảng")
    return seen.withColumn("row_label", label).drop("_nth")


def stt_gaps(rows: DataFrame, by: list[str] = ["source"]) -> DataFrame:  # noqa: B006
    """by, stt_no: the ordinals from 1 to the largest that are missing (an anti join, not an array)."""
    seen = rows.select(*by, parse_stt(F.col("stt")).alias("stt_no")).where("stt_no is not null").distinct()
    spans = seen.groupBy(*by).agg(F.max("stt_no").alias("most"))
    return spans.select(*by, F.explode(F.sequence(F.lit(1), "most")).alias("stt_no")).join(seen, [*by, "stt_no"], "left_anti")


def gap_warnings(rows: DataFrame, by: list[str] = ["source"], sparse: float = 0.3) -> DataFrame:  # noqa: B006
    """by, code, missing, most, message: one row for each table with gaps; ordinals are at most 99999."""
    most = rows.groupBy(*by).agg(F.max(parse_stt(F.col("stt"))).alias("most"))
    missing = stt_gaps(rows, by).groupBy(*by).agg(F.count("*").alias("missing"), F.array_sort(F.collect_list("stt_no")).alias("gaps"))
    few = F.col("missing") > sparse * F.col("most")
    message = F.when(few, F.concat(F.lit("STT thưa: thiếu "), F.col("missing").cast("string"), F.lit("/"), F.col("most").cast("string"))).otherwise(F.concat(F.lit("STT nhảy số: thiếu "), stt_list(F.col("gaps"))))
    return missing.join(most, by).select(*by, F.when(few, "stt_sparse").otherwise("stt_gap").alias("code"), "missing", F.col("most").cast("long").alias("most"), message.alias("message"))


def fill_down(rows: DataFrame, column: str, by: list[str] = ["source"]) -> DataFrame:  # noqa: B006
    """rows with <column>_filled: the last value that isn't blank, down to the next."""
    return look(rows, by, **{f"{column}_filled": upto(F.when(~blank(F.col(column)), F.trim(column)))})


def mark_group_titles(rows: DataFrame, by: list[str] = ["source"]) -> DataFrame:  # noqa: B006
    """rows with is_group: a blank or roman ordinal, no address or number, and the name of an agency or a
    roman ordinal; or a plain ordinal if the next row has none but an address. And group: the last title."""
    nothing = blank(F.col("raw_email")) & blank(F.col("raw_phone"))
    titled = fold(F.coalesce("raw_name", F.lit(""))).rlike(AGENCY)
    roman = F.trim(F.coalesce("stt", F.lit(""))).rlike(r"^[IVXLC]{1,6}\.?$")
    rows, ahead = look(rows, by, _ahead=after(F.struct("stt", "raw_email"))), F.col("_ahead")
    below = blank(ahead["stt"]) & F.contains(ahead["raw_email"], F.lit("@"))
    is_group = nothing & ~blank(F.col("raw_name")) & ((is_group_stt(F.col("stt")) & (titled | roman)) | (~is_group_stt(F.col("stt")) & (titled | F.coalesce(below, F.lit(False)))))
    marked = rows.withColumn("is_group", F.coalesce(is_group, F.lit(False))).drop("_ahead")
    return look(marked, by, group=upto(F.when(F.col("is_group"), F.trim("raw_name"))))


def drop_group_titles(rows: DataFrame, by: list[str] = ["source"]) -> DataFrame:  # noqa: B006
    """rows of tables with an ordinal column without the titles of groups. rows: also cells, stt_col and name_col.

    A title has a blank or roman ordinal, a name, no address or number in any cell, and nothing but crumbs beside, or the
    name of an agency; or a plain ordinal and nothing beside the name of an agency, or beside any name if the next row
    has no ordinal but an address; or a roman ordinal and its text in the ordinal's cell and nothing else.
    """
    cell = lambda c: F.trim(F.coalesce(c, F.lit("")))
    filled = F.filter(F.transform("cells", lambda c, i: F.struct(i.alias("i"), cell(c).alias("c"))), lambda x: x["c"] != "")
    contact = F.exists(filled, lambda x: F.contains(x["c"], F.lit("@")) | x["c"].rlike(NUMBER) | x["c"].rlike(r"^[\d\s.+\-()]{9,20}$"))
    beside = F.filter(filled, lambda x: (x["i"] != F.coalesce("stt_col", F.lit(-1))) & (x["i"] != F.coalesce("name_col", F.lit(-1))))
    others = F.aggregate(beside, F.lit(0), lambda s, x: s + F.length(x["c"]))
    agency = fold(F.coalesce("raw_name", F.lit(""))).rlike(AGENCY)
    roman_text = blank(F.col("raw_name")) & F.trim("stt").rlike(r"^[IVXLC]{1,6}[.)]?\s+\S") & (F.size(filled) == 1)
    ahead = after(F.struct("stt", F.exists("cells", lambda c: F.contains(cell(c), F.lit("@"))).alias("at")))
    rows, below = look(rows, by, _ahead=ahead), F.col("_ahead")
    numbered = parse_stt(F.col("stt")).isNotNull() & (others == 0) & (agency | (blank(below["stt"]) & below["at"]))
    loose = is_group_stt(F.col("stt")) & ((others <= 3) | agency)
    title = F.col("stt_col").isNotNull() & F.col("name_col").isNotNull() & (roman_text | (~blank(F.col("raw_name")) & ~contact & (loose | numbered)))
    return rows.withColumn("_title", F.coalesce(title, F.lit(False))).where("not _title").drop("_title", "_ahead")


def merge_continuations(rows: DataFrame, by: list[str] = ["source"]) -> DataFrame:  # noqa: B006
    """A row without a name continues the one above: its cells are appended, except the ordinal.

    Not if both have an @ in the address or both are whole phone numbers. Rows of one record make an island;
    the guards look at the cell above and at whether the island already has an address or number.
    """
    named, place = ~blank(F.col("raw_name")), F.col("row_pos")
    filled = rows.where(named | ~blank(F.col("raw_email")) | ~blank(F.col("raw_phone")))
    filled = filled.withColumn("_at", F.contains(F.coalesce("raw_email", F.lit("")), F.lit("@"))).withColumn("_full", is_full_phone(F.coalesce("raw_phone", F.lit(""))))
    seen = look(filled, by, _named=upto(F.when(named, place)), _at_above=above(F.when(F.col("_at"), place)), _full_above=above(F.when(F.col("_full"), place)))
    again = lambda c: F.coalesce(F.col(c) & (F.col(f"{c}_above") >= F.col("_named")), F.lit(False))
    starts = named | again("_at") | again("_full") | F.col("_named").isNull()
    island = look(seen.withColumn("_start", starts.cast("int")), by, _island=total(F.col("_start")))

    def joined(c: str) -> Column:
        ordered = F.array_sort(F.collect_list(F.struct("row_pos", F.coalesce(c, F.lit("")).alias("cell"))))
        return F.array_join(F.transform(ordered, lambda x: F.trim(x["cell"])), "").alias(c)

    used = {*by, "row_pos", "raw_name", "raw_email", "raw_phone"}
    first = [F.min_by(c, "row_pos").alias(c) for c in rows.columns if c not in used]
    return island.groupBy(*by, "_island").agg(F.min("row_pos").alias("row_pos"), *first, F.count("*").alias("n_rows"), joined("raw_name"), joined("raw_email"), joined("raw_phone")).drop("_island")


def join_name_fragments(rows: DataFrame, by: list[str] = ["source"]) -> DataFrame:  # noqa: B006
    """A row of one word and nothing else is the second line of the name above it, of one to three words, if that
    row has an address or digits and the word isn't an agency's."""
    rows, up = look(rows, by, _up=before(F.struct("raw_name", "raw_email", "raw_phone"))), F.col("_up")
    word = F.trim(F.coalesce("raw_name", F.lit("")))
    one = word.rlike(r"^\p{L}+$") & blank(F.col("raw_email")) & (blank(F.col("raw_phone")) | (F.trim("raw_phone") == F.trim(up["raw_phone"]))) & blank(F.col("stt"))
    same_case = (word == F.upper(word)) == (up["raw_name"] == F.upper(up["raw_name"]))
    fits = F.size(F.split(F.trim(up["raw_name"]), r"\s+")).between(1, 3) & ~blank(up["raw_name"]) & (F.contains(up["raw_email"], F.lit("@")) | up["raw_phone"].rlike(r"\d"))
    fragment = F.coalesce(one & same_case & fits & ~fold(word).rlike(AGENCY), F.lit(False))
    marked = look(rows.withColumn("is_fragment", fragment).drop("_up"), by, _down=after(F.struct("is_fragment", "raw_name")))
    down = F.col("_down")
    name = F.when(F.coalesce(down["is_fragment"], F.lit(False)), F.concat_ws(" ", F.trim("raw_name"), F.trim(down["raw_name"]))).otherwise(F.col("raw_name"))
    return marked.withColumn("raw_name", name).where(~F.col("is_fragment")).drop("is_fragment", "_down")


def logical_tables(rows: DataFrame) -> DataFrame:
    """Tables of a document that follow each other with equal width are one: source, logical_id, row_pos (from its
    start), cells; without the header that a continuation repeats (half of its cells or more equal).

    rows: source, table_idx, row_pos, cells, and header_pos, the row of the table's header (0 if none is known).
    """
    sizes = rows.groupBy("source", "table_idx").agg(F.max(F.size("cells")).alias("width"), (F.max("row_pos") + 1).alias("rows"))
    w = Window.partitionBy("source").orderBy("table_idx")
    start = F.coalesce((F.col("width") != F.lag("width").over(w)).cast("int"), F.lit(1))
    ids = sizes.withColumn("_start", start).withColumn("logical_id", F.sum("_start").over(w))
    inner = Window.partitionBy("source", "logical_id").orderBy("table_idx")
    ids = ids.withColumn("_before", F.coalesce(F.sum("rows").over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ids = ids.withColumn("_lead", F.first("table_idx").over(inner)).select("source", "table_idx", "logical_id", "_before", "_lead")
    heads = rows.where("row_pos = header_pos").select("source", F.col("table_idx").alias("_lead"), F.col("cells").alias("_head"))
    joined = rows.join(ids, ["source", "table_idx"]).join(heads, ["source", "_lead"], "left")
    equal = F.aggregate(F.zip_with("cells", "_head", lambda a, b: (fold(F.coalesce(a, F.lit(""))) == fold(F.coalesce(b, F.lit("")))).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    repeated = F.coalesce((F.col("table_idx") != F.col("_lead")) & (F.col("row_pos") == 0) & (2 * equal >= F.size("_head")), F.lit(False))
    return joined.where(~repeated).select("source", "logical_id", (F.col("row_pos") + F.col("_before")).alias("row_pos"), "cells")


def asof_unit(recovered: DataFrame, known: DataFrame) -> DataFrame:
    """recovered (source, stt_no) with the unit of the nearest lower ordinal of known (source, stt_no, unit)."""
    known = known.groupBy("source", "stt_no").agg(F.max("unit").alias("unit"))  # an ordinal is one row: at most 99,999 a source
    both = known.select("source", "stt_no", "unit", F.lit(0).alias("side")).unionByName(recovered.select("source", "stt_no", F.lit(None).cast("string").alias("unit"), F.lit(1).alias("side")))
    w = Window.partitionBy("source").orderBy("stt_no", "side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("unit", F.last("unit", ignorenulls=True).over(w)).where("side = 1").drop("side")
