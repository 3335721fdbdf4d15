"""Rows of documents, read by what their cells hold: the pages of one file may have different columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.email import ADDRESS, holds_email, is_bare, is_email_like, normalize_email, squeeze_at
from ..functions.phone import holds_phone, normalize_phone
from ..functions.text import display, fold
from .profile import TABLE, rich_header_map, row_arrays
from .scan import above, look, total, upto
from .sequence import AGENCY

SHORT_STT = r"^(?:\d{1,4}\.?|[IVXLC]{1,6}\.?)$"


def _first(cells: Column, test) -> Column:
    """The first (i, c) of numbered cells that passes, or null."""
    return F.try_element_at(F.filter(cells, test), F.lit(1))


def parse_rows(rows: DataFrame) -> DataFrame:
    """rows with stt, raw_name, raw_unit, raw_email, raw_phone, name_col, n_text, n_filled and has_identity. rows: cells.

    The address and the number are known by their form; the ordinal is the first cell (or the first filled one, if it is
    short); the name and the unit are the first two other texts.
    """
    numbered = rows.withColumn("_cells", F.filter(F.transform("cells", lambda c, i: F.struct(i.alias("i"), F.trim(F.coalesce(c, F.lit(""))).alias("c"))), lambda x: x["c"] != ""))
    cells = F.col("_cells")
    good = _first(cells, lambda x: squeeze_at(x["c"]).rlike(ADDRESS))
    mistyped = _first(cells, lambda x: F.contains(x["c"], F.lit("@")) & (~F.contains(squeeze_at(x["c"]), F.lit(" ")) | is_email_like(x["c"])))
    bare = _first(cells, lambda x: is_bare(x["c"]))
    found = numbered.withColumn("_email", F.coalesce(good, mistyped, bare))
    found = found.withColumn("_phone", _first(cells, lambda x: holds_phone(x["c"]) & (x["i"] != F.coalesce("_email.i", F.lit(-1)))))
    taken = F.array_compact(F.array("_email.i", "_phone.i"))
    first = F.try_element_at(cells, F.lit(1))
    moved = (first["i"] > 0) & first["c"].rlike(SHORT_STT) & ~F.array_contains(taken, first["i"])
    found = found.withColumn("_stt_col", F.when(F.coalesce(moved, F.lit(False)), first["i"]).otherwise(0))
    found = found.withColumn("_stt", F.coalesce(_first(cells, lambda x: x["i"] == F.col("_stt_col"))["c"], F.lit("")))
    found = found.withColumn("_text", F.filter(cells, lambda x: ~F.array_contains(taken, x["i"]) & (x["i"] != F.col("_stt_col"))))
    name, unit = F.try_element_at("_text", F.lit(1)), F.try_element_at("_text", F.lit(2))
    columns = {
        "stt": display(F.regexp_replace("_stt", r"^(\d+)\.$", "$1")), "raw_name": F.coalesce(name["c"], F.lit("")), "raw_unit": F.coalesce(unit["c"], F.lit("")), "raw_email": F.col("_email.c"), "raw_phone": F.col("_phone.c"),
        "name_col": name["i"], "n_text": F.size("_text"), "n_filled": F.size("_cells"), "has_identity": F.exists("_cells", lambda x: holds_email(x["c"]) | holds_phone(x["c"])),
    }
    return found.withColumns(columns).drop("_cells", "_email", "_phone", "_stt_col", "_stt", "_text")


def assemble_rows(parsed: DataFrame, by: list[str] = ["source"]) -> DataFrame:  # noqa: B006
    """The people of parse_rows(), each with group (the title above it, null if there was none) and n_joined (1 if the
    next row continued its name).

    A row of one word under a person's name, and nothing else but their number, continues the name. A row of one or two
    cells without an address or number is a title. A row without a name belongs to the person above: it gives an address
    if theirs isn't one, and a number if they have none.
    """
    name, nothing = F.col("raw_name"), F.col("raw_email").isNull() & (F.col("stt") == "")
    person_like = (F.col("has_identity") | (F.col("n_filled") > 2)) & (name != "")
    marked = look(parsed.where("n_filled > 0"), by, _above=above(F.when(person_like, F.struct("raw_name", "name_col", "raw_phone"))))
    last = F.col("_above")
    word = name.rlike(r"^\p{L}+$") & (F.col("n_text") == 1) & ~fold(name).rlike(AGENCY)
    fits = (F.col("name_col") == last["name_col"]) & ((name == F.upper(name)) == (last["raw_name"] == F.upper(last["raw_name"]))) & F.size(F.split(last["raw_name"], r"\s+")).between(1, 3) & (last["raw_name"] != "")
    number = F.col("raw_phone").isNull() | ((normalize_phone(F.col("raw_phone")) == normalize_phone(last["raw_phone"])) & (normalize_phone(last["raw_phone"]) != ""))
    marked = marked.withColumn("_joins", F.coalesce(word & nothing & fits & number, F.lit(False)))
    title = ~F.col("_joins") & ~F.col("has_identity") & (F.col("n_filled") <= 2)
    marked = marked.withColumn("_title", title)
    person = ~F.col("_joins") & ~F.col("_title") & ((name != "") | last.isNull())
    shown = F.element_at(F.filter(F.transform("cells", lambda c: F.trim(F.coalesce(c, F.lit("")))), lambda c: c != ""), -1)
    marked = look(marked.withColumn("_person", person), by, _no=total(F.col("_person").cast("int")), group=upto(F.when(F.col("_title"), shown)))

    piece = ~F.col("_person") & ~F.col("_joins") & ~F.col("_title")
    valid = normalize_email(F.col("raw_email")).isNotNull()
    own = lambda c: F.max(F.when(F.col("_person"), F.col(c))).alias(c)
    first = lambda c, ok: F.min_by(F.when(ok, F.col(c)), F.when(ok, F.col("row_pos")))
    folded = marked.where("_no > 0").groupBy(*by, "_no").agg(
        *[own(c) for c in ("row_pos", "stt", "raw_unit", "raw_email", "raw_phone", "group")], own("raw_name"),
        F.min_by(F.when(F.col("_joins"), name), F.when(F.col("_joins"), F.col("row_pos"))).alias("_rest"),
        first("raw_email", piece & valid).alias("_email"), first("raw_phone", piece & F.col("raw_phone").isNotNull()).alias("_phone"),
    )
    email = F.when(normalize_email(F.col("raw_email")).isNotNull(), F.col("raw_email")).otherwise(F.coalesce("_email", "raw_email"))
    phone = F.when(normalize_phone(F.col("raw_phone")) != "", F.col("raw_phone")).otherwise(F.coalesce("_phone", "raw_phone"))
    whole = folded.withColumn("raw_name", F.concat_ws(" ", F.nullif("raw_name", F.lit("")), "_rest")).withColumn("n_joined", F.col("_rest").isNotNull().cast("int"))
    out = whole.withColumn("raw_email", email).withColumn("raw_phone", phone).drop("_no", "_rest", "_email", "_phone")
    something = (F.col("raw_name") != "") | F.col("raw_email").isNotNull() | F.col("raw_phone").isNotNull() | (F.coalesce("raw_unit", F.lit("")) != "")
    return out.where(something)


def flatten_tables(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """The rows (source, row_pos, cells) of a document's tables below its first header, as one list: tables before it are
    left out, and so are headers that are repeated. cells: source, table_id, row_pos, col_idx, value; fields: of
    rich_header_map()."""
    first = fields.groupBy("source").agg(F.min(F.struct("table_id", "header_pos")).alias("head"))
    place = F.col("table_id").cast("long") * F.lit(1 << 32).cast("long") + F.col("row_pos")
    every = row_arrays(cells).join(first, "source").where(F.struct(F.col("table_id"), F.col("row_pos")) > F.col("head"))
    alone = cells.withColumn("table_id", F.concat_ws(":", "table_id", "row_pos")).withColumn("row_pos", F.lit(0).cast("long"))
    again = rich_header_map(alone).groupBy(*TABLE).agg(F.collect_set("field").alias("has"))
    again = again.where(F.array_contains("has", "name") & (F.array_contains("has", "email") | F.array_contains("has", "phone"))).select("source", F.col("table_id").alias("_row"))
    kept = every.withColumn("_row", F.concat_ws(":", "table_id", "row_pos")).join(again, ["source", "_row"], "left_anti")
    with_at = every.where(F.exists("cells", lambda c: F.contains(F.coalesce(c, F.lit("")), F.lit("@")))).withColumn("_row", F.concat_ws(":", "table_id", "row_pos")).join(again, ["source", "_row"], "left_semi")
    return kept.unionByName(with_at).select("source", place.alias("row_pos"), "cells")
