"""Sheets of a workbook: which repeat earlier ones, and which are worth reading."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEEN = r"(?U)[\w.%+\-]+@[\w.\-]+\.\w{2,}"
SHEET = ["source", "sheet_idx"]


def sheet_emails(cells: DataFrame, place: str | None = None) -> DataFrame:
    """source, sheet_idx, email: distinct addresses of each sheet (white space inside a cell ignored). place: a column
    whose least value for each address is row_pos."""
    text = F.regexp_replace(F.lower("value"), r"(?U)\s+", "")
    email = F.explode(F.regexp_extract_all(text, F.lit(SEEN), F.lit(0))).alias("email")
    if place:
        return cells.select(*SHEET, place, email).groupBy(*SHEET, "email").agg(F.min(place).alias("row_pos"))
    return cells.select(*SHEET, email).distinct()


def sheet_stats(cells: DataFrame, least: int = 3, share: float = 0.5) -> DataFrame:
    """source, sheet_idx, emails, overlap with earlier sheets, skip; sheets without an address have zeros."""
    first = F.min("sheet_idx").over(Window.partitionBy("source", "email"))
    counted = sheet_emails(cells).withColumn("first", first).groupBy(*SHEET).agg(F.count("*").alias("emails"), F.count_if(F.col("first") < F.col("sheet_idx")).alias("overlap"))
    sheets = cells.select(*SHEET).distinct().join(counted, SHEET, "left").na.fill(0, ["emails", "overlap"])
    skip = (F.col("emails") >= least) & (F.col("overlap") >= share * F.col("emails"))
    return sheets.withColumn("skip", skip)


def _named(stats: DataFrame, cells: DataFrame) -> DataFrame:
    return stats.join(cells.select(*SHEET, "sheet_name", "file").distinct(), SHEET)


def list_sheets(cells: DataFrame) -> DataFrame:
    """source, sheet, emails, overlap_with_previous, suggest_skip of the sheets with an address, in their order."""
    found = _named(sheet_stats(cells.where("kind = 'xlsx'")), cells).where("emails > 0").orderBy(*SHEET)
    return found.select("source", F.col("sheet_name").alias("sheet"), "emails", F.col("overlap").alias("overlap_with_previous"), F.col("skip").alias("suggest_skip"))


def skip_warnings(stats: DataFrame, cells: DataFrame) -> DataFrame:
    """source, code, message of the sheets that repeat earlier ones."""
    message = F.format_string(
        "%s [Sheet: %s]: bỏ qua sheet này vì trùng %d/%d email với sheet trước; %d email mới trong sheet không được đọc",
        "file", "sheet_name", F.col("overlap"), F.col("emails"), F.col("emails") - F.col("overlap"),
    )
    return _named(stats.where("skip"), cells).select("source", F.lit("sheet_skipped").alias("code"), message.alias("message"))


def people_warnings(stats: DataFrame, cells: DataFrame, fields: DataFrame) -> DataFrame:
    """source, code, message of the sheets that aren't read for want of an address, though their header names people and
    three rows follow. fields: source, table_id (the sheet), header_pos, field."""
    headed = fields.groupBy("source", F.col("table_id").alias("sheet_idx"), "header_pos").agg(F.collect_set("field").alias("has"))
    headed = headed.where(F.array_contains("has", "name") & (F.array_contains("has", "email") | F.array_contains("has", "phone")))
    below = cells.join(headed, SHEET).where("row_pos > header_pos").groupBy(*SHEET).agg(F.countDistinct("row_pos").alias("rows")).where("rows >= 3")
    any_email = F.max("emails").over(Window.partitionBy("source"))
    unread = stats.withColumn("_any", any_email).where("emails = 0 and _any > 0").join(below, SHEET, "left_semi")
    message = F.format_string("%s: sheet '%s' không có email nào nên không được đọc", "file", "sheet_name")
    return _named(unread, cells).select("source", F.lit("sheet_without_email").alias("code"), message.alias("message"))


def pick_sheets(cells: DataFrame, sheet: int | str | None = None, every: bool = False) -> DataFrame:
    """The cells of the sheets to read: a named one; else those with addresses (``every``: all) that aren't skipped;
    else, in a workbook without addresses, the first. A column ``wanted`` names the sheet source by source."""
    if sheet is not None:
        return cells.where(F.col("sheet_name" if isinstance(sheet, str) else "sheet_idx") == sheet)
    if "wanted" in cells.columns:
        rest = cells.where("wanted is null").drop("wanted")
        return cells.where("wanted = sheet_name").drop("wanted").unionByName(pick_sheets(rest, every=every))
    stats = sheet_stats(cells)
    if every:
        return cells.join(stats.where("not skip").select(*SHEET), SHEET, "left_semi")
    w = Window.partitionBy("source")
    good = stats.withColumn("_any", F.max("emails").over(w)).withColumn("_low", F.min("sheet_idx").over(w))
    good = good.where("(_any > 0 and emails > 0 and not skip) or (_any = 0 and sheet_idx = _low)")
    return cells.join(good.select(*SHEET), SHEET, "left_semi")
