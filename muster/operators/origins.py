"""The sources of a run as a table: which file and sheet, whose default organisation, and whether it is left out.

Columns: path, file, sheet (null: the whole file), emails, overlap (addresses that earlier sheets have), skip, default.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.email import ADDRESS
from .provinces import province_from_domains
from .sheets import SHEET, sheet_emails, sheet_stats

COLUMNS = ["path", "file", "sheet", "emails", "overlap", "skip", "default"]


def suggested(cells: DataFrame) -> DataFrame:
    """source, province: what the addresses in the cells of workbooks (each once a sheet) and documents suggest as default."""
    sheets = cells.where("kind = 'xlsx'")
    once = sheet_emails(sheets.withColumn("_p", F.col("row_pos")), "_p").select("source", "row_pos", "email")
    text = F.regexp_replace(F.lower("value"), r"(?U)\s+", "")
    every = cells.where("kind = 'docx'").select("source", "row_pos", F.explode(F.regexp_extract_all(text, F.lit(ADDRESS), F.lit(0))).alias("email"))
    return province_from_domains(once.unionByName(every)).where("province is not null").select("source", "province")


def relation(cells: DataFrame, default: str | None = None) -> DataFrame:
    """The sources that the files of ``cells`` give: a row for each sheet with addresses, or one for a file without such
    sheets. Sheets that repeat earlier ones are left out at first. default is that of all; else each file gets the one that
    its addresses suggest."""
    files = cells.select("source", "file").distinct()
    stats = sheet_stats(cells.where("kind = 'xlsx'")).where("emails > 0")
    named = stats.join(cells.select(*SHEET, "sheet_name").distinct(), SHEET).select("source", F.col("sheet_name").alias("sheet"), "emails", "overlap", "skip")
    rows = files.join(named, "source", "left").withColumn("skip", F.coalesce("skip", F.lit(False))).withColumn("overlap", F.coalesce("overlap", F.lit(0).cast("long")))
    if default and default.strip():
        rows = rows.withColumn("default", F.lit(default.strip()))
    else:
        rows = rows.join(suggested(cells).withColumnRenamed("province", "default"), "source", "left")
    return rows.withColumnRenamed("source", "path").select(*COLUMNS)


def with_default(sources: DataFrame, default: str) -> DataFrame:
    """All sources that aren't left out get this default."""
    return sources.withColumn("default", F.when(F.col("skip"), F.col("default")).otherwise(F.lit(default.strip())))


def toggled(sources: DataFrame, chosen: DataFrame) -> DataFrame:
    """The sources that are named in chosen (path, sheet) are taken up if they were left out, and left out if not."""
    marks = chosen.select(F.col("path").alias("_path"), F.col("sheet").alias("_sheet")).distinct().withColumn("_turn", F.lit(True))
    met = sources.join(marks, (F.col("path") == F.col("_path")) & F.col("sheet").eqNullSafe(F.col("_sheet")), "left")
    return met.withColumn("skip", F.col("skip") != F.coalesce("_turn", F.lit(False))).select(*sources.columns)


def added(sources: DataFrame, more: DataFrame) -> DataFrame:
    """sources and those of more that aren't among them yet."""
    key = [more["path"] == sources["path"], more["sheet"].eqNullSafe(sources["sheet"])]
    return sources.unionByName(more.join(sources, key, "left_anti"))


def active(sources: DataFrame) -> DataFrame:
    return sources.where("not skip")
