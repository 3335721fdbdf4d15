"""What the head of a document or sheet says about all its people: the unit, the commune, the issuing agency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .profile import TABLE
from .units import as_written, document_communes, document_issuer

# The line that names the unit, and a title that ends with it.
UNIT_LINE = r"(?iu)(?:Tên\s*Cơ\s*quan,?\s*đơn\s*vị|Cơ\s*quan,?\s*đơn\s*vị)\s*[:\-]\s*(.+)"
TITLE_LINE = r"(?iu)(?<![\p{L}\p{N}_])của\s+(.+)$"


def header_unit(text: Column) -> Column:
    """What follows 'Tên cơ quan, đơn vị:' on its line; null if nothing does."""
    return F.nullif(F.trim(F.regexp_extract(text, UNIT_LINE, 1)), F.lit(""))


def title_unit(text: Column) -> Column:
    """The unit that the lines above a table name: after its label, or after the first 'của' of a line."""
    ends = F.transform(F.split(text, "\n"), lambda x: F.regexp_replace(F.regexp_extract(F.trim(x), TITLE_LINE, 1), r"^[ .;:)(]+|[ .;:)(]+$", ""))
    return F.coalesce(header_unit(text), F.try_element_at(F.filter(ends, lambda x: F.length(x).between(1, 150)), F.lit(1)))


def _text(cells: DataFrame, by: list[str]) -> DataFrame:
    """by, header: the cells as lines, in their order."""
    ordered = F.array_sort(F.collect_list(F.struct("table_id", "row_pos", "col_idx", F.trim("value").alias("line"))))
    return cells.groupBy(*by).agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("header"))


def _heads(headers: DataFrame, by: list[str], lines: int, body: Column) -> DataFrame:
    """by, doc_commune, doc_issuer (only where there is no commune) and header."""
    keyed = headers.withColumn("_key", F.concat_ws("\x1f", *by))
    communes = document_communes(keyed.select(F.col("_key").alias("source"), "header"), lines).withColumnRenamed("source", "_key")
    joined = keyed.join(communes, "_key", "left").withColumn("_body", body)
    issuer = F.when(F.col("doc_commune").isNull(), document_issuer(F.col("header")))
    joined = joined.withColumn("_issuer", issuer)
    return joined.withColumn("doc_issuer", as_written(F.col("_issuer"), F.col("_body"))).drop("_key", "_issuer", "_body")


def table_context(cells: DataFrame, fields: DataFrame) -> DataFrame:
    """source, table_id, doc_commune, doc_issuer, fallback_unit of sheets with rows above their header. The fallback is for
    tables without a column of units."""
    heads = fields.groupBy(*TABLE, "header_pos").agg(F.array_contains(F.collect_set("field"), "unit").alias("has_unit")).where("header_pos > 0")
    above = cells.join(heads, TABLE).where("row_pos < header_pos")
    found = _heads(_text(above, TABLE), TABLE, 40, F.col("header")).join(heads, TABLE)
    return found.select(*TABLE, "doc_commune", "doc_issuer", F.when(~F.col("has_unit"), title_unit(F.col("header"))).alias("fallback_unit"))


def document_context(cells: DataFrame) -> DataFrame:
    """source, doc_commune, doc_issuer, fallback_unit of documents: from their small tables (three rows or fewer) and
    paragraphs (table -1)."""
    tables = cells.where("table_id >= 0").groupBy(*TABLE).agg((F.max("row_pos") + 1).alias("rows")).where("rows <= 3")
    small = cells.join(tables, TABLE, "left_semi")
    paragraphs = cells.where("table_id < 0").withColumn("table_id", F.lit((1 << 31) - 1))
    found = _heads(_text(small.unionByName(paragraphs), ["source"]), ["source"], 15, F.col("header"))
    units = _text(paragraphs, ["source"]).select("source", header_unit(F.col("header")).alias("fallback_unit"))
    return found.join(units, "source", "left").select("source", "doc_commune", "doc_issuer", "fallback_unit")
