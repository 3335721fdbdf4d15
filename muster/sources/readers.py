from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nfc
from ..staging import staged
from . import office
from .csv_text import csv_cells

CELLS = "source string, file string, kind string, n_sheets int, sheet_idx int, sheet_name string, table_id int, row_pos long, col_idx int, value string, error string"
COLUMNS = [c.split()[0] for c in CELLS.split(", ")]
KINDS = {"csv": "csv", "xlsx": "xlsx", "xlsm": "xlsx", "docx": "docx"}
_SMALL = {"n_sheets": "Int32", "sheet_idx": "Int32", "table_id": "Int32", "row_pos": "Int64", "col_idx": "Int32"}
_PARTS = "source string, file string, kind string, n_sheets int, sheet_idx int, sheet_name string, part binary, texts binary, error string"
_FILES = "source_no int, given string, source string, file string, kind string, error string"


def _name(path):
    return F.element_at(F.split(path, "/"), -1)


def _kind(file: str) -> str:
    return file.rsplit(".", 1)[-1].lower() if "." in file else ""


@contextmanager
def _few_files_a_batch(spark: SparkSession, n: int = 8):
    """Whole files go to Python a few at a time."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _take_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row a sheet or document, with what is needed to read it."""
    columns = [c.split()[0] for c in _PARTS.split(", ")]
    for batch in batches:
        for where, data in zip(batch["path"], batch["content"], strict=True):
            file, data = where.rsplit("/", 1)[-1], bytes(data)
            kind = KINDS[_kind(file)]
            try:
                parts = office.xlsx_parts(data) if kind == "xlsx" else [(1, 0, "", office.docx_part(data), b"")]
                rows = [(where, file, kind, n, s, name, zlib.compress(part, 1), zlib.compress(texts, 1), None) for n, s, name, part, texts in parts]
            except Exception as e:  # a damaged file is a row, not a failed job
                rows = [(where, file, kind, None, None, None, None, None, f"{type(e).__name__}: {e}")]
            yield pd.DataFrame(rows, columns=columns).astype({"n_sheets": "Int32", "sheet_idx": "Int32"})


def _parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for r in batch.itertuples(index=False):
            about = (r.source, r.file, r.kind, r.n_sheets, r.sheet_idx, r.sheet_name)
            try:
                if r.error:
                    raise ValueError(r.error)
                part, texts = zlib.decompress(r.part), zlib.decompress(r.texts)
                cells = ((r.sheet_idx, *c) for c in office.sheet_cells(part, texts)) if r.kind == "xlsx" else office.docx_cells(part)
                rows = [(*about, t, row, col, unicodedata.normalize("NFC", value), None) for t, row, col, value in cells]
            except Exception as e:
                rows = [(*about, None, None, None, None, r.error or f"{type(e).__name__}: {e}")]
            for k in range(0, len(rows), 50_000):
                yield pd.DataFrame(rows[k : k + 50_000], columns=COLUMNS).astype(_SMALL)


def _office(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Cells of workbooks and documents, and a row with ``error`` for each that can't be read. All files are one scan; a
    workbook's sheets are dealt out, so that a task reads a sheet."""
    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(_take_apart, _PARTS).repartition("source", "sheet_idx").mapInPandas(_parse, CELLS)


def _csv(spark: SparkSession, paths: list[str], split_bytes: int | None = None) -> DataFrame:
    lit = {"kind": F.lit("csv"), "n_sheets": F.lit(1), "sheet_idx": F.lit(0), "sheet_name": F.lit(""), "table_id": F.lit(0), "error": F.lit(None).cast("string")}
    return csv_cells(spark, paths, staged, split_bytes).withColumns({"file": _name("source"), **lit}).select(*COLUMNS)


def list_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """source_no (place in paths), given, source (the whole path), file, kind, error: the files of each path, which may be
    a file, a folder or a pattern; one row with an error for a path without a file, and for a file of no bytes or of another
    kind. The file system is asked once a folder, not once a file."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs.Path
    found: dict[str, list] = {p: [] for p in paths}
    special = [p for p in found if any(c in p for c in "*?[]{},\\")]
    folders: dict[str, list[str]] = {}
    for p in found:
        if p not in special:
            folder, _, name = p.rstrip("/").rpartition("/")
            folders.setdefault(folder, []).append(name)
    asked = [(folder, names[k : k + 200]) for folder, names in folders.items() for k in range(0, len(names), 200)]
    patterns = [(f"{folder}/{{{','.join(names)}}}" if len(names) > 1 else f"{folder}/{names[0]}", None) for folder, names in asked] + [(p, p) for p in special]
    by_name = {p.rstrip("/"): p for p in found if p not in special}
    for pattern, given in patterns:
        where = hadoop(pattern)
        fs = where.getFileSystem(conf)
        statuses = fs.globStatus(where)
        if not statuses and given and fs.exists(where):  # signs of a pattern in a name
            statuses = [fs.getFileStatus(where)]
        for status in statuses or []:
            path = status.getPath()
            own = given or by_name.get(f"{pattern.rpartition('/')[0]}/{path.getName()}")
            if status.isDirectory():
                inside = fs.listFiles(path, True)
                while inside.hasNext():
                    x = inside.next()
                    if not x.getPath().getName().startswith(("_", ".")):
                        found[own].append((x.getPath().toString(), x.getLen()))
            else:
                found[own].append((path.toString(), status.getLen()))
    rows = []
    for no, given in enumerate(paths):
        for path, size in found[given]:
            file = path.rsplit("/", 1)[-1]
            kind = _kind(file)
            why = "empty file" if not size else None if kind in KINDS else f"no reader for .{kind}; .pdf, .doc and .xls have to be converted first"
            rows.append((no, given, path, file, KINDS.get(kind, kind), why))
        if not found[given]:
            rows.append((no, given, given, given.rstrip("/").rsplit("/", 1)[-1], "", "no such file"))
    return spark.createDataFrame(rows, _FILES)


def read_cells(spark: SparkSession, paths: list[str], split_bytes: int | None = None) -> DataFrame:
    """Cells of files of any supported kind, with source_no (their place in paths) and error; written.

    A file is known by its whole path (source) and shown by its name (file), so two files of one name stay two. One
    that is missing, broken or of another kind is a row with an error. A file that is asked for twice is read once.
    """
    files = list_files(spark, paths)
    good = files.where("error is null").select("source", "kind").distinct().collect()  # the list that was given
    empty = spark.createDataFrame([], CELLS)
    exact = lambda path: re.sub(r"([*?\[\]{}\\])", r"\\\1", path)  # noqa: E731  Spark takes these signs for patterns
    csv, other = ([exact(r.source) for r in good if (r.kind == "csv") == is_csv] for is_csv in (True, False))
    with _few_files_a_batch(spark):
        cells = (_csv(spark, csv, split_bytes) if csv else empty).unionByName(_office(spark, other) if other else empty)
        known = cells.join(F.broadcast(files.where("error is null").select("source", "source_no")), "source")
        null = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in CELLS.split(", ") if c.split()[0] not in ("source", "file", "kind", "error")}
        bad = files.where("error is not null").withColumns(null).select(*COLUMNS, "source_no")
        return staged(known.select(*COLUMNS, "source_no").unionByName(bad))


def read_csv(spark: SparkSession, path: str, split_bytes: int | None = None) -> DataFrame:
    """Cells of CSV files without a header row, as many tasks as the files have splits (``csv_text``)."""
    return read_cells(spark, [path], split_bytes).where("error is null and kind = 'csv'").drop("source_no")


def read_office(spark: SparkSession, path: str) -> DataFrame:
    """Cells of .xlsx, .xlsm and .docx files; table_id is the sheet or table, and -1 for paragraphs."""
    return read_cells(spark, [path]).where("error is null and kind <> 'csv'").drop("source_no")


def errors(cells: DataFrame) -> DataFrame:
    """source, code, message of the files that couldn't be read. cells: with their rows of errors."""
    return cells.where("error is not null").select("source", F.lit("source_unreadable").alias("code"), F.concat("file", F.lit(": không đọc được tệp ("), "error", F.lit(")")).alias("message"))


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    return errors(read_cells(spark, [path]))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """source, line_no, text of text files."""
    files = spark.read.text(path, wholetext=True).select(_name(F.input_file_name()).alias("source"), nfc(F.regexp_replace("value", "﻿", "")).alias("text"))
    return files.select("source", F.posexplode(F.split("text", r"\r?\n")).alias("line_no", "text"))


def label_sheets(cells: DataFrame, always: bool = True) -> DataFrame:
    """cells with label, what people see: the file's name, and the sheet's if the workbook has several (``always``) or
    more than one of its sheets is asked for. Sheets become sources of their own."""
    several = F.col("n_sheets") > 1 if always else F.col("parts") > 1
    sheet = F.concat(F.lit(" [Sheet: "), "sheet_name", F.lit("]"))
    named = cells.withColumn("label", F.when(several, F.concat("file", sheet)).otherwise(F.col("file")))
    return named.withColumn("source", F.when(F.col("n_sheets") > 1, F.concat("source", sheet)).otherwise(F.col("source")))
