"""CSV files of any size, read in parallel: quoted line breaks are found by what each line does to the state that it meets.

Spark's text reader splits files at line breaks, also at those inside quotes.  Whether a line starts inside a quoted
cell depends on everything before it in the file, but in a simple way: a line turns the state it meets (outside or
inside quotes) into the state it leaves, so it is one of four maps.  Both results are computed for each line on its own, from
either state.  The state that a line meets is then that of the last line which leaves the same state whatever it met,
turned as often as lines after it turn it: a look at the last value above and a running sum, which go range by range
(``operators.scan``; a range is a split of a file).  So a file is as many ranges as it has splits, with quoted
line breaks anywhere, and no Python runs.  Splits smaller than the session's are read several to a task, each still a range
of its own, so that their number costs neither a task nor a file each.

As Python's csv module (the reference for odd files) has it: a quote opens a cell only at its start; behind the closing quote
characters count as text; a cell that is never closed goes on to the end of the file (without its last line break); an empty
line is a row without cells.
Lines end with LF or CRLF; what isn't UTF-8 is left out.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import nfc
from ..operators.scan import RANGE, above, look, total

# One cell from its start to the comma behind it; possessive, so a doubled quote is never read as a closing one.
_QUOTED = r'"[^"]*+(?:""[^"]*+)*+'
_CELL = rf'(?:{_QUOTED}"[^,]*+|[^",][^,]*+|)'
#: A line, met outside quotes, that ends inside.
_OPENS = rf"^(?:{_CELL},)*+{_QUOTED}$"
_CELLS = rf',({_QUOTED}"[^,]*|{_QUOTED}$|[^,]*)'
_SPLIT = "spark.sql.files.maxPartitionBytes"
#: Splits of a given size are read in so many tasks a core, or in more of so many bytes.
TASKS, TASK_BYTES = 8, 32 << 20


@contextmanager
def _splits(spark: SparkSession, size: int | None):
    before = spark.conf.get(_SPLIT, None)
    if size:
        spark.conf.set(_SPLIT, str(size))
    try:
        yield
    finally:
        if size:
            spark.conf.unset(_SPLIT) if before is None else spark.conf.set(_SPLIT, before)


def csv_lines(spark: SparkSession, paths: list[str], split_bytes: int | None = None) -> DataFrame:
    """source, _range (where the line's split starts), place (its order in it), line. split_bytes: the size of a split, if
    it isn't the session's usual one."""
    read = spark.read.option("lineSep", "\n").text(paths)
    at = read.metadataColumn("_metadata")
    line = F.regexp_replace(F.translate("value", "�", ""), "﻿", "")
    path = F.url_decode(F.replace(at["file_path"], F.lit("+"), F.lit("%2B")))  # the path as it is named, not as an address
    lines = read.select(path.alias("source"), at["file_block_start"].alias(RANGE), F.monotonically_increasing_id().alias("place"), line.alias("line"))
    if not split_bytes:
        return lines
    tasks = max(TASKS * spark.sparkContext.defaultParallelism, lines.rdd.getNumPartitions() * split_bytes // TASK_BYTES)
    return lines.coalesce(tasks)  # no shuffle; splits stay as they are, and so do places, which are given before


def csv_records(lines: DataFrame) -> DataFrame:
    """source, row_pos (from 0), record: the lines of each row, joined."""
    order = ("place",)
    to = lambda line: line.rlike(_OPENS)
    bare = F.regexp_replace("line", "\r$", "")
    maps = lines.withColumn("_out", to(bare)).withColumn("_in", to(F.concat(F.lit('"'), bare)))
    turns = (F.col("_out") & ~F.col("_in")).cast("int")
    counted = look(maps, ["source"], order, _turns=total(turns))
    fixed = F.when(F.col("_out") == F.col("_in"), F.struct(F.col("_out").cast("int").alias("state"), F.col("_turns").alias("turns")))
    seen = look(counted, ["source"], order, _fixed=above(fixed))
    before = F.col("_turns") - turns  # turns of the lines above
    met = (F.coalesce(F.col("_fixed.state"), F.lit(0)) + before - F.coalesce(F.col("_fixed.turns"), F.lit(0))) % 2
    numbered = look(seen.withColumn("_starts", (met == 0).cast("int")), ["source"], order, _no=total(F.col("_starts")))
    rows = numbered.groupBy("source", (F.col("_no") - 1).alias("row_pos")).agg(F.array_sort(F.collect_list(F.struct(RANGE, "place", "line"))).alias("lines"))
    text = F.array_join(F.transform("lines", lambda x: x["line"]), "\n")
    return rows.select("source", "row_pos", F.regexp_replace(text, "\r$", "").alias("record"))


def _unquoted(cell: Column) -> Column:
    inside = F.regexp_extract(cell, rf'^"([^"]*+(?:""[^"]*+)*+)"?', 1)
    behind = F.regexp_extract(cell, rf'^{_QUOTED}"([^,]*)$', 1)
    return F.when(cell.startswith('"'), F.concat(F.replace(inside, F.lit('""'), F.lit('"')), behind)).otherwise(cell)


def csv_cells(spark: SparkSession, paths: list[str], stage: Callable[[DataFrame], DataFrame], split_bytes: int | None = None) -> DataFrame:
    """source, row_pos, col_idx, value of the cells that aren't blank. stage writes the lines, which are looked at several
    times; split_bytes: the size of a split, else as the session has it."""
    with _splits(spark, split_bytes):
        lines = stage(csv_lines(spark, paths, split_bytes))
    records = csv_records(lines)
    cells = F.regexp_extract_all(F.concat(F.lit(","), F.col("record")), F.lit(_CELLS), F.lit(1))
    each = records.where("record <> ''").select("source", "row_pos", F.posexplode(F.transform(cells, _unquoted)).alias("col_idx", "value"))
    return each.where(F.col("value").rlike(r"(?U)\S")).withColumn("value", nfc("value"))
