"""Queries over whole lists as files hold them: headers, pages, running text, lost rows, sheets, and what a run tells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import display
from ..operators import freetext, profile, records, recover, sequence, sheets
from ..sources import sinks
from ..staging import staged
from . import pipelines, reports
from .registrations import registrations

KEYS = ("source", "row_pos")

# Three layouts, by the number in a source's name: rows above the header, the header, and which columns are under it.
LAYOUTS = (
    (0, ("STT", "Họ và tên", "Đơn vị công tác", "Email", "SĐT"), ("stt", "raw_name", "raw_unit", "raw_email", "raw_phone")),
    (1, ("TT", "E-mail", "Họ tên", "Số điện thoại", "Phòng ban"), ("stt", "raw_email", "raw_name", "raw_phone", "raw_unit")),
    (2, ("Ghi chú", "Họ và tên", "Chức vụ", "Điện thoại", "Thư điện tử"), ("stt", "raw_name", "raw_unit", "raw_phone", "raw_email")),
)


def _nth(rows: DataFrame) -> DataFrame:
    """rows with nth, from 0 in each source (no window over a list: a look with a running sum)."""
    return sequence.look(rows, ["source"], nth=sequence.total(F.lit(1))).withColumn("nth", F.col("nth") - 1)


def sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, table_id, row_pos, col_idx, value: each source as a sheet with titles above its header."""
    rows = _nth(registrations(spark, sf_dir)).withColumn("v", F.regexp_extract("source", r"(\d+)", 1).cast("int") % 3)
    columns = [F.array(*[F.coalesce(c, F.lit("")) for c in names]) for _, _, names in LAYOUTS]
    by_layout = lambda of: F.when(F.col("v") == 0, of(0)).when(F.col("v") == 1, of(1)).otherwise(of(2))
    cells = F.posexplode(by_layout(lambda v: columns[v])).alias("col_idx", "value")
    below = rows.select("source", (F.col("nth") + F.col("v") + 1).alias("row_pos"), cells)
    first = rows.where("nth = 0")
    heads = first.select("source", F.col("v").cast("long").alias("row_pos"), F.posexplode(by_layout(lambda v: F.array(*map(F.lit, LAYOUTS[v][1])))).alias("col_idx", "value"))
    above = first.where("v > 0").select("source", F.explode(F.sequence(F.lit(0).cast("long"), F.col("v").cast("long") - 1)).alias("row_pos"), F.lit(1).alias("col_idx"), F.lit("Danh sách đăng ký").alias("value"))
    every = below.unionByName(heads).unionByName(above).where("trim(value) <> ''")
    return staged(every.select("source", F.lit(0).alias("table_id"), F.col("row_pos").cast("long").alias("row_pos"), "col_idx", "value"))


def header_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.header_map(sheet_cells(spark, sf_dir)).select("source", "header_pos", "field", F.col("col_idx").cast("long").alias("col_idx"))


def header_search_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rich_header_map(sheet_cells(spark, sf_dir)).select("source", "header_pos", "field", F.col("col_idx").cast("long").alias("col_idx"))


def sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From cells to rows by the header that was found."""
    cells = sheet_cells(spark, sf_dir)
    rows = profile.to_rows(cells, staged(profile.rich_header_map(cells)))
    return rows.select("source", "row_pos", "stt", "name", "unit", "email", "phone")


def paged_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists that pages cut every 40 rows, with the header on each page; two pages with a column of units, two without."""
    rows = _nth(registrations(spark, sf_dir)).withColumn("table_idx", F.floor(F.col("nth") / 40))
    wide = F.floor(F.col("table_idx") / 2) % 2 == 0
    cells = lambda *c: F.when(wide, F.array(*c)).otherwise(F.array(*c[:3]))
    below = rows.select("source", "table_idx", (F.col("nth") % 40 + 1).alias("row_pos"), cells(*[F.coalesce(c, F.lit("")) for c in ("stt", "raw_name", "raw_email", "raw_unit")]).alias("cells"))
    heads = rows.where("nth % 40 = 0").select("source", "table_idx", F.lit(0).cast("long").alias("row_pos"), cells(*map(F.lit, ("STT", "Họ tên", "Email", "Đơn vị"))).alias("cells"))
    merged = sequence.logical_tables(staged(below.unionByName(heads).withColumn("header_pos", F.lit(0).cast("long"))))
    return merged.select("source", F.col("logical_id").cast("long").alias("logical_id"), "row_pos", F.array_join("cells", "|").alias("cells"))


def text_people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """People in running text: a block each, with labels."""
    rows = registrations(spark, sf_dir)
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    block = F.concat_ws("\n", *[F.when(filled(c), F.concat(F.lit(label), F.trim(c))) for c, label in (("raw_name", "Họ tên: "), ("raw_email", "Email: "), ("raw_phone", "SĐT: "))])
    texts = rows.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("row_pos", block.alias("block")))).alias("blocks"))
    people = freetext.contacts(staged(texts.select("source", F.array_join(F.transform("blocks", lambda x: x["block"]), "\n\n").alias("text"))))
    return people.select("source", "row_pos", "raw_name", "raw_email", F.nullif("raw_phone", F.lit("")).alias("raw_phone"))


def lost_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth person is missing from the list, but the text of its pages has them."""
    known = staged(records.classify(registrations(spark, sf_dir)).where(F.col("status") == records.OK).withColumn("no", sequence.parse_stt(F.col("stt"))).where("no is not null and phone <> ''"))
    lines = known.select("source", F.col("row_pos").cast("int").alias("line_no"), F.concat_ws(" ", F.col("no").cast("string"), "name", F.lit("Phòng Mẫu"), "email", "phone").alias("text"))
    found = recover.split_line(recover.lost_lines(staged(lines), sequence.stt_gaps(known.where("row_pos % 5 > 0"))))
    return found.select("source", F.col("stt_no").cast("long").alias("stt_no"), "raw_name", "raw_unit", "raw_email", "raw_phone")


def mode1_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.extract(registrations(spark, sf_dir)).warnings


def mode2_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.extract(registrations(spark, sf_dir), with_unit=True, default="Cần Thơ").warnings


def mode1_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.funnel(pipelines.extract(registrations(spark, sf_dir)).counts)


def mode1_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.layout(pipelines.extract(registrations(spark, sf_dir)).records, "x")


def mode2_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.layout(pipelines.extract(registrations(spark, sf_dir), with_unit=True, default="Cần Thơ").records)


def issue_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of issues as it is written: columns that are needed, reasons by name."""
    issues = pipelines.extract(registrations(spark, sf_dir)).issues
    return sinks.issue_report(issues, sinks.issue_columns(issues))


def shown_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registrations(spark, sf_dir).select(*KEYS, display(F.col("stt")).alias("stt"), display(F.col("raw_phone")).alias("phone"))


def _book(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a workbook of four sheets: the second repeats much of the first, the last has no address."""
    rows = registrations(spark, sf_dir)
    first = rows.select("source", (F.col("row_pos") % 3).cast("int").alias("sheet_idx"), "row_pos", F.col("raw_email").alias("value"))
    again = first.where("sheet_idx = 0 and row_pos % 4 > 0").withColumn("sheet_idx", F.lit(1))
    names = rows.where("row_pos % 3 = 0").select("source", F.lit(3).alias("sheet_idx"), "row_pos", F.col("raw_name").alias("value"))
    sheet = F.concat(F.lit("s"), F.col("sheet_idx").cast("string"))
    return staged(first.unionByName(again).unionByName(names).withColumns({"file": F.concat("source", F.lit(".xlsx")), "kind": F.lit("xlsx"), "sheet_name": sheet}))


def sheet_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = _book(spark, sf_dir)
    return sheets.skip_warnings(sheets.sheet_stats(book), book)


def sheets_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many cells each sheet gives to mode 2."""
    return sheets.pick_sheets(_book(spark, sf_dir)).groupBy("source", F.col("sheet_idx").cast("long").alias("sheet_idx")).agg(F.count("value").alias("n"))


def _pages(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Rows of tables, 30 a page, in which every sixth address is cut; and the words of the pages, with the rest of a cut
    address below its start, the row's number stuck to its end, and the addresses of other rows in the same column."""
    known = staged(_nth(records.classify(registrations(spark, sf_dir)).where(F.col("status") == records.OK)).withColumn("page", F.floor(F.col("nth") / 30).cast("int")))
    local, domain = F.substring_index("email", "@", 1), F.substring_index("email", "@", -1)
    cut = F.col("nth") % 6 == 0
    rows = known.select("source", "page", "row_pos", F.array(F.coalesce("stt", F.lit("")), "name", F.when(cut, local).otherwise(F.col("email")), "phone").alias("cells"))
    y = (F.col("nth") % 30 * 40).cast("double")
    word = lambda text, dy: known.where(cut).select("source", "page", text.alias("text"), F.lit(100.0).alias("x0"), (y + dy).alias("top"))
    half = F.floor(F.length(domain) / 2).cast("int")
    words = word(local, 0).unionByName(word(F.concat(F.lit("@"), F.substr(domain, F.lit(1), half)), 12)).unionByName(word(F.concat(F.substr(domain, half + 1), F.substring("phone", 1, 6)), 24))
    others = known.where(~cut).select("source", "page", F.col("email").alias("text"), F.lit(101.5).alias("x0"), y.alias("top"))
    return staged(rows), staged(words.unionByName(others))


def cut_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses that a column's border cut, rebuilt from the words of their page."""
    rows, words = _pages(spark, sf_dir)
    return recover.repair_cut_emails(rows, words, staged).select("source", "row_pos", F.col("col_idx").cast("long").alias("col_idx"), "email")


QUERIES = {
    f.__name__: f
    for f in (
        header_search, header_search_units, sheet_rows, paged_tables, text_people, lost_rows, mode1_warnings, mode2_warnings, mode1_funnel, mode1_layout,
        mode2_layout, cut_emails, issue_sheet, shown_cells, sheet_warnings, sheets_read,
    )
}
