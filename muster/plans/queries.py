"""The library's queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import email as E
from ..functions.names import match_score, normalize_name, strip_honorific
from ..functions.ordinal import parse_stt
from ..functions.phone import normalize_phone
from ..functions.text import fold
from ..operators import content, domains, freetext, origins, provinces, records, recover, scan, search, sequence, sheets, units
from ..operators.cells import search_cells
from ..sources import read_csv, sinks
from . import list_queries, pipelines
from .oracle import ORACLE_SQL
from .registrations import registrations, table
from ..staging import scratch_folder, staged

__all__ = ["ORACLE_SQL", "QUERIES"]

KEYS = ("source", "row_pos")


def email_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registrations(spark, sf_dir).select(*KEYS, E.normalize_email(F.col("raw_email")).alias("email"))


def email_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.classify(registrations(spark, sf_dir)).groupBy("source", "status").agg(F.count("*").alias("n"))


def email_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registrations(spark, sf_dir).where("raw_email is not null").select(*KEYS, E.repair(F.col("raw_email")).alias("repaired"))


def phone_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registrations(spark, sf_dir).select(*KEYS, normalize_phone(F.col("raw_phone")).alias("phone"))


def name_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registrations(spark, sf_dir).select(*KEYS, normalize_name(F.col("raw_name")).alias("name"))


def accent_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fold(F.col("text")).alias("folded"))


def _valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(records.classify(registrations(spark, sf_dir)).where(F.col("status") == records.OK))


def name_email_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(spark, sf_dir).select(*KEYS, match_score(F.col("name"), F.col("email")).cast("long").alias("score"))


def honorific_strip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _valid(spark, sf_dir).select(*KEYS, strip_honorific(F.col("name"), F.col("email")).alias("name"))


def domain_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.histogram(_valid(spark, sf_dir), ["source"]).select("source", "domain", "n", "first_pos")


def dominant_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.dominant_domain(_valid(spark, sf_dir), ["source"])


def typo_domain_fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.typo_fixes(domains.histogram(_valid(spark, sf_dir)))


def typo_domain_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = _valid(spark, sf_dir)
    return domains.apply_fixes(valid, domains.typo_fixes(domains.histogram(valid))).select(*KEYS, "email")


def truncated_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.truncated_domains(domains.histogram(_valid(spark, sf_dir))).select("domain", "whole")


def dedupe_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = records.dedupe(_valid(spark, sf_dir), list(KEYS))
    return kept.select(*KEYS, "email", "name", "phone", F.col("score").cast("long").alias("score"), "first_source", "first_row_pos")


def dedupe_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.duplicate_issues(_valid(spark, sf_dir), list(KEYS)).select(*KEYS, "reason", "note")


def mode1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.extract(registrations(spark, sf_dir)).records


def mode1_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.extract(registrations(spark, sf_dir)).issues.select(*KEYS, "stt", "raw_name", "raw_email", "raw_phone", "reason", "note")


def mode1_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.extract(registrations(spark, sf_dir)).counts


def per_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.counts_by_source(records.classify(registrations(spark, sf_dir)))


def stt_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registrations(spark, sf_dir).select(*KEYS, parse_stt(F.col("stt")).cast("long").alias("stt_no"))


def stt_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.stt_gaps(registrations(spark, sf_dir)).select("source", F.col("stt_no").cast("long").alias("stt_no"))


def stt_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.gap_warnings(registrations(spark, sf_dir)).select("source", "code", "missing", "most")


def after_stt_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.ordinals(registrations(spark, sf_dir)).select(*KEYS, "row_label")


def fill_forward_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registrations(spark, sf_dir).withColumn("unit", F.when(F.col("row_pos") % 6 == 0, F.col("raw_unit")))
    return sequence.fill_down(rows, "unit").select(*KEYS, "unit_filled")


def _titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some rows become titles of groups: a roman ordinal and the name of a unit, nothing else."""
    title = F.col("stt") == "IV"
    rows = registrations(spark, sf_dir)
    return rows.withColumn("raw_name", F.when(title, "Phòng Mẫu").otherwise(F.col("raw_name"))).withColumn("raw_email", F.when(~title, F.col("raw_email"))).withColumn("raw_phone", F.when(~title, F.col("raw_phone")))


def group_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.mark_group_titles(_titled(spark, sf_dir)).select(*KEYS, "is_group", "group")


def _wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every seventh row is the continuation of the one above: no name, and the rest of an address."""
    wrapped = F.col("row_pos") % 7 == 0
    rows = registrations(spark, sf_dir)
    return rows.withColumn("raw_name", F.when(~wrapped, F.col("raw_name"))).withColumn("raw_email", F.when(wrapped, F.lit("gov.vn")).otherwise(F.col("raw_email"))).withColumn("raw_phone", F.when(~wrapped, F.col("raw_phone")))


def continuation_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.merge_continuations(_wrapped(spark, sf_dir)).select(*KEYS, "stt", "n_rows", "raw_name", "raw_email", "raw_phone")


def _sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a workbook of three sheets: the second repeats much of the first."""
    rows = registrations(spark, sf_dir)
    sheet = (F.col("row_pos") % 3).cast("int")
    first = rows.select("source", sheet.alias("sheet_idx"), F.lit(0).alias("table_id"), "row_pos", F.lit(0).alias("col_idx"), F.col("raw_email").alias("value"))
    again = first.where("sheet_idx = 0 and row_pos % 4 > 0").withColumn("sheet_idx", F.lit(1))
    return first.unionByName(again)


def sheet_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sheets.sheet_stats(_sheet_cells(spark, sf_dir)).select("source", F.col("sheet_idx").cast("long").alias("sheet_idx"), "emails", "overlap", "skip")


def province_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registrations(spark, sf_dir).select(*KEYS, provinces.current_province(F.col("raw_unit")).alias("province"))


def province_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registrations(spark, sf_dir).select(*KEYS, provinces.mentioned_province(F.col("raw_unit")).alias("province"))


def to_chuc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registrations(spark, sf_dir).select(*KEYS, provinces.organisation(F.col("raw_unit"), "Cần Thơ").alias("to_chuc"))


def province_from_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return provinces.province_from_domains(_valid(spark, sf_dir))


def unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    units_ = registrations(spark, sf_dir).select("raw_unit").distinct()
    return units.normalize_units(units_, "Cần Thơ").select("raw_unit", "don_vi")


def mode2_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.extract(registrations(spark, sf_dir), with_unit=True, default="Cần Thơ").records


def mode2_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.extract(registrations(spark, sf_dir), with_unit=True, default="Cần Thơ").issues.select(*KEYS, "raw_unit", "reason", "note")


def mode2_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    final = pipelines.extract(registrations(spark, sf_dir), with_unit=True, default="Cần Thơ").records
    return final.groupBy("source").agg(F.count("*").alias("final_count"), F.count_if(F.col("to_chuc") == "").alias("to_chuc_missing"))


def freetext_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freetext.text_addresses(table(spark, sf_dir, "documents"), "doc_id", "text")


def page_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return freetext.text_addresses(table(spark, sf_dir, "pages"), "page_id", "html")


def search_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(registrations(spark, sf_dir), ["raw_name", "raw_email"], "DUNG").select(*KEYS, "raw_name", "raw_email")


def preview_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.preview(registrations(spark, sf_dir), "raw_name", list(KEYS)).select(*KEYS, "raw_name")


def used_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows under review lose a number that a record already has."""
    result = pipelines.extract(registrations(spark, sf_dir))
    cleared = recover.clear_used_phones(result.issues, result.records.select("source", "phone"))
    return cleared.select(*KEYS, "reason", "raw_phone", "phone_conflict")


def _shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows as arrays of cells; in every fifth the number stands in the address's cell and the address, cut before its last
    two letters, in the number's; in every fifth after it the address stands in a last column."""
    rows = registrations(spark, sf_dir)
    email, k = F.coalesce("raw_email", F.lit("")), F.col("row_pos") % 5
    cut = F.greatest(F.length(email) - 2, F.lit(0))
    fourth = F.when(k == 0, F.col("raw_phone")).when(k == 1, "").otherwise(email)
    fifth = F.when(k == 0, F.substr(email, F.lit(1), cut)).otherwise(F.col("raw_phone"))
    last = F.when(k == 0, F.substr(email, cut + 1)).when(k == 1, email).otherwise("")
    out = rows.select(*KEYS, F.array("stt", "raw_name", "raw_unit", fourth, fifth, last).alias("cells"), fourth.alias("raw_email"), fifth.alias("raw_phone"))
    return staged(out.withColumns({c: F.lit(i) for c, i in (("stt_col", 0), ("name_col", 1), ("email_col", 3), ("phone_col", 4))}))


def cell_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_cells(_shifted(spark, sf_dir)).select(*KEYS, "raw_email", "raw_phone")


def content_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of three column orders, read by what their cells hold."""
    rows = registrations(spark, sf_dir)
    one = F.array("stt", "raw_name", "raw_unit", "raw_email", "raw_phone")
    two = F.array("stt", "raw_email", "raw_name", "raw_phone", "raw_unit")
    three = F.array(F.lit(""), "stt", F.lit(""), "raw_name", "raw_phone", "raw_unit", "raw_email")
    k = F.col("row_pos") % 3
    parsed = content.parse_rows(staged(rows.select(*KEYS, F.when(k == 0, one).when(k == 1, two).otherwise(three).alias("cells"))))
    return parsed.select(*KEYS, "stt", "raw_name", "raw_unit", "raw_email", "raw_phone", "has_identity")


def group_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of people below titles of groups."""
    return units.units_of_rows(_titled(spark, sf_dir).withColumn("raw_unit", F.when(F.col("stt") != "IV", F.col("raw_unit")))).select(*KEYS, "raw_unit")


def unit_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of people in blocks that a sparse column names."""
    block = F.when(F.col("row_pos") % 9 == 0, "UBND xã Mẫu Năm").when(F.col("row_pos") % 9 == 4, "Sở Mẫu Sáu")
    rows = registrations(spark, sf_dir).withColumn("raw_group", block).withColumn("has_group", F.lit(True))
    return units.units_of_rows(rows).select(*KEYS, "raw_unit")


def asof_unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = registrations(spark, sf_dir)
    known = rows.select("source", parse_stt(F.col("stt")).alias("stt_no"), F.nullif("raw_unit", F.lit("")).alias("unit")).where("stt_no is not null and unit is not null")
    got = sequence.asof_unit(sequence.stt_gaps(rows), known)
    return got.select("source", F.col("stt_no").cast("long").alias("stt_no"), "unit")


def _one_list(rows: DataFrame) -> DataFrame:
    """The rows of all sources as one list, in eight ranges."""
    return scan.in_ranges(rows.withColumn("source", F.lit("all")), ["source"], staged, 8)


def long_list_continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.merge_continuations(_one_list(_wrapped(spark, sf_dir))).select(*KEYS, "stt", "n_rows", "raw_name", "raw_email", "raw_phone")


def long_list_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.mark_group_titles(_one_list(_titled(spark, sf_dir))).select(*KEYS, "is_group", "group")


def long_list_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    titled = _titled(spark, sf_dir).withColumn("raw_unit", F.when(F.col("stt") != "IV", F.col("raw_unit")))
    return units.units_of_rows(_one_list(titled)).select(*KEYS, "raw_unit")


def long_list_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.ordinals(_one_list(registrations(spark, sf_dir))).select(*KEYS, "row_label")


def long_list_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.stt_gaps(_one_list(registrations(spark, sf_dir))).select("source", F.col("stt_no").cast("long").alias("stt_no"))


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.ordinals(registrations(spark, sf_dir)).drop("stt_no", "last_stt")


def issue_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues and notes with the number that people see, which isn't the order of rows."""
    return pipelines.extract(_labelled(spark, sf_dir)).issues.select(*KEYS, "row_label", "reason", "note")


def template_binding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in a template whose columns stand in another order than ours: the header of the registrations' own list."""
    header = registrations(spark, sf_dir).limit(1).select(F.posexplode(F.array(*map(F.lit, ("STT", "Họ và tên", "E-mail", "Ghi chú", "SĐT", "Mật khẩu")))).alias("col_idx", "value"))
    return sinks.in_template(pipelines.extract(registrations(spark, sf_dir)).records, sinks.bind_header(header), "x")


def preview_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.preview(registrations(spark, sf_dir), "raw_phone", list(KEYS), descending=True).select(*KEYS, "raw_phone")


def preview_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page behind the one that ends with the 200th row."""
    rows = registrations(spark, sf_dir)
    last = search.preview(rows, "stt", list(KEYS)).collect()[-1]
    return search.preview(rows, "stt", list(KEYS), start=last.asDict()).select(*KEYS, "stt")


def all_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.paged(registrations(spark, sf_dir), "stt", list(KEYS), staged, 50).select(*KEYS, "stt", "nth", "page")


def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.counts(pipelines.extract(registrations(spark, sf_dir)).issues, ["raw_name", "reason"], "sai định")


def source_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbooks as sources: their sheets with addresses, which repeat earlier ones, and the default that they suggest."""
    cells = _sheet_cells(spark, sf_dir).withColumns({"file": F.concat("source", F.lit(".xlsx")), "kind": F.lit("xlsx"), "sheet_name": F.concat(F.lit("s"), F.col("sheet_idx").cast("string"))})
    return origins.relation(staged(cells))


def source_bulk_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return origins.with_default(source_relation(spark, sf_dir), "Huế").select("path", "sheet", "skip", "default")


def csv_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registrations written as CSV with line breaks and quotes in cells, and read again in splits of 4 KB: a file a
    source, and all of its splits are ranges of their own."""
    quoted = F.concat(F.col("raw_name"), F.when(F.col("row_pos") % 3 == 0, F.lit(' "x",\ny\n')).otherwise(""))
    rows = registrations(spark, sf_dir).select("source", "row_pos", "stt", quoted.alias("name"), "raw_email", "raw_phone")
    path = scratch_folder(spark)
    ordered = rows.repartition("source").sortWithinPartitions("source", "row_pos")
    ordered.write.partitionBy("source").option("quoteAll", True).option("escape", '"').option("emptyValue", "").option("ignoreTrailingWhiteSpace", False).csv(path)
    cells = read_csv(spark, path, split_bytes=4096)
    source = F.url_decode(F.regexp_extract("source", "/source=([^/]+)/", 1))
    return cells.select(source.alias("source"), "row_pos", F.col("col_idx").cast("long").alias("col_idx"), "value")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        email_normalize, email_classify, email_repair, phone_normalize, name_normalize, accent_fold, name_email_score, honorific_strip,
        domain_histogram, dominant_domain, typo_domain_fixes, typo_domain_apply, truncated_domains, dedupe_best_match, dedupe_notes,
        mode1_records, mode1_issues, mode1_stats, per_source_counts, stt_parse, stt_gaps, stt_warnings, after_stt_label, fill_forward_group,
        group_headers, continuation_rows, sheet_overlap, province_lookup, province_detect, to_chuc, province_from_domain, unit_normalize,
        mode2_records, mode2_issues, mode2_per_source, freetext_contacts, page_contacts, search_fold, preview_topk, used_phones, asof_unit,
        cell_search, content_rows, group_units, unit_blocks, long_list_continuations, long_list_titles, long_list_units, long_list_labels, long_list_gaps,
        source_relation, source_bulk_default, csv_ranges, issue_labels, template_binding, preview_natural, preview_next, all_pages, filter_counts,
    )
}
QUERIES |= list_queries.QUERIES
