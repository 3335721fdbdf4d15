"""The two pipelines: files (or rows) in; records, issues, warnings and counts out."""

from __future__ import annotations

import functools
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import content, context, domains, freetext, origins, profile, provinces, records, recover, scan, sequence, sheets, units
from ..functions.names import normalize_name
from ..operators.cells import search_cells
from ..sources import errors, label_sheets, read_cells
from ..staging import staged

#: Rows of table t have places from t * PLACE on.
PLACE = 1 << 32
#: A list of more rows is worked on in ranges, as many tasks as its size asks for.
LONG = 1_000_000


@dataclass
class Source:
    """A file (or folder), the organisation that its people belong to if their rows don't say, and the sheet to read."""

    path: str
    default: str | None = None
    sheet: str | None = None


@dataclass
class Result:
    """records; issues, the rows that are none, with their reason; warnings of what may be missing without a trace;
    counts, the funnel in one row; sources, what each gave; recovered (source, stt_no, name), the rows that the text of the
    sources' pages gave back."""

    records: DataFrame
    issues: DataFrame
    warnings: DataFrame
    counts: DataFrame
    sources: DataFrame
    recovered: DataFrame | None = None


def _order(rows: DataFrame) -> list[str]:
    return [c for c in ("source_no", "source", "row_pos") if c in rows.columns]


# tables to rows


def _listed(rows: DataFrame, by: list[str]) -> DataFrame:
    """rows, written; in ranges if one of their lists is long."""
    rows = staged(rows)
    longest = rows.groupBy(*by).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    return scan.in_ranges(rows, by, staged) if longest > LONG else rows


def _column_maps(cells: DataFrame, rich: bool) -> DataFrame:
    """source, table_id, header_pos, field, col_idx: from the header of each table, or, where none has an e-mail or name
    column, from its contents (header_pos -1)."""
    columns = [*profile.TABLE, "header_pos", "field", "col_idx"]
    headed = staged(profile.rich_header_map(cells) if rich else profile.header_map(cells))
    bare = cells.join(headed.select(*profile.TABLE).distinct(), profile.TABLE, "left_anti")
    guessed = profile.infer_map(bare).withColumn("header_pos", F.lit(-1).cast("long"))
    fields = headed.select(*columns).unionByName(guessed.select(*columns))
    if rich:
        return staged(fields.unionByName(profile.sparse_group(cells, headed).select(*columns)))
    fields = staged(fields)
    head = fields.select(*profile.TABLE, "header_pos").distinct()
    phone = profile.guess_phone(cells, fields).join(head, profile.TABLE).select(*profile.TABLE, "header_pos", F.lit("phone").alias("field"), "col_idx")
    return staged(fields.unionByName(phone))


def _from_top(cells: DataFrame) -> DataFrame:
    """cells whose tables start with their first filled row."""
    top = cells.groupBy(*profile.TABLE).agg(F.min("row_pos").alias("_top"))
    return cells.join(top, profile.TABLE).withColumn("row_pos", F.col("row_pos") - F.col("_top")).drop("_top")


def _logical(cells: DataFrame) -> DataFrame:
    """The tables of documents, with those that go on over several pages as one."""
    heads = profile.header_map(cells).select(*profile.TABLE, "header_pos").distinct()
    rows = profile.row_arrays(cells).join(heads, profile.TABLE, "left")
    merged = sequence.logical_tables(rows.select("source", F.col("table_id").alias("table_idx"), "row_pos", "cells", F.coalesce("header_pos", F.lit(0)).alias("header_pos")))
    return profile.from_arrays(merged.select("source", F.col("logical_id").cast("int").alias("table_id"), "row_pos", "cells"))


def _named(rows: DataFrame) -> DataFrame:
    place = F.col("table_id").cast("long") * PLACE + F.col("row_pos")
    email = F.coalesce(F.when(F.trim("email") != "", F.col("email")), "email_alt")
    return rows.select(
        "source", "table_id", place.alias("row_pos"), "stt", F.col("name").alias("raw_name"), "unit", "unit2", "group", email.alias("raw_email"), F.col("phone").alias("raw_phone"),
        "cells", "email_col", "phone_col", "stt_col", "name_col", "group_col",
    )


def _mended(cells: DataFrame, words: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(cells, warnings): cells of documents with the addresses that a column's border cut, from the words of their pages
    (source, page, text, x0, top; a table's number is its page)."""
    if words is None:
        return cells, None
    own = cells.where("kind = 'docx' and table_id >= 0")
    rows = staged(profile.row_arrays(own.select(*profile.TABLE, "row_pos", "col_idx", "value")).withColumnRenamed("table_id", "page"))
    repaired = staged(recover.repair_cut_emails(rows, words, staged))
    found = repaired.select("source", F.col("page").alias("table_id"), "row_pos", "col_idx", "email")
    mended = cells.join(found, ["source", "table_id", "row_pos", "col_idx"], "left").withColumn("value", F.coalesce("email", "value")).drop("email")
    return staged(mended.select(*cells.columns)), recover.repair_warnings(repaired)


def _kinds(cells: DataFrame) -> set[str]:
    """The kinds of files (three at most) that give cells: steps for others are left out of the plan."""
    return {r.kind for r in cells.select("kind").distinct().collect()} or {"csv"}


def _union(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def mode1_rows(cells: DataFrame) -> DataFrame:
    """source, row_pos, row_label, stt, raw_name, raw_email, raw_phone of all tables, and of the running text of documents.

    row_pos is the order only; people see row_label: the ordinal, the one before ('sau STT N'), or the number of the row
    in a table without ordinals, or of the block in a text.
    """
    document = F.col("kind") == "docx"
    has = _kinds(cells)
    in_tables = cells.where("table_id >= 0")
    kinds = cells.select("source", document.alias("is_document")).distinct()
    columns = [*profile.TABLE, "row_pos", "col_idx", "value"]
    by = ["source", "table_id"]
    parts = []
    if has - {"docx"}:
        parts.append(_from_top(in_tables.where(~document).select(*columns)))
    if "docx" in has:
        parts.append(_logical(in_tables.where(document).select(*columns)))
    tables = staged(_union(parts))
    rows = _listed(_named(profile.to_rows(tables, _column_maps(tables, rich=False))).join(kinds, "source"), by)
    plain = rows.where("not is_document")
    if "docx" in has:
        wrapped = sequence.merge_continuations(sequence.join_name_fragments(rows.where("is_document"), by), by)
        plain = plain.unionByName(wrapped, allowMissingColumns=True)
    plain = sequence.drop_group_titles(plain, by)
    keep = ["source", "row_pos", "row_label", "stt", "raw_name", "raw_email", "raw_phone"]
    found = search_cells(sequence.ordinals(plain, by)).select(*keep)
    if "docx" not in has:
        return staged(found)
    lines = cells.where("table_id < 0").groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("row_pos", "value"))).alias("lines"), F.max("row_pos").alias("last"))
    line = lambda i: F.coalesce(F.try_element_at("lines", i), F.lit(""))
    texts = lines.select("source", F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), F.col("last")), line), "\n").alias("text"))
    people = freetext.contacts(texts).withColumn("row_label", (F.col("row_pos") + 1).cast("string")).withColumn("row_pos", F.col("row_pos") + (PLACE << 20)).select(*keep)
    return staged(found.unionByName(people))


def mode2_rows(cells: DataFrame) -> DataFrame:
    """source, row_pos, row_label, stt, raw_name, raw_unit, raw_email, raw_phone, doc_commune, doc_issuer of all tables.
    row_label is the row of the sheet; rows of documents are known by their ordinal."""
    document = F.col("kind") == "docx"
    has, parts = _kinds(cells), []
    columns = [*profile.TABLE, "row_pos", "col_idx", "value"]
    keep = ["source", "row_pos", "row_label", "stt", "raw_name", "raw_unit", "raw_email", "raw_phone", "doc_commune", "doc_issuer"]
    if has - {"docx"}:
        sheet = staged(cells.where(~document).select(*columns))
        fields = _column_maps(sheet, rich=True)
        where = context.table_context(sheet, fields)
        rows = _named(profile.to_rows(sheet, fields)).join(where, profile.TABLE, "left")
        rows = rows.withColumn("has_group", F.col("group_col").isNotNull()).withColumnsRenamed({"unit": "raw_unit", "unit2": "raw_unit2", "group": "raw_group"})
        rows = _listed(rows.withColumn("row_label", (F.col("row_pos") % PLACE + 1).cast("string")), profile.TABLE)
        parts.append(units.units_of_rows(rows, profile.TABLE).select(*keep))
    if "docx" in has:
        pages = staged(cells.where(document).select(*columns))
        in_tables = pages.where("table_id >= 0")
        flat = content.flatten_tables(in_tables, staged(profile.rich_header_map(in_tables)))
        named = content.assemble_rows(_listed(content.parse_rows(flat), ["source"])).join(context.document_context(pages), "source", "left")
        unit = F.when(F.col("group").isNotNull(), units.unit_under_group(F.col("raw_unit"), F.col("group"))).otherwise(F.col("raw_unit"))
        unit = F.when(F.trim(F.coalesce(unit, F.lit(""))) == "", F.coalesce("fallback_unit", F.lit(""))).otherwise(unit)
        parts.append(named.withColumn("raw_unit", unit).withColumn("row_label", F.lit(None).cast("string")).select(*keep))
    return staged(_union(parts))


# rows to records


def _restored(rows: DataFrame, lines: DataFrame, with_unit: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows with those that their tables lost and the text of their pages has, warnings, the recovered rows)."""
    gaps = sequence.stt_gaps(rows)
    found = staged(recover.split_line(recover.lost_lines(lines, gaps)))
    known = records.classify(rows).where(F.col("status") == records.OK)
    cleared = staged(recover.clear_used_phones(found, known.select("source", "phone")))
    spared = cleared.where("phone_conflict").select("source", F.lit("phone_in_use").alias("code"), F.format_string("STT %d: SĐT khôi phục từ văn bản gốc đã thuộc về người khác nên để trống", "stt_no").alias("message"))
    numbered = rows.withColumn("_no", sequence.parse_stt(F.col("stt")))
    at = numbered.where("_no is not null").groupBy("source", F.col("_no").alias("stt_no")).agg(F.max("row_pos").alias("unit"))
    after = sequence.asof_unit(cleared.select("source", "stt_no"), at.withColumn("unit", F.col("unit").cast("string"))).withColumnRenamed("unit", "_after")
    new = cleared.join(after, ["source", "stt_no"]).withColumn("row_pos", F.coalesce(F.col("_after").cast("long"), F.lit(0))).withColumn("stt", F.col("stt_no").cast("string"))
    if with_unit:
        units_ = numbered.where("_no is not null and trim(raw_unit) <> ''").select("source", F.col("_no").alias("stt_no"), F.col("raw_unit").alias("unit"))
        near = sequence.asof_unit(cleared.select("source", "stt_no"), units_).withColumnRenamed("unit", "_unit")
        new = new.join(near, ["source", "stt_no"]).withColumn("raw_unit", F.coalesce("raw_unit", "_unit"))
    if "row_label" in rows.columns:
        new = new.withColumn("row_label", F.col("stt"))
    about = [c for c in rows.columns if c not in ("row_pos", "row_label", "stt", "raw_name", "raw_unit", "raw_email", "raw_phone", "source")]
    sources = rows.groupBy("source").agg(*[F.first(c, ignorenulls=True).alias(c) for c in about]) if about else rows.select("source").distinct()
    new = new.join(sources, "source").select(*rows.columns)
    return staged(rows.unionByName(new)), spared, staged(new)


def _warnings(rows: DataFrame, classified: DataFrame, good: DataFrame, fixes: DataFrame, with_unit: bool) -> DataFrame:
    message = lambda frame, code, text: frame.select("source", F.lit(code).alias("code"), text.alias("message"))
    out = sequence.gap_warnings(rows).select("source", "code", "message")
    phones = good.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("phone") != "").alias("known")).where("n >= 3 and known = 0")
    out = out.unionByName(message(phones, "no_phone", F.format_string("Không có số điện thoại nào trong %d bản ghi - kiểm tra tiêu đề cột SĐT", "n")))
    out = out.unionByName(message(fixes, "typo_domain_fixed", F.concat(F.lit("@"), "old", F.lit(" → @"), "new")))
    if with_unit:
        blank = good.groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("don_vi") != "").alias("known")).where("n >= 3 and known = 0")
        out = out.unionByName(message(blank, "no_unit", F.format_string("Không có Đơn vị nào trong %d bản ghi - kiểm tra cột Đơn vị công tác", "n")))
        out = out.unionByName(provinces.default_mismatch(good))
    return out


def extract(rows: DataFrame, with_unit: bool = False, default: str | None = None, dedupe: bool = True, lines: DataFrame | None = None) -> Result:
    """Mode 1, or mode 2 (with_unit): rows of any number of sources. Domain statistics are over all sources in
    mode 1 and per source in mode 2; duplicates are looked for over all sources in both. lines (source, line_no, text):
    the text of the sources' pages, in which missing ordinals are looked for. Rows may have a default of their own, a
    label to be shown for their source, and source_no, the order of the sources."""
    by, order = (["source"] if with_unit else []), _order(rows)
    found = None
    if lines is not None:
        rows, spared, found = _restored(rows, lines, with_unit)
    if with_unit and "default" not in rows.columns:
        rows = rows.withColumn("default", F.lit(default).cast("string"))
    classified = staged(records.classify(rows))
    ok = records.fit_names(classified.where(F.col("status") == records.OK))
    fixes = domains.typo_fixes(domains.histogram(ok, by), by)
    fixed = staged(domains.apply_fixes(ok, fixes, by))
    good, cut = domains.drop_truncated(fixed, domains.truncated_domains(domains.histogram(fixed, by), by), by)
    if with_unit:
        about = [c for c in ("raw_unit", "default", "doc_commune", "doc_issuer") if c in good.columns]
        lookup = units.normalize_units(good.select(*about).distinct(), F.col("default"))
        lookup = lookup.withColumn("to_chuc", provinces.organisation(F.coalesce("raw_unit", F.lit("")), F.col("default")))
        lookup = staged(lookup.select(*[F.col(c).alias(f"_{c}") for c in about], "don_vi", "to_chuc"))
        same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in about]
        good = good.join(lookup, same, "left").drop(*[f"_{c}" for c in about])
    ranked = staged(records.rank_duplicates(good, order)) if dedupe else staged(good)
    final = records.winners(ranked) if dedupe else ranked
    shown = "label" if "label" in rows.columns else "source"
    named = lambda frame: frame.drop("source").withColumnRenamed(shown, "source") if shown != "source" else frame
    label = ["row_label"] if "row_label" in rows.columns else []
    keep = ["source", "row_pos", *label, "stt", "raw_name", *(["raw_unit"] if with_unit else []), "raw_email", "raw_phone", "reason", "note"]
    lost = records.issues(classified)
    if found is not None:
        lost = recover.drop_phantom_issues(lost, found)
    issues = named(lost).select(*keep).unionByName(named(cut).withColumn("reason", F.lit("invalid_email_format")).withColumn("note", F.lit(None).cast("string")).select(*keep))
    if dedupe:
        issues = issues.unionByName(named(records.losers(ranked)).select(*keep))
    out = ["source", "row_pos", "stt", "email", "name", "phone", *(["don_vi", "to_chuc"] if with_unit else [])]
    warnings = _warnings(rows, classified, ranked, fixes if with_unit else fixes.withColumn("source", F.lit("")), with_unit)
    if lines is not None:
        warnings = warnings.unionByName(spared)
    if shown != "source":
        labels = rows.select("source", "label").distinct()
        warnings = warnings.join(labels, "source", "left").select(F.coalesce("label", "source").alias("source"), "code", "message")
    sources = named(classified).groupBy("source").agg(F.count("*").alias("total_read")).join(named(final).groupBy("source").agg(F.count("*").alias("final_count")), "source", "left").na.fill(0, ["final_count"])
    recovered = None
    if found is not None:
        recovered = named(found).select("source", sequence.parse_stt(F.col("stt")).alias("stt_no"), normalize_name(F.col("raw_name")).alias("name"))
    return Result(named(final).select(*out), issues, warnings.distinct(), records.counts(classified, final, cut), sources, recovered)


# files to records


def _wanted(sources: list[str | Source] | DataFrame) -> list[Source]:
    """The list of sources; of a table of them (``operators.origins``) those that aren't left out. It is as long as the
    list that people choose from."""
    if isinstance(sources, DataFrame):
        return [Source(r.path, r.default, r.sheet) for r in origins.active(sources).select("path", "default", "sheet").orderBy("path", "sheet").collect()]
    return [s if isinstance(s, Source) else Source(s) for s in sources]


def list_sources(spark: SparkSession, paths: list[str], default: str | None = None) -> DataFrame:
    """The sources that files give, to look over and change (``operators.origins``) before run_mode2. A file that can't be
    read is listed too; the run warns of it."""
    cells = read_cells(spark, paths)
    return staged(origins.relation(cells, default))


def _read(spark: SparkSession, sources: list[str | Source] | DataFrame, every: bool) -> tuple[DataFrame, DataFrame]:
    """(cells of the sheets to read, with label and default; warnings). Each file is parsed once."""
    wanted = _wanted(sources)
    about = spark.createDataFrame([(k, s.default, s.sheet) for k, s in enumerate(wanted)], "source_no int, default string, wanted string")
    parsed = read_cells(spark, [s.path for s in wanted])
    # one file that is asked for several times is a source each time
    cells = parsed.where("error is null").drop("error").join(F.broadcast(about), "source_no")
    many = cells.select("source", "source_no").distinct().groupBy("source").agg((F.count("*") > 1).alias("_many"))  # a row a path
    cells = cells.join(F.broadcast(many), "source").withColumn("source", F.when(F.col("_many"), F.concat("source", F.lit("#"), F.col("source_no").cast("string"))).otherwise(F.col("source")))
    picked = staged(sheets.pick_sheets(cells, every=every))
    unknown = cells.where("wanted is not null").select("source", "file", "wanted").distinct().join(picked.select("source").distinct(), "source", "left_anti")
    stats = sheets.sheet_stats(cells.where("kind = 'xlsx' and wanted is null"))
    warnings = errors(parsed).unionByName(sheets.skip_warnings(stats, cells))
    warnings = warnings.unionByName(unknown.select("source", F.lit("source_unreadable").alias("code"), F.format_string("%s: không tìm thấy sheet '%s'", "file", "wanted").alias("message")))
    if not every:
        fields = profile.rich_header_map(cells.where("kind = 'xlsx'"))
        warnings = warnings.unionByName(sheets.people_warnings(stats, cells, fields))
    shown = label_sheets(picked) if every else label_sheets(picked.withColumn("parts", F.col("_many").cast("int") + 1), always=False)
    return staged(shown), warnings


def _about(rows: DataFrame, cells: DataFrame) -> DataFrame:
    return rows.join(cells.select("source", "source_no", "label", "default").distinct(), "source")


def _with(result: Result, warnings: DataFrame) -> Result:
    files = F.element_at(F.split("source", "/"), -1)
    result.warnings = result.warnings.unionByName(warnings.withColumn("source", files)).distinct()
    return result


def run_mode1(spark: SparkSession, sources: list[str | Source] | DataFrame, dedupe: bool = True, lines: DataFrame | None = None, words: DataFrame | None = None) -> Result:
    """Addresses, names and numbers of the people in the files. lines and words: the text of the sources' pages and where
    its words stand, with a source's whole path, for rows that tables lost and addresses that they cut."""
    cells, warnings = _read(spark, sources, every=True)
    cells, mended = _mended(cells, words)
    result = extract(staged(_about(mode1_rows(cells), cells)).drop("default"), dedupe=dedupe, lines=lines)
    return _with(result, warnings if mended is None else warnings.unionByName(mended))


def run_mode2(
    spark: SparkSession, sources: list[str | Source] | DataFrame, default: str | None = None, dedupe: bool = True, lines: DataFrame | None = None, words: DataFrame | None = None,
) -> Result:
    """The same with unit and organisation. default is that of the sources without one of their own."""
    cells, warnings = _read(spark, sources, every=False)
    cells, mended = _mended(cells, words)
    rows = staged(_about(mode2_rows(cells), cells).withColumn("default", F.coalesce("default", F.lit(default))))
    return _with(extract(rows, with_unit=True, dedupe=dedupe, lines=lines), warnings if mended is None else warnings.unionByName(mended))
