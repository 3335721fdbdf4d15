"""Units: rolled up to the commune, parent agency or issuer that they belong to, with the province behind."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import capitalize_words, key, squeeze
from .provinces import current_province, province_of
from .scan import look, upto

# What precedes a level word that names no commune, what ends a name in lower-case text, units
# above or beside the commune, kinds of issuers, titles of jobs, and how units start.
_NOT_BEFORE = r"(?<!(?iu:thị|tác|các|cấp|những|mỗi|toàn)\s)(?<![\p{L}\p{N}])"
_STOP = r"(?!(?:huyện|quận|tỉnh|tp\.?|và|thuộc|thành\s+phố|thị\s+xã|thị\s+trấn)(?![\p{L}]))"
_MOTTO = r"(?!CỘNG\s+H(?:ÒA|OÀ)\s+XÃ\s+HỘI|ĐỘC\s+LẬP)"
ABOVE = r"(?iu)(?<![\p{L}])(?:tỉnh|thành\s*phố|(?<!trụ )sở|(?<!cán )bộ|cục|tổng\s*cục)(?![\p{L}])"
BESIDE = (
    r"(?iu)(?<![\p{L}])(?:huyện|quận|thị\s*xã|bệnh\s*viện|ngân\s*hàng|chi\s*nhánh|đại\s*học|cao\s*đẳng|kho\s*bạc|"
    r"bảo\s*hiểm\s*xã\s*hội|chi\s*cục|điện\s*lực|bưu\s*điện|viettel|vnpt|công\s*ty)(?![\p{L}])"
)
BODY = r"(?iu)^\s*(?:UBND|HĐND|Ủy\s*ban\s*nhân\s*dân|Hội\s*đồng\s*nhân\s*dân)\s+(xã|phường|thị\s*trấn)\s+(.+?)\s*$"
TITLES = (
    r"^(?:chuyên viên|nhân viên|viên chức|công chức|cán bộ|kế toán|văn thư|thủ quỹ|"
    r"giám đốc|phó|trưởng|chủ tịch|bí thư|chánh|chủ nhiệm|ủy viên|uỷ viên|thanh tra viên|"
    r"giáo viên|bác sĩ|y sĩ|điều dưỡng|kỹ thuật viên|lãnh đạo|thư ký|lái xe|bảo vệ|tạp vụ|"
    r"chi cục trưởng|cục trưởng|hiệu trưởng|hiệu phó|tổ trưởng|đội trưởng|trạm trưởng|"
    r"p\.\s*(?=[\p{L}\p{N}_])|pgđ(?![\p{L}\p{N}_])|gđ(?![\p{L}\p{N}_])|tp\.\s*(?=[\p{L}\p{N}_])|pp\.\s*(?=[\p{L}\p{N}_]))"
)
UNIT_STARTS = (
    r"^(?:phòng|ban|văn phòng|trung tâm|sở|bệnh viện|chi cục|cục|trạm|trường|viện|hội|đoàn|"
    r"ủy ban|uỷ ban|ubnd|hđnd|đảng ủy|đảng uỷ|mặt trận|công an|ban quản lý|thanh tra|kho bạc)(?![\p{L}\p{N}_])"
)

_SEP = r"[^\s,;:()/\-–]"
_LEVEL = r"(thị\s*trấn|xã|phường)"
_LOWER = f"{_NOT_BEFORE}{_LEVEL}((?:\\s+{_STOP}{_SEP}+){{1,5}})"
_UPPER = f"{_NOT_BEFORE}(THỊ\\s*TRẤN|XÃ|PHƯỜNG)((?:\\s+{_MOTTO}[\\p{{Lu}}\\p{{Nd}}]+(?![\\p{{L}}]))+)"
_MIXED = f"{_NOT_BEFORE}([Tt]hị\\s*[Tt]rấn|[Xx]ã|[Pp]hường)((?:\\s+[\\p{{Lu}}\\p{{Nd}}]{_SEP}*)+)"


def find_commune(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with ``out``: the last commune, ward or township that the column ``text`` names, as '<level> <name>';
    null if none.

    In text without capitals a name is up to five words; after a level in capitals its words are capitals;
    otherwise each word of it starts with a capital or digit. xã hội and xã viên are no communes.
    """
    c = F.col(text)
    lower = c == F.lower(c)
    hits = {"_lower": _LOWER, "_mixed": _MIXED, "_upper": _UPPER}

    def last(pattern: str) -> Column:
        both = F.zip_with(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)), lambda x, y: F.struct(F.lower(squeeze(x)).alias("level"), squeeze(y).alias("name")))
        return F.try_element_at(F.filter(both, lambda x: ~F.lower(x["name"]).rlike(r"^(?:hội|viên)$|^hội (?:chủ|việt nam)(?![\p{L}])")), F.lit(-1))

    found = rows.withColumns({k: last(p) for k, p in hits.items()})
    found = found.withColumn("_hit", F.when(lower, F.col("_lower")).otherwise(F.coalesce("_mixed", "_upper")))
    name = F.col("_hit.name")
    plain = F.when((name == F.upper(name)) | lower, F.initcap(name)).otherwise(name)
    level = F.concat(F.upper(F.substring("_hit.level", 1, 1)), F.substr("_hit.level", F.lit(2)))
    return found.withColumn(out, F.when(F.col("_hit").isNotNull(), F.concat(level, F.lit(" "), plain))).drop("_hit", *hits)


def is_job_title(c: Column) -> Column:
    return F.coalesce(F.lower(F.trim(c)).rlike(TITLES), F.lit(False))


def without_job_titles(c: Column) -> Column:
    """What follows up to four titles, if it is a unit of two words or more; else ''."""
    rest = F.trim(c)
    for _ in range(4):
        rest = F.regexp_replace(F.regexp_replace(rest, "(?iu)" + TITLES + r"[ ,\-–/]*", ""), r"[ ,\-–/]+$", "")
    return F.when(F.lower(rest).rlike(UNIT_STARTS) & rest.rlike(r"\S\s+\S"), rest).otherwise("")


def is_unit_name(c: Column) -> Column:
    """Units have two words or more; account names have none."""
    return F.contains(F.trim(F.coalesce(c, F.lit(""))), F.lit(" "))


def unit_under_group(unit: Column, group: Column) -> Column:
    """The unit of a row below a title: the title (without 'Cơ quan' before it) for a cell of a single word, none, or a
    job, else the cell. A null title changes nothing."""
    name = F.nullif(F.trim(F.regexp_replace(F.coalesce(group, F.lit("")), r"(?iu)^\s*cơ quan\s+", "")), F.lit(""))
    return F.when(~is_unit_name(unit), F.coalesce(name, unit)).when(name.isNotNull() & is_job_title(unit), name).otherwise(unit)


def parent_agency(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with ``out``: the department (Sở) that ends a list of units, without the province behind it; else null."""
    parts = F.filter(F.transform(F.split(text, r"\s+[-–—]\s+|,\s*|;\s*"), F.trim), lambda x: x != "")
    tail = r"(?iu)\s+(?:thành\s*phố|tỉnh|tp\.?)\s+(.+)$"
    split = rows.withColumn("_parts", parts).withColumn("_last", F.try_element_at("_parts", F.lit(-1)))
    known = split.withColumn("_known", current_province(F.regexp_extract("_last", tail, 1)).isNotNull())
    cut = known.withColumn("_cut", F.trim(F.when(F.col("_known"), F.regexp_replace("_last", tail, "")).otherwise(F.col("_last"))))
    ok = (F.size("_parts") > 1) & F.col("_last").rlike(r"(?iu)^Sở\s+\S") & F.contains(F.col("_cut"), F.lit(" "))
    return cut.withColumn(out, F.when(ok, F.col("_cut"))).drop("_parts", "_last", "_known", "_cut")


def expand_abbreviations(text: Column) -> Column:
    for pattern, full in ((r"(?iu)^\s*TT(?![\p{L}])\.?", "Trung tâm"), (r"(?iu)(?<![\p{L}])TP\.\s*", "Thành phố "), (r"(?iu)(?<![\p{L}])CĐCĐ(?![\p{L}])", "Cao đẳng Cộng đồng"), (r"(?iu)(?<![\p{L}])QLDA(?![\p{L}])", "Quản lý Dự án")):
        text = F.regexp_replace(text, pattern, full)
    return squeeze(text)


def units_of_rows(rows: DataFrame, by: list[str] = ["source"]) -> DataFrame:  # noqa: B006
    """The people among the rows of a table, with their raw_unit; titles of groups are dropped.

    rows: raw_name, raw_email, raw_phone, raw_unit; and, if they have them, raw_unit2 (the second column of a merged
    header), raw_group (a sparse column, filled on the first row of a block), has_group (their table has such a column) and
    fallback_unit.

    * A row without an address and number in which only the name or only the unit is filled is a title, unless the
      table has a sparse column.
    * raw_unit2 follows the unit if it differs.
    * Under a sparse value: its commune if it names one; itself for a blank unit or a job; the unit behind a job.
    * Under a title: ``unit_under_group``. A unit that is blank then is the fallback.
    """
    none = F.lit(None).cast("string")
    for c in ("raw_unit2", "raw_group", "fallback_unit"):
        if c not in rows.columns:
            rows = rows.withColumn(c, none)
    if "has_group" not in rows.columns:
        rows = rows.withColumn("has_group", F.lit(False))
    filled = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    one = filled("raw_name") != filled("raw_unit")
    title = ~F.col("has_group") & ~filled("raw_email") & ~filled("raw_phone") & one
    shown = F.when(filled("raw_name"), F.trim("raw_name")).otherwise(F.trim("raw_unit"))
    marked = rows.withColumn("_title", title)
    marked = look(marked, by, _group=upto(F.when(F.col("_title"), shown)), _block=upto(F.when(filled("raw_group"), F.trim("raw_group"))))
    blocks = find_commune(marked.select("_block").distinct().where("_block is not null"), "_block", "_commune")
    people = marked.where("not _title").join(blocks, "_block", "left")
    unit, second = F.trim(F.coalesce("raw_unit", F.lit(""))), F.trim(F.coalesce("raw_unit2", F.lit("")))
    people = people.withColumn("raw_unit", F.when((second != "") & (key(second) != key(unit)), F.trim(F.concat_ws(" ", unit, second))).otherwise(unit))
    unit, block = F.col("raw_unit"), F.col("_block")
    behind = F.nullif(without_job_titles(unit), F.lit(""))
    in_block = F.when(F.col("_commune").isNotNull(), F.col("_commune")).when(unit == "", block).when(is_job_title(unit), F.coalesce(behind, block)).otherwise(unit)
    people = people.withColumn("raw_unit", F.when(block.isNotNull(), in_block).otherwise(unit))
    people = people.withColumn("raw_unit", F.when(F.col("_group").isNotNull(), unit_under_group(unit, F.col("_group"))).otherwise(unit))
    people = people.withColumn("raw_unit", F.when(unit == "", F.coalesce("fallback_unit", unit)).otherwise(unit))
    return people.where(filled("raw_name") | filled("raw_email") | filled("raw_phone") | (unit != "")).drop("_title", "_group", "_block", "_commune", "raw_unit2", "raw_group", "has_group", "fallback_unit")


def normalize_units(rows: DataFrame, default: Column | str | None = None) -> DataFrame:
    """rows with don_vi: raw_unit in its canonical form, with ' - province' where one is certain; '' for a blank.

    doc_commune and doc_issuer, if rows have them, are those of the document that holds the row. Meant for the
    distinct units: they are few, and the result joins the rows. One step a column, so that no step's expression is
    copied into the next.
    """
    none = F.lit(None).cast("string")
    for c in ("doc_commune", "doc_issuer"):
        if c not in rows.columns:
            rows = rows.withColumn(c, none)
    steps = parent_agency(rows.withColumn("_cell", F.trim(F.coalesce("raw_unit", F.lit("")))), "_cell", "_parent")
    steps = steps.withColumn("_text", F.coalesce("_parent", "_cell"))
    title = F.col("doc_issuer").isNotNull() & F.col("doc_commune").isNull() & is_job_title(F.col("_text")) & (without_job_titles(F.col("_text")) == "")
    steps = steps.withColumn("_text", F.when(title, F.col("doc_issuer")).otherwise(F.col("_text")))
    steps = find_commune(steps, "_text", "_own")
    text, own, commune = F.col("_text"), F.col("_own"), F.col("doc_commune")
    longer = key(commune).startswith(key(own)) & (F.size(F.split(commune, " ")) - F.size(F.split(own, " "))).between(0, 2)
    from_document = own.isNull() & ~text.rlike(ABOVE) & ~text.rlike(BESIDE) & ~text.rlike(BODY)
    steps = steps.withColumn("_rolled", F.when(F.coalesce(longer, F.lit(False)) | from_document, commune).otherwise(own))
    steps = steps.withColumn("_level", F.regexp_extract(text, BODY, 1)).withColumn("_name", squeeze(F.regexp_extract(text, BODY, 2)))
    level = F.concat(F.upper(F.substring("_level", 1, 1)), F.lower(F.substr("_level", F.lit(2))))
    steps = steps.withColumn("_body", F.when(F.col("_name") != "", F.concat(level, F.lit(" "), capitalize_words(F.col("_name")))))
    steps = steps.withColumn("_bare", F.trim(F.regexp_replace(text, r"(?iu)^\s*(?:tỉnh|thành\s*phố)\s+", "")))
    steps = steps.withColumn("_is_province", F.col("_rolled").isNull() & F.col("_body").isNull() & current_province(F.col("_bare")).isNotNull())
    steps = steps.withColumn("_core", F.coalesce("_rolled", "_body", expand_abbreviations(text))).withColumn("_province", province_of(F.col("_cell"), default))
    whole = F.when(F.col("_province").isNotNull(), F.concat("_core", F.lit(" - "), "_province")).otherwise(F.col("_core"))
    out = steps.withColumn("don_vi", F.when(F.col("_cell") == "", "").when(F.col("_is_province"), F.col("_bare")).otherwise(whole))
    return out.drop(*[c for c in out.columns if c.startswith("_")])


def document_communes(headers: DataFrame, lines: int = 15) -> DataFrame:
    """source, doc_commune: the first commune that the first lines of each document name. headers: source, header."""
    kept = F.slice(F.filter(F.split("header", "\n"), lambda x: F.trim(x) != ""), 1, lines)
    each = find_commune(headers.select("source", F.posexplode(kept).alias("line_no", "line")), "line", "commune").where("commune is not null")
    return each.groupBy("source").agg(F.min_by("commune", "line_no").alias("doc_commune"))


def as_written(name: Column, body: Column) -> Column:
    """The name as the body writes it, if it does so with small letters and capitals; else as it is."""
    pattern = F.concat(F.lit("(?iu)"), F.regexp_replace(name, " ", r"\\s+"))
    found = F.filter(F.transform(F.regexp_extract_all(body, pattern, F.lit(0)), squeeze), lambda x: (x != F.upper(x)) & (x != F.lower(x)))
    return F.coalesce(F.try_element_at(found, F.lit(1)), name)


def document_issuer(header: Column, lines: int = 8) -> Column:
    """The agency in capitals that opens one of the first lines, each word capitalised; null if none does."""
    start = r"^((?:SỞ|BAN|TRUNG\s+TÂM|VĂN\s+PHÒNG|BỆNH\s+VIỆN|VIỆN|CHI\s+CỤC|CỤC|TỔNG\s+CỤC|TRƯỜNG|BẢO\s+TÀNG|THANH\s+TRA)(?:\s+" + _MOTTO + r"(?:[\p{Lu}\p{Nd}]+|và|VÀ|&)(?![\p{L}]))+)"
    kept = F.slice(F.filter(F.transform(F.split(header, "\n"), F.trim), lambda x: x != ""), 1, lines)
    return F.try_element_at(F.filter(F.transform(kept, lambda x: F.initcap(F.nullif(squeeze(F.regexp_extract(x, start, 1)), F.lit("")))), lambda x: x.isNotNull()), F.lit(1))
