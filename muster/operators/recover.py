"""Rows that a table lost, found again in the text of its pages."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.email import ADDRESS, normalize_email
from ..functions.names import normalize_name
from ..functions.ordinal import parse_stt, stt_list
from ..functions.phone import NUMBER, normalize_phone
from ..functions.text import squeeze
from .domains import dominant_domain

# Fixed value: what the start of a cut address looks like.
FRAGMENT = r"^[A-Za-z0-9._%+\-]+$"
# An ordinal (1 to 99999, as parse_stt has it) at the start of a line, and where a unit or position starts after a name.
LINE = r"^\s*(\d{1,5})\s+(.+)$"
UNIT = r"(?iu)(?<![\p{L}])(?:Văn phòng|Ban(?=\s|$)|UBND|HĐND|Ủy ban|Phòng|Trung tâm|Hội(?=\s|$)|Đoàn|Sở|Viện|Cơ quan|Đảng ủy|Trường|Trạm|Bệnh viện|Chi cục|Cục|Thanh tra|Công an|Xã|Phường)"
POSITION = r"(?iu)(?<![\p{L}])(?:Chuyên viên|Phó\s+(?:Chủ tịch|Trưởng|Giám đốc|Bí thư|Chánh|phòng)|Trưởng\s+(?:phòng|ban|khoa)|Giám đốc|Chủ tịch|Bí thư|Công chức|Viên chức|Cán bộ|Nhân viên|Kế toán|Văn thư)"


def lost_lines(doc_lines: DataFrame, gaps: DataFrame) -> DataFrame:
    """source, stt_no, line: the text of each missing ordinal. doc_lines: source, line_no, text (line_no runs
    through the pages). Up to two lines without an ordinal continue it; if each person takes two lines and
    the name stands above, that line is used instead."""
    w = Window.partitionBy("source").orderBy("line_no")
    number = F.regexp_extract("text", LINE, 1)
    lines = doc_lines.withColumn("number", F.nullif(number, F.lit(""))).withColumn("rest", F.regexp_extract("text", LINE, 2))
    for k in (1, 2):
        lines = lines.withColumn(f"next{k}", F.lead(F.struct("text", "number"), k).over(w))
    lines = lines.withColumn("above", F.lag(F.struct("text", "number")).over(w))
    head = F.trim(F.regexp_replace(F.regexp_replace(F.col("rest"), ADDRESS + ".*$", ""), NUMBER, " "))
    two = F.col("above.number").isNull() & ~F.contains(F.col("above.text"), F.lit("@")) & F.col("above.text").rlike(NUMBER) & ((head == "") | (F.regexp_instr(head, F.lit(UNIT)) == 1))
    go1 = F.col("next1.number").isNull() & (F.trim("next1.text") != "")
    go2 = go1 & F.col("next2.number").isNull() & (F.trim("next2.text") != "")
    below = F.concat_ws(" ", "rest", F.when(go1, F.trim("next1.text")), F.when(go2, F.trim("next2.text")))
    text = F.when(F.coalesce(two, F.lit(False)), F.concat_ws(" ", F.trim("above.text"), "rest")).otherwise(below)
    found = lines.where("number is not null").select("source", F.col("number").cast("int").alias("stt_no"), "line_no", text.alias("line"))
    hits = found.join(gaps, ["source", "stt_no"], "left_semi")
    return hits.groupBy("source", "stt_no").agg(F.min_by("line", "line_no").alias("line"))


def split_line(lines: DataFrame) -> DataFrame:
    """lines with raw_email, raw_phone, raw_name and raw_unit taken from line."""
    line = F.col("line")
    email = F.regexp_extract(line, ADDRESS, 0)
    phone = F.regexp_extract(F.regexp_replace(line, " ", ""), r"(?:\+?84|0)\d{8,10}", 0)
    before = squeeze(F.regexp_replace(F.regexp_replace(line, ADDRESS + ".*$", ""), NUMBER, " "))
    cut = F.regexp_instr(F.concat(F.lit(" "), F.substr(before, F.lit(2))), F.lit(UNIT))
    name = F.when(cut > 1, F.substr(before, F.lit(1), cut - 1)).otherwise(before)
    unit = F.when(cut > 1, F.substr(before, cut))
    job = F.regexp_instr(name, F.lit(POSITION))
    name = F.when(job > 1, F.substr(name, F.lit(1), job - 1)).otherwise(name)
    tidy = lambda c: F.regexp_replace(c, r"^[ \t\-|/,;:]+|[ \t\-|/,;:]+$", "")
    return lines.withColumns({"raw_email": F.nullif(email, F.lit("")), "raw_phone": F.nullif(phone, F.lit("")), "raw_name": tidy(name), "raw_unit": tidy(unit)})


def clear_used_phones(recovered: DataFrame, records: DataFrame) -> DataFrame:
    """recovered with phone_conflict, and without a phone that a record already has."""
    used = records.where("phone <> ''").select(F.col("phone").alias("used")).distinct()
    joined = recovered.withColumn("phone", normalize_phone(F.col("raw_phone"))).join(used, F.col("phone") == F.col("used"), "left")
    conflict = F.col("used").isNotNull()
    return joined.withColumn("phone_conflict", conflict).withColumn("raw_phone", F.when(conflict, F.lit(None)).otherwise(F.col("raw_phone"))).drop("phone", "used")


def drop_phantom_issues(issues: DataFrame, recovered: DataFrame) -> DataFrame:
    """issues without the missing_email rows that are a fragment of a recovered record (same name and phone)."""
    keys = recovered.select("source", normalize_name(F.col("raw_name")).alias("_name"), normalize_phone(F.col("raw_phone")).alias("_phone")).distinct()
    mine = issues.withColumn("_name", normalize_name(F.col("raw_name"))).withColumn("_phone", normalize_phone(F.col("raw_phone")))
    missing = mine.where("reason = 'missing_email'").join(keys, ["source", "_name", "_phone"], "left_anti")
    return missing.unionByName(mine.where("reason <> 'missing_email'")).drop("_name", "_phone")


def cut_cells(rows: DataFrame) -> DataFrame:
    """source, page, row_pos, stt, col_idx, fragment, digits: the rows of tables that may hold the start of a cut address.
    rows: source, page, row_pos, cells. No cell has an @, there are three cells or more, and from the third on one is
    letters and signs of an address, three or more; digits are those of the row's number."""
    cell = lambda c: F.trim(F.coalesce(c, F.lit("")))
    numbered = F.filter(F.transform("cells", lambda c, i: F.struct(i.alias("i"), cell(c).alias("c"))), lambda x: x["c"] != "")
    fragment = F.try_element_at(F.filter(numbered, lambda x: (x["i"] >= 2) & x["c"].rlike(FRAGMENT) & x["c"].rlike("[A-Za-z]") & (F.length(x["c"]) >= 3)), F.lit(1))
    phone = F.try_element_at(F.filter(numbered, lambda x: (x["i"] != F.col("_f.i")) & (normalize_phone(x["c"]) != "")), F.lit(1))["c"]
    open_ = rows.where((F.size("cells") >= 3) & ~F.exists("cells", lambda c: F.contains(cell(c), F.lit("@")))).withColumn("_f", fragment).where("_f is not null")
    return open_.select("source", "page", "row_pos", cell(F.element_at("cells", 1)).alias("stt"), F.col("_f.i").alias("col_idx"), F.col("_f.c").alias("fragment"), F.coalesce(F.regexp_replace(phone, r"\D", ""), F.lit("")).alias("digits"))


def repair_cut_emails(rows: DataFrame, words: DataFrame, stage: Callable[[DataFrame], DataFrame], gap: float = 16.0, column: float = 3.0, steps: int = 4) -> DataFrame:
    """source, page, row_pos, stt, col_idx, email: addresses that a column's border cut, rebuilt from the words of the page.

    rows: source, page, row_pos, cells; words: source, page, text, x0, top (where a word stands). A word that starts with the
    fragment is continued by the nearest word below it in its column, at most ``gap`` lower, up to ``steps`` times, until the
    address ends with the most frequent domain of its source (three times or more). Digits at a word's end that start the
    row's own number are taken off it. A word with an @ inside belongs to the next address. Only a valid address in that
    domain which starts with the fragment counts; of several starting words the one that goes on with a dot or @ is
    taken first, then the upper one, and no word starts two addresses: rows with one fragment take them in order.
    A word that is a row's whole fragment starts no address of a shorter fragment; if a page has as many such words as rows
    with the fragment, each is the word of the row in its place, also if it leads to no valid address.
    """
    key = ["source", "page", "row_pos"]
    found = rows.select("source", F.col("row_pos"), F.explode(F.transform("cells", normalize_email)).alias("email")).where("email is not null")
    dominant = dominant_domain(found, ["source"]).select("source", "domain")
    cut = cut_cells(rows).join(dominant, "source")
    placed = words.withColumn("_head", F.substring("text", 1, 3)).withColumn("_word", F.monotonically_increasing_id())
    alike = Window.partitionBy("source", "page", "text")
    placed = stage(placed.withColumns({"_band": F.floor(F.col("top") / gap), "_words": F.count("*").over(alike), "_nth_word": F.row_number().over(alike.orderBy("top", "x0", "_word"))}))
    same = ["source", "page", "fragment"]
    cut = stage(cut.withColumns({"_rows": F.count("*").over(Window.partitionBy(*same)), "_nth": F.row_number().over(Window.partitionBy(*same).orderBy("row_pos", "stt"))}))
    owned = cut.select("source", "page", F.col("fragment").alias("text"), F.lit(True).alias("_owned")).distinct()
    begun = cut.withColumn("_head", F.substring("fragment", 1, 3)).join(placed, ["source", "page", "_head"]).where(F.col("text").startswith(F.col("fragment")))
    own = (F.col("text") == F.col("fragment")) & ((F.col("_words") != F.col("_rows")) | (F.col("_nth_word") == F.col("_nth")))
    starts = begun.join(owned, ["source", "page", "text"], "left").where(F.col("_owned").isNull() | own)

    def clean(text: Column) -> Column:
        tail = F.regexp_extract(text, r"\d{3,}$", 0)
        return F.when((tail != "") & F.col("digits").startswith(tail), F.substr(text, F.lit(1), F.length(text) - F.length(tail))).otherwise(text)

    follows = F.substr("text", F.length("fragment") + 1, F.lit(1))
    now = starts.select(*key, "stt", "col_idx", "fragment", "digits", "domain", F.col("_word").alias("start"), F.col("x0").alias("x"), "top", F.col("top").alias("y"), clean(F.col("text")).alias("built"), follows.isin("", ".", "@").alias("good"))
    below = placed.select("source", "page", F.col("_band"), F.col("text").alias("next"), F.col("x0"), F.col("top").alias("next_top"), "_word")
    for _ in range(steps):
        whole = F.contains("built", F.lit("@")) & F.lower("built").endswith(F.col("domain"))
        bands = now.withColumn("_band", F.explode(F.sequence(F.floor(F.col("top") / gap), F.floor(F.col("top") / gap) + 1)))
        near = bands.join(below, ["source", "page", "_band"]).where((F.col("_word") != F.col("start")) & (F.abs(F.col("x0") - F.col("x")) < column) & (F.col("next_top") > F.col("top") + 1) & (F.col("next_top") <= F.col("top") + gap))
        nearest = near.groupBy(*key, "start").agg(F.min(F.struct("next_top", "_word", "next")).alias("n"))
        joined = now.join(nearest, [*key, "start"], "left")
        other = F.contains("n.next", F.lit("@")) & ~F.col("n.next").startswith("@")
        goes_on = F.coalesce(~whole & ~other, F.lit(False))
        moved = {"built": F.when(goes_on, F.concat("built", clean(F.col("n.next")))).otherwise(F.col("built")), "top": F.when(goes_on, F.col("n.next_top")).otherwise(F.col("top"))}
        now = joined.withColumns(moved).drop("n")
    email = normalize_email(F.col("built"))
    valid = now.withColumn("email", email).where((F.substring_index("email", "@", -1) == F.col("domain")) & F.col("email").startswith(F.lower("fragment")))
    row = stage(valid.withColumn("nth_row", F.dense_rank().over(Window.partitionBy(*same).orderBy("row_pos"))).withColumn("nth_start", F.dense_rank().over(Window.partitionBy(*same).orderBy(F.desc("good"), "y", "x", "start"))))
    picked = row.where("nth_row = nth_start")
    once = picked.withColumn("_first", F.row_number().over(Window.partitionBy("source", "page", "start").orderBy("row_pos"))).where("_first = 1")
    return once.select(*key, "stt", "col_idx", "email")


def with_repaired(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """rows with the repaired addresses in the cells of their fragments."""
    joined = rows.join(repaired.select("source", "page", "row_pos", "col_idx", "email"), ["source", "page", "row_pos"], "left")
    cells = F.when(F.col("email").isNull(), F.col("cells")).otherwise(F.transform("cells", lambda c, i: F.when(i == F.col("col_idx"), F.col("email")).otherwise(c)))
    return joined.withColumn("cells", cells).drop("email", "col_idx")


def repair_warnings(repaired: DataFrame) -> DataFrame:
    """source, code, message: which ordinals of a source got their address back."""
    each = repaired.groupBy("source").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(parse_stt(F.col("stt")))).alias("nos"))
    message = F.concat(F.lit("khôi phục "), F.col("n").cast("string"), F.lit(" email bị cắt theo viền ô bảng (STT "), stt_list(F.col("nos")), F.lit(") - hãy đối chiếu email với tệp gốc"))
    return each.select("source", F.lit("cut_email_repaired").alias("code"), message.alias("message"))
