"""Contacts in running text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.email import ADDRESS, all_addresses
from ..functions.names import NOISE_PATTERN
from ..functions.phone import NUMBER
from ..functions.text import deaccent, fold

# Labels (on text without accents), and blocks that describe the letter itself.
LABELS = {
    "email": r"(?i)(?:email|e-mail|mail)\s*[:\-]\s*(.+)",
    "phone": r"(?i)(?:so\s*dien\s*thoai|sdt|dien\s*thoai|phone|hotline|tel)\s*[:\-]\s*(.+)",
    "name": r"(?i)(?:ho\s*va\s*ten|ho\s*ten|full\s*name|ten\s*(?:tai\s*khoan)?|name)\s*[:\-]\s*(.+)",
}
ANNEX = r"^(?:phu luc|lien he|noi nhan|thong tin lien he)"


def text_addresses(texts: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """id, email, n: the addresses of each text and how often each occurs."""
    return texts.select(id_column, F.explode(all_addresses(F.col(text_column))).alias("email")).groupBy(id_column, "email").agg(F.count("*").alias("n"))


def blocks(texts: DataFrame) -> DataFrame:
    """source, block_no, block: text cut at blank lines; a text of one block with several addresses is cut
    before each repeated name label, else e-mail label, else address. texts: source, text."""
    parts = F.filter(F.split("text", r"\n\s*\n"), lambda x: F.trim(x) != "")
    many = F.size(F.regexp_extract_all("text", F.lit(ADDRESS), F.lit(0))) > 1
    plain = deaccent(F.col("text"))
    cuts = [r"\n(?=[^\n]{0,20}(?:họ và tên|họ tên|Họ và tên|Họ tên|full name|Full name)\s*[:\-])", r"\n(?=[^\n]{0,10}(?:[Ee]mail|E-mail|[Mm]ail)\s*[:\-])", rf"\n(?=[^\n@]*{ADDRESS})"]
    counted = [F.size(F.regexp_extract_all(plain, F.lit(LABELS[k]), F.lit(0))) > 1 for k in ("name", "email")]
    whole = F.when(counted[0], F.split("text", cuts[0])).when(counted[1], F.split("text", cuts[1])).otherwise(F.split("text", cuts[2]))
    chosen = F.when((F.size(parts) == 1) & many, whole).otherwise(parts)
    return texts.select("source", F.posexplode(chosen).alias("block_no", "block"))


def contacts(texts: DataFrame) -> DataFrame:
    """source, row_pos, stt, raw_name, raw_email, raw_phone of every block that shows a person."""
    b, plain = F.col("block"), deaccent(F.col("block"))
    label = {k: F.regexp_extract(plain, p, 1) for k, p in LABELS.items()}
    place = F.regexp_instr(plain, F.lit(LABELS["name"]))
    line = F.split(F.substr(b, place), "\n")
    labelled = F.when(label["name"] != "", F.trim(F.regexp_replace(F.element_at(line, 1), r"^[^:\-]*[:\-]\s*", "")))
    email = F.when(label["email"] != "", label["email"]).otherwise(F.nullif(F.regexp_extract(b, ADDRESS, 0), F.lit("")))
    phone = F.when(label["phone"] != "", label["phone"]).otherwise(F.regexp_extract(b, NUMBER, 0))
    usable = F.filter(F.split(b, "\n"), lambda x: (F.trim(x) != "") & ~fold(x).rlike(NOISE_PATTERN) & ~F.contains(x, F.lit("@")) & ~x.rlike(r"^[\d\s.+\-()]{1,20}$"))
    name = F.coalesce(labelled, F.trim(F.try_element_at(usable, F.lit(1))))
    rows = blocks(texts).select("source", F.col("block_no").cast("long").alias("row_pos"), F.lit(None).cast("string").alias("stt"), name.alias("raw_name"), email.alias("raw_email"), phone.alias("raw_phone"), fold(b).rlike(ANNEX).alias("_annex"), (label["name"] != "").alias("_labelled"))
    signal = F.col("raw_email").isNotNull() | F.col("_labelled") | (F.coalesce("raw_phone", F.lit("")) != "")
    return rows.where(signal & ~(F.col("_annex") & F.col("raw_email").isNull())).drop("_annex", "_labelled")
