"""From raw rows to records and issues, and the best record of each address.

Rows are (source, row_pos, stt, raw_name, raw_email, raw_phone, ...); row_pos orders the rows of a source.
Nothing is invented and no row is lost: every row is a record or an issue with its reason.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.email import normalize_email
from ..functions.names import match_score, normalize_name, strip_honorific
from ..functions.phone import normalize_phone

# The reasons as reports show them.
REASONS = {"missing_email": "Thiếu email", "invalid_email_format": "Email sai định dạng", "duplicate_email": "Trùng email"}
OK = "ok"


def reason_label(reason: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for code, label in REASONS.items():
        out = out.when(reason == code, label)
    return out.otherwise(reason)


def classify(rows: DataFrame) -> DataFrame:
    """rows with email, name, phone and status (ok, missing_email or invalid_email_format)."""
    email = normalize_email(F.col("raw_email"))
    blank = F.trim(F.regexp_replace(F.coalesce("raw_email", F.lit("")), r"\s+", " ")) == ""
    found = rows.withColumn("email", email).withColumn("name", normalize_name(F.col("raw_name"))).withColumn("phone", normalize_phone(F.col("raw_phone")))
    return found.withColumn("status", F.when(F.col("email").isNotNull(), OK).when(blank, "missing_email").otherwise("invalid_email_format"))


def fit_names(records: DataFrame) -> DataFrame:
    """Names without a title that the address shows to be none of theirs."""
    return records.withColumn("name", strip_honorific(F.col("name"), F.col("email")))


def rank_duplicates(records: DataFrame, order: list[str]) -> DataFrame:
    """records with score, rank (1 is the one that stays: best score, then earliest), kept, the struct of the one
    that stays, and first_..., the place of the address's first occurrence. One shuffle and one sort by address."""
    fields = [c for c in ("source", "label", "row_pos", "row_label", "stt", "name") if c in records.columns]
    address = Window.partitionBy("email")
    by_email = address.orderBy(F.col("score").desc(), *order)
    scored = records.withColumn("score", match_score(F.col("name"), F.col("email")))
    ranked = scored.withColumn("rank", F.row_number().over(by_email)).withColumn("kept", F.first(F.struct(*fields)).over(by_email))
    ranked = ranked.withColumn("_first", F.min(F.struct(*order)).over(address))
    return ranked.withColumns({f"first_{c}": F.col(f"_first.{c}") for c in order}).drop("_first")


def winners(ranked: DataFrame) -> DataFrame:
    return ranked.where("rank = 1").drop("rank", "kept")


def losers(ranked: DataFrame) -> DataFrame:
    """The records that lost, with reason and a note that points at the one that stayed."""
    kept, shown = F.col("kept"), "label" if "label" in ranked.columns else "source"
    row = kept["row_label"] if "row_label" in ranked.columns else kept["row_pos"].cast("string")
    stt = F.nullif(kept["stt"], F.lit(""))
    where = F.when(stt.isNotNull(), F.concat(F.lit(" (STT "), stt, F.lit(")"))).otherwise("")
    where = F.when(row.isNotNull(), F.concat(F.lit("dòng "), row, where)).when(stt.isNotNull(), F.concat(F.lit("dòng STT "), stt)).otherwise("một dòng khác")
    note = F.concat(F.lit("Trùng email với "), where, F.lit(" - "), kept["name"], F.lit(" (tệp "), kept[shown], F.lit(")"))
    lost = ranked.where("rank > 1").withColumn("reason", F.lit("duplicate_email")).withColumn("note", note)
    return lost.drop("rank", "kept", *[c for c in lost.columns if c.startswith("first_")])


def dedupe(records: DataFrame, order: list[str]) -> DataFrame:
    """The best record of each address, with the place (first_...) of the address's first occurrence."""
    return winners(rank_duplicates(records, order))


def duplicate_issues(records: DataFrame, order: list[str]) -> DataFrame:
    return losers(rank_duplicates(records, order))


def issues(classified: DataFrame) -> DataFrame:
    """Rows without a certain address: raw values and reason."""
    return classified.where(F.col("status") != OK).withColumnRenamed("status", "reason").withColumn("note", F.lit(None).cast("string"))


def counts(classified: DataFrame, final: DataFrame, cut: DataFrame) -> DataFrame:
    """The funnel in one row. cut: the records that went for a cut domain, which count as invalid."""
    status = F.col("status")
    rows = classified.select(status.alias("what")).unionByName(final.select(F.lit("final").alias("what"))).unionByName(cut.select(F.lit("cut").alias("what")))
    n = lambda *codes: F.count_if(F.col("what").isin(*codes))
    return rows.agg(
        n(OK, "missing_email", "invalid_email_format").alias("total_rows"), (n(OK) - n("cut")).alias("valid_rows"), n("missing_email").alias("missing_email"),
        n("invalid_email_format", "cut").alias("invalid_email_format"), n("final").alias("final_count"), (n(OK) - n("cut") - n("final")).alias("duplicates_removed"),
    )


def counts_by_source(classified: DataFrame) -> DataFrame:
    status = F.col("status")
    return classified.groupBy("source").agg(
        F.count("*").alias("total_rows"), F.count_if(status == OK).alias("valid_rows"), F.count_if(status == "missing_email").alias("missing_email"),
        F.count_if(status == "invalid_email_format").alias("invalid_email_format"), F.count_if(F.col("phone") == "").alias("without_phone"),
    )
