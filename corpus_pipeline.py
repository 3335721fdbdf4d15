"""From raw documents to a training mix, in five stages of the operators in muster.llm.

Each stage gets what its predecessor kept, is written as Parquet in the shared folder and read again; all
but the last return the columns of documents. The last adds ``copy``, the number of the repetition.

Defined results: a null text goes in the first stage; a null source, lang or n_chars is a value like others; rows with a null
doc_id are judged by their own text and are nobody's copy (lines and near duplicates), and draw one hash in the mix; rows that
repeat a doc_id with its text share their fate; texts of any length are whole; further columns pass through, whatever their
names, except ``copy``, which the last stage overwrites; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.llm import decontaminate, language_id, line_dedup, mixing, ngram_join
from muster.llm.tables import kept, table


def identify_language(spark, docs, sf_dir):
    """Documents without a letter, or in none of the languages that ``lang`` names, go."""
    return language_id.train(docs).keep(docs)


def dedup_lines(spark, docs, sf_dir):
    """Repeated lines go; so do documents of which no word is left. n_chars follows the text."""
    lines = line_dedup.dedup_lines(docs).where(F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    return lines.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def join_near_duplicates(spark, docs, sf_dir):
    """One document of each class of near duplicates stays: the one of the smallest doc_id."""
    return ngram_join.drop_near_duplicates(docs).select(*docs.columns)


def remove_benchmark(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark, docs, sf_dir):
    """Each document as often as its source's target weight asks for."""
    return mixing.mix(docs)


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("ngram_jaccard_join", join_near_duplicates),
    ("decontaminate", remove_benchmark),
    ("mix_sources", mix_sources),
]

#: The forward algorithm of the first stage and the model that it needs are not SQL; tests/llm holds the
#: stages against brute force instead.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = kept(stage(spark, docs, sf_dir))
    return docs
