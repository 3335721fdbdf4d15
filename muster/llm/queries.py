"""The queries of this subpackage and, where SQL can express them, their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, hard_negatives, language_id, line_dedup, mixing, ngram_join, oracle, pii, quality_classifier, quality_rules, suffix_dedup, toxicity, whitening
from .tables import table


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_decontaminate": op2_decontaminate,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_ngram_jaccard_join": ngram_join.op4_ngram_jaccard_join,
    "op5_language_id": language_id.op5_language_id,
    "op6_pii": pii.op6_pii,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_mix_sources": mixing.op8_mix_sources,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_quality_classifier": quality_classifier.op10_quality_classifier,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_exact_dedup": exact_dedup.op13_exact_dedup,
}
#: op5, op6, op9, op10 and op11 are held against brute force or held-out accuracy in tests/llm instead.
ORACLE_SQL = {
    "op1_line_dedup": line_dedup.SQL,
    "op2_decontaminate": oracle.DECONTAMINATE,
    "op3_quality_rules": oracle.QUALITY_RULES,
    "op4_ngram_jaccard_join": oracle.NGRAM_JOIN,
    "op7_suffix_dedup": oracle.SUFFIX_DEDUP,
    "op8_mix_sources": mixing.SQL,
    "op12_hard_negatives": hard_negatives.SQL,
    "op13_exact_dedup": exact_dedup.SQL,
}
