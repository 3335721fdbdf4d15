"""Statistics over e-mail domains, and corrections that rest on them.

Domains are few compared with rows, but nothing relies on it: candidates are found by equal keys (deletion
variants, prefixes, suffixes), never by comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.email import domain, local_part

# Endings of a domain that was cut, and mistyped forms of the gov label.
CUT_TAILS = ("g", "go", "gov", "gv", "e", "ed", "edu", "v")
GOV_TYPOS = ("goc", "gv", "gob", "giv", "gvo", "gpv", "gof", "got", "gav", "gov")
BARE_ENDS = ("gov.vn", "edu.vn", "com.vn", "org.vn", "net.vn")


def histogram(emails: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Rows, and the place of the first, of each domain. emails: email, row_pos, by."""
    return emails.where("email is not null").groupBy(*by, domain(F.col("email")).alias("domain")).agg(F.count("*").alias("n"), F.min("row_pos").alias("first_pos"))


def dominant_domain(emails: DataFrame, by: list[str] = [], least: int = 3) -> DataFrame:  # noqa: B006
    """The most frequent domain (the earliest of equals) with ``least`` rows or more."""
    best = F.max_by(F.struct("domain", "n"), F.struct("n", -F.col("first_pos"))).alias("best")
    counted = histogram(emails, by)
    top = counted.groupBy(*by).agg(best) if by else counted.agg(best)
    return top.select(*by, "best.*").where(F.col("n") >= least)


def _variants(c: Column) -> Column:
    """The text and all that one deletion makes of it."""
    cut = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substr(c, F.lit(1), i - 1), F.substr(c, i + 1)))
    return F.array_distinct(F.concat(F.array(c), cut))


def _first_label(c: Column) -> Column:
    return F.substring_index(c, ".", 1)


def typo_fixes(counted: DataFrame, by: list[str] = [], times: int = 5, least_gov: int = 3, least_near: int = 10) -> DataFrame:  # noqa: B006
    """old, new: domains that are a typing error of one that is ``times`` as frequent.

    Either the gov label is mistyped (its right form has ``least_gov`` rows), or one edit separates the two
    (``least_near`` rows, first labels of five letters or more); the most frequent target wins.
    """
    d = F.col("domain")
    parts = F.split(d, r"\.")
    middle = F.element_at(parts, -2)
    gov = F.concat(F.array_join(F.slice(parts, 1, F.size(parts) - 2), "."), F.lit(".gov.vn"))
    mistyped = (F.size(parts) >= 3) & middle.isin(*GOV_TYPOS) & ~d.endswith(".gov.vn")
    target = counted.select(*by, d.alias("new"), F.col("n").alias("n_new"))
    by_rule = counted.where(mistyped).withColumn("new", gov).join(target, [*by, "new"]).where(F.col("n_new") >= least_gov)
    keys = counted.where(F.length(_first_label(d)) >= 5).withColumn("key", F.explode(_variants(d)))
    wide = keys.where(F.col("n") >= least_near).select(*by, "key", d.alias("new"), F.col("n").alias("n_new"))
    by_edit = keys.join(wide, [*by, "key"]).where((F.col("new") != d) & (F.levenshtein(d, "new", 1) == 1)).drop("key").distinct()
    both = by_rule.select(*by, "domain", "n", "new", "n_new", F.lit(0).alias("rule")).unionByName(by_edit.select(*by, "domain", "n", "new", "n_new", F.lit(1).alias("rule")))
    enough = both.where((F.col("n_new") >= times * F.col("n")) & (F.col("new") != d))
    ranked = enough.withColumn("rank", F.row_number().over(Window.partitionBy(*by, "domain").orderBy("rule", F.desc("n_new"), "new")))
    return ranked.where("rank = 1").select(*by, F.col("domain").alias("old"), "new", "n", "n_new")


def apply_fixes(records: DataFrame, fixes: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    keyed = records.withColumn("old", domain(F.col("email")))
    fixed = keyed.join(fixes.select(*by, "old", "new"), [*by, "old"], "left")
    email = F.when(F.col("new").isNull(), F.col("email")).otherwise(F.concat(local_part(F.col("email")), F.lit("@"), F.col("new")))
    return fixed.withColumn("email", email).drop("old", "new")


def truncated_domains(counted: DataFrame, by: list[str] = [], least: int = 3, times: int = 5) -> DataFrame:  # noqa: B006
    """domain: those that are the start of a dominant domain and end in a cut label, or its bare end."""
    d = F.col("domain")
    wide = counted.where(F.col("n") >= least)
    labels = F.split(d, r"\.")
    starts = F.transform(F.sequence(F.lit(1), F.length(d) - 1), lambda i: F.struct(F.substr(d, F.lit(1), i).alias("domain"), F.lit("start").alias("side")))
    end = F.struct(F.substring_index(d, ".", -2).alias("domain"), F.lit("end").alias("side"))
    wide = counted.where((F.col("n") >= least) & (F.length(d) > 1)).withColumn("part", F.explode(F.concat(starts, F.when(F.size(labels) > 2, F.array(end)).otherwise(F.array()))))
    parts = wide.select(*by, d.alias("whole"), F.col("n").alias("n_whole"), F.col("part.domain").alias("domain"), F.col("part.side").alias("side"))
    near = counted.join(parts, [*by, "domain"])
    cut = ((F.col("side") == "start") & (F.size(labels) > 1) & F.element_at(labels, -1).isin(*CUT_TAILS)) | ((F.col("side") == "end") & d.isin(*BARE_ENDS))
    return near.where(cut & (F.col("n_whole") >= times * F.col("n"))).groupBy(*by, "domain").agg(F.max_by("whole", F.struct("n_whole", "whole")).alias("whole"))


def drop_truncated(records: DataFrame, cut: DataFrame, by: list[str] = []) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(records that stay, those whose domain was cut)."""
    keyed = records.withColumn("domain", domain(F.col("email")))
    names = cut.select(*by, "domain")
    return keyed.join(names, [*by, "domain"], "left_anti").drop("domain"), keyed.join(names, [*by, "domain"], "left_semi").drop("domain")
