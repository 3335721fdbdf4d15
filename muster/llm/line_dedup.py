"""Line dedup within one word of edit distance, by a deletion-neighbourhood join in DataFrame functions.

A line is its words ``[^\\x20\\x09-\\x0D]+``; blank lines are never touched.  A line is removed if an earlier
one (smaller doc_id, or earlier in the same document) is equal, or if one word was inserted, deleted or replaced
between them and a word is left that both have.  A removed line still removes later ones.

Method.  Two lines are within one edit if deleting a word from one or both, at the same place, gives equal
variants; so variants are hashed to keys and equal keys joined.  A long line has as many variants as words,
so they are made in two steps that lose nothing:

1. Coarse variants: the line without one of its two halves, for the lengths n and n - 1 that the shorter line of a
   pair can have.  One edit lies within one half, so the rest is equal: three keys a line, whatever its length.
   Keys that one line alone has are dropped by an aggregation.
2. Fine variants, only for the lines and halves that share a coarse key: the line without each word of that
   half, with the place (replacement), and without it against the whole of shorter lines (insertion, deletion).
3. Per key only the earliest line of each kind is kept, by a minimum that is combined on the map side, so a key that a
   third of all lines share makes no pairs.  Each line and the earliest one of its keys are then verified: their
   words are compared.

Earliest is decided per distinct line (96 bits of two hashes of its words); copies of a line share it.  The texts
are joined by doc_id twice, to fetch the lines of step 2 and to cut the result.  Tables of the steps are deleted
when the numbers of the lines to remove are written.  Keys with many rows are joined by a broadcast of those keys,
which are fewer than a constant (``join_groups``).  No Python runs on the executors.

Defined results: a null text stays null with 0 lines; an empty text has one blank line; a document may lose
all its lines and keeps an empty text; rows that repeat a doc_id with the same text are cut alike (doc_id is
a key: it mustn't repeat with another text); rows with a null doc_id stay as they are; extra columns pass through;
``n_lines`` and ``n_removed`` are overwritten; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import BLANKS, join_groups, kept, merged, scratch, table


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, BLANKS), "")


def _hashes(*parts: Column) -> tuple[Column, Column]:
    """96 bits of two unrelated hashes."""
    return F.xxhash64(*parts), F.hash(*parts)


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def _without(words: Column, m: Column, start: Column, stop: Column) -> tuple[Column, Column]:
    """The words before start and those from stop on (counted from 0)."""
    return F.slice(words, F.lit(1), start), F.slice(words, stop + 1, m - stop)


def _coarse(words: Column, m: Column) -> Column:
    """Keys 0 and 1 are without the first and second half of a line of m words; 2 and 3 without the halves that a line
    of m - 1 words has. Two of them always coincide (2 with 0 if m is even, else 3 with 1) and are left out."""
    short, long = _half(m), m - _half(m)
    end = lambda n: F.xxhash64(F.lit(0), n, F.slice(words, m - n + 1, n))
    start = lambda n: F.xxhash64(F.lit(1), n, F.slice(words, F.lit(1), n))
    even = m % 2 == 0
    pairs = ((F.lit(0), end(long)), (F.lit(1), start(short)), (F.when(even, 3).otherwise(2), F.when(even, start(short - 1)).otherwise(end(long - 1))))
    return F.array(*[F.struct(k.alias("k"), key.alias("key")) for k, key in pairs])


def _lines(docs: DataFrame) -> DataFrame:
    """Every line with a word: where it stands, its identity h1, h2, and its coarse keys."""
    split = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    worded = split.select("doc_id", "line_no", _words(F.col("line")).alias("words"))
    sized = worded.select("*", F.size("words").alias("m")).where("m > 0")
    words, m = F.col("words"), F.col("m")
    h1, h2 = _hashes(words)
    return sized.select("doc_id", "line_no", h1.alias("h1"), h2.alias("h2"), _coarse(words, m).alias("keys"))


def _fine(lines: DataFrame) -> DataFrame:
    """Fine variants: key (v1, v2), kind (whole, cut or replaced) and the line's first place.

    lines: first, words, ks (bit k is set if the line shares coarse key k).
    """
    sized = lines.select("words", "first", "ks", F.size("words").alias("m"))
    words, m, k, p, t = (F.col(c) for c in ("words", "m", "k", "p", "t"))
    even = m % 2 == 0
    both = F.when(even, F.col("ks").bitwiseOR(F.shiftleft(F.col("ks").bitwiseAND(1), 2))).otherwise(F.col("ks").bitwiseOR(F.shiftleft(F.col("ks").bitwiseAND(2), 2)))
    each = sized.where("m > 1").withColumn("ks", both).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).where("(ks & shiftleft(1, k)) > 0")
    each = each.withColumn("t", F.when(k >= 2, 1).otherwise(0))
    half = _half(m - t)
    start, stop = F.when(k % 2 == 0, 0).otherwise(half), F.when(k % 2 == 0, half + t).otherwise(m)
    each = each.withColumn("p", F.explode(F.sequence(start, stop - 1)))
    v1, v2 = _hashes(m - t, F.when(t == 0, p).otherwise(-1), *_without(words, m, p, p + 1))
    cut = each.select(v1.alias("v1"), v2.alias("v2"), F.when(t == 0, "replaced").otherwise("cut").alias("kind"), "first")
    w1, w2 = _hashes(m, F.lit(-1), words)
    return cut.unionByName(sized.select(w1.alias("v1"), w2.alias("v2"), F.lit("whole").alias("kind"), "first"))


def _candidates(fine: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """first, other: each line and the earliest that shares one of its variants in a way that allows for one edit."""
    first = F.col("first")
    groups = fine.groupBy("v1", "v2").agg(
        F.count("*").alias("size"), F.min("first").alias("lo"), F.max("first").alias("hi"),
        F.min(F.when(F.col("kind") == "whole", first)).alias("whole"), F.min(F.when(F.col("kind") == "cut", first)).alias("cut"),
    ).where("lo <> hi").select("v1", "v2", "size", "lo", "whole", "cut")
    other = F.when(F.col("kind") == "replaced", F.col("lo")).when(F.col("kind") == "cut", F.col("whole")).otherwise(F.col("cut"))
    joined = join_groups(fine, keep(groups), ["v1", "v2"], fine.count())
    return joined.select("first", other.alias("other")).where("other < first").distinct()


def _one_edit(a: Column, b: Column) -> Column:
    """Whether one word was replaced, or added to the shorter, between two different arrays of words."""
    n, m = F.size(a), F.size(b)
    place = F.array_position(F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False))), F.lit(False))
    place = F.greatest(place.cast("int"), F.lit(1))  # of the first difference
    rest = lambda x, skip: F.slice(x, place + skip, F.greatest(F.size(x) - place + 1 - skip, F.lit(0)))
    return (F.abs(n - m) <= 1) & (rest(a, F.when(n >= m, 1).otherwise(0)) == rest(b, F.when(m >= n, 1).otherwise(0)))


def removed_lines(docs: DataFrame) -> DataFrame:
    """doc_id, lines: the numbers (from 0) of the lines to remove from each document that has any."""
    texts = docs.select("doc_id", "text").where("doc_id is not null")
    with scratch(docs.sparkSession) as keep:
        lines = keep(_lines(texts))
        n = lines.count()
        firsts = keep(lines.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("size")))
        spread = lines.select("h1", "h2", F.inline("keys"))
        shared = keep(spread.groupBy("key").agg(F.count("*").alias("size"), F.min("h1").alias("lo"), F.max("h1").alias("hi")).where("lo <> hi").select("key", "size"))
        masks = join_groups(spread, shared, ["key"], 3 * n).groupBy("h1", "h2").agg(F.bit_or(F.expr("shiftleft(1, k)")).alias("ks"))
        per_doc = masks.join(merged(firsts), ["h1", "h2"]).groupBy(F.col("first.doc_id").alias("doc_id")).agg(F.collect_list(F.struct("first", "ks")).alias("wanted"))
        fetched = texts.join(merged(per_doc), "doc_id").select(F.split("text", "\n").alias("all"), F.explode("wanted").alias("one"))
        worded = keep(fetched.select(_words(F.element_at("all", F.col("one.first.line_no") + 1)).alias("words"), "one.first", "one.ks").dropDuplicates(["first"]))

        pairs = _candidates(keep(_fine(worded)), keep)
        sides = [worded.select(F.col("first").alias(c), F.col("words").alias(f"{c}_words")) for c in ("first", "other")]
        near = pairs.join(merged(sides[0]), "first").join(merged(sides[1]), "other").where(_one_edit(F.col("first_words"), F.col("other_words"))).select("first", F.lit(True).alias("near")).distinct()

        judged = keep(firsts.join(merged(near), "first", "left").where("size > 1 or near"))
        places = lines.select("h1", "h2", "doc_id", "line_no")
        gone = join_groups(places, judged, ["h1", "h2"], n).where((F.struct("doc_id", "line_no") != F.col("first")) | F.col("near"))
        return kept(gone.groupBy("doc_id").agg(F.collect_set("line_no").alias("lines")))


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with the remaining lines as text, n_lines and n_removed."""
    gone = removed_lines(docs).withColumnRenamed("lines", "_muster_gone")
    base = docs.drop("n_lines", "n_removed")
    rows = base.where("doc_id is not null").join(merged(gone), "doc_id", "left")
    rows = rows.unionByName(base.where("doc_id is null").withColumn("_muster_gone", F.lit(None).cast("array<int>")))
    split = rows.withColumn("_muster_lines", F.split("text", "\n"))
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    stay = F.array_except(F.sequence(F.lit(0), F.size("_muster_lines") - 1), F.col("_muster_gone"))
    text = F.array_join(F.transform(stay, lambda i: F.element_at("_muster_lines", i + 1)), "\n")
    out = split.withColumn("n_lines", count("_muster_lines")).withColumn("n_removed", count("_muster_gone"))
    kept_text = F.when(F.col("text").isNull() | F.col("_muster_gone").isNull(), F.col("text")).otherwise(text)
    return out.withColumn("text", kept_text).drop("_muster_lines", "_muster_gone")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", F.col("text").alias("clean_text"))


SQL = r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
numbered AS (SELECT doc_id, unnest(range(len(ls))) AS line_no, unnest(ls) AS line FROM split),
lines AS (
  SELECT doc_id, line_no, line, doc_id * 10000000 + line_no AS place, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS ws
  FROM numbered),
uniq AS (SELECT ws, len(ws) AS m, min(place) AS first FROM lines WHERE len(ws) > 0 GROUP BY ws),
cut AS (
  SELECT ws, m, first, p, md5(array_to_string(ws[1:p - 1] || ws[p + 1:], ' ')) AS rest
  FROM (SELECT ws, m, first, unnest(range(1, m + 1)) AS p FROM uniq WHERE m >= 2)),
whole AS (SELECT m, first, md5(array_to_string(ws, ' ')) AS h FROM uniq),
links AS (
  SELECT a.first AS first, b.lo AS other
  FROM cut a JOIN (SELECT m, p, rest, min(first) AS lo FROM cut GROUP BY m, p, rest HAVING count(*) > 1) b
    ON a.m = b.m AND a.p = b.p AND a.rest = b.rest
  UNION ALL
  SELECT a.first, w.first FROM cut a JOIN whole w ON a.m = w.m + 1 AND a.rest = w.h
  UNION ALL
  SELECT w.first, a.first FROM cut a JOIN whole w ON a.m = w.m + 1 AND a.rest = w.h),
near AS (SELECT DISTINCT first FROM links WHERE other < first),
judged AS (
  SELECT l.doc_id, l.line_no, l.line,
         coalesce(l.place <> u.first OR n.first IS NOT NULL, false) AS gone
  FROM lines l LEFT JOIN uniq u ON l.ws = u.ws LEFT JOIN near n ON u.first = n.first),
per_doc AS (
  SELECT doc_id, count(*)::BIGINT AS n_lines, sum(gone::INT)::BIGINT AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '') AS clean_text
  FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed, clean_text
FROM documents d LEFT JOIN per_doc p ON d.doc_id = p.doc_id
"""
