"""Information-theoretic sanitisation of personal data, in DataFrame functions.

Base spans are e-mail addresses, IP addresses, card and phone numbers, found leftmost and non-overlapping
per kind in the whole text; a match that fails its test is dropped.  The method adds ``secret`` spans (long keys of letters
and digits, which are protected entities too) and ``term`` spans: words near an entity that reveal it.

Method (after Sanchez and Batet's C-sanitisation).  A word t reveals an entity e as far as PMI(e; t) comes near IC(e), the whole
information of e: IC(e) - PMI(e; t) = -log P(e near | t), the bits that t leaves open.  P is estimated by n_et / n_t, where n_t
are the occurrences of t and n_et those within ``reach`` characters of e, and by its lower bound (Wilson, one-sided at ``z``), so
that few sightings prove little and N doesn't matter.  A word is generalised to [TERM] if this bound is at least
``disclosure``.  It is judged against the entity's value and, as a back-off, against the group that the value belongs to
(``_group``: an address's domain, the first digits of a number), which occurs more often.

An unusual name beside an address that occurs once can't be proved that way, nor told from an unusual word that stands
there by chance, by its own counts.  So words of at most ``rare`` occurrences, all near e, are judged by the base rate at their
distance: if rare words are a share x of all words at so many characters before or after values (bins of ``bin``; lower bound), and a
share x0 of all words of the corpus, then 1 - x0 / x of them stand there for a reason, and if that is at least
``disclosure``, they are generalised.  All counts are over all documents.

Plan.  Two passes over the texts in whole-stage code: the texts that hold an entity (distinct ones, with their number of
rows), and one count a word, combined on the map side.  Only the former give up their words' places, which meet the
entities by (text, stretch of ``reach`` characters), so an entity meets a bounded number of words, however long the text.
Counts of a value are summed by (entity, word), so a value that a third of all rows share is combined
before the shuffle.  No Python runs on the executors.

Spans belong to a distinct text (128 bits of two hashes), not to a doc_id, which may be null or repeat.  Places of
matches are running sums over the gaps between matches and the matches themselves, in a window a text and kind.  The
patterns are the contract's with possessive quantifiers where nothing can follow, so that they take linear time and no
stack on long runs.

Defined results: a null text is empty and has no spans; spans are in code points, end exclusive; equal
places go by kind as listed; rows that repeat a text get the same spans, and each of them counts; doc_id isn't used;
extra columns are ignored or passed through (sanitize, which replaces ``spans``); an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import join_groups, kept, merged, scratch, table

KINDS = ("email", "ip", "card", "phone", "secret", "term")
BASE = KINDS[:4]
TEXT = ["_text1", "_text2"]
#: \G is the end of the match before: an address can start there or after a character that none can hold.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"[A-Za-z0-9_-]{24,}+",
}
TERM = r"[\p{L}\p{N}]++"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether digits (12 to 19 of them) pass the Luhn test: from the right, every second is doubled."""
    n = F.length(digits)

    def add(total, k):
        d = F.ascii(F.substr(digits, n - k, F.lit(1))) - 48
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    parts = F.split(value, r"\.")
    small = F.forall(parts, lambda p: (F.length(F.ltrim(p, F.lit("0"))) < 3) | ((F.length(F.ltrim(p, F.lit("0"))) == 3) & (F.ltrim(p, F.lit("0")) <= "255")))
    card = F.length(digits).between(12, 19) & F.when(F.length(digits).between(12, 19), _luhn(digits)).otherwise(False)
    return F.when(kind == "ip", small).when(kind == "card", card).when(kind == "phone", F.length(digits).between(9, 15)).when(kind == "secret", (F.length(digits) >= 4) & (F.length(F.regexp_replace(value, "[^A-Za-z]", "")) >= 4)).otherwise(True)


def _matches(text: Column, kind: str, pattern: str) -> Column:
    """kind, number, gap before (code points) and match of all matches."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    return F.transform(F.arrays_zip(found.alias("v"), F.transform(F.slice(gaps, 1, F.size(found)), F.length).alias("g")), lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["g"].alias("gap"), x["v"].alias("value")))


def _placed(matches: DataFrame) -> DataFrame:
    """The text, kind, start, end, value of matches: the text, kind, i, gap, value."""
    before = Window.partitionBy(*TEXT, "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = matches.withColumn("end", F.sum(F.col("gap") + F.length("value")).over(before).cast("long"))
    return rows.select(*TEXT, "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value")


def _base_matches(text: Column) -> Column:
    """All matches of the entities' patterns, valid or not; a pattern runs only where its signs occur."""
    none = F.array().cast("array<struct<kind:string,i:int,gap:int,value:string>>")
    has = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike(r"[0-9][\x20-]?[0-9]"), "phone": text.rlike(r"\+[0-9]"), "secret": text.rlike(PATTERNS["secret"])}
    return F.concat(*[F.when(has[k], _matches(text, k, p)).otherwise(none) for k, p in PATTERNS.items()])


def _by_text(docs: DataFrame) -> DataFrame:
    """docs with the two hashes that stand for a text."""
    return docs.withColumn(TEXT[0], F.xxhash64("text")).withColumn(TEXT[1], F.xxhash64(F.lit("2"), F.col("text")))


def entity_texts(docs: DataFrame) -> DataFrame:
    """Each distinct text that holds an entity, and its number of rows (n)."""
    texts = docs.select("text").where("text is not null")
    with_entity = texts.where(F.exists(_base_matches(F.col("text")), lambda m: _valid(m["kind"], m["value"])))
    return _by_text(with_entity).groupBy(*TEXT).agg(F.first("text").alias("text"), F.count("*").alias("n"))


def base_spans(texts: DataFrame) -> DataFrame:
    """kind, start, end, value of the entities of each of entity_texts()."""
    rows = texts.select(*TEXT, F.explode(_base_matches(F.col("text"))).alias("m")).select(*TEXT, "m.*")
    return _placed(rows).where(_valid(F.col("kind"), F.col("value")))


def _group(kind: Column, value: Column) -> Column:
    """What a value has in common with others: a domain, a network, an issuer, an area; null for a key."""
    digits = _digits(value)
    return F.when(kind == "email", F.substring_index(value, "@", -1)).when(kind == "ip", F.substring_index(value, ".", 2)).when(kind == "card", F.substr(digits, F.lit(1), F.lit(6))).when(kind == "phone", F.substr(digits, F.lit(1), F.lit(4)))


def _entities(kind: Column, value: Column) -> Column:
    """The names under which a span is an entity: its value's and its group's."""
    group = _group(kind, value)
    return F.array_compact(F.array(F.concat(kind, F.lit(":"), value), F.concat(kind, F.lit(" group:"), group)))


def _nearest(gap: str) -> Column:
    return F.min(F.struct(F.abs(gap).alias("size"), F.col(gap)))[gap].alias(gap)


def _near(texts: DataFrame, spans: DataFrame, reach: int, keep) -> DataFrame:
    """entity, term, start, end, gap and text of the words within reach of each entity and outside of all; and n. gap: the
    characters between, for words before the entity as -1 less them."""
    words = texts.select(*TEXT, F.explode(_matches(F.col("text"), "term", TERM)).alias("m"))
    places = _placed(words.select(*TEXT, "m.*"))
    entities = spans.select(*TEXT, _entities(F.col("kind"), F.col("value")).alias("names"), F.col("start").alias("s"), F.col("end").alias("e"))
    first, last = F.floor((F.col("s") - reach) / reach), F.floor((F.col("e") + reach) / reach)
    entities = entities.withColumn("stretch", F.explode(F.sequence(first, last)))
    terms = places.select(*TEXT, "start", "end", F.lower("value").alias("term"), F.floor(F.col("start") / reach).alias("stretch"))
    pairs = terms.join(entities, [*TEXT, "stretch"]).where((F.col("start") < F.col("e") + reach) & (F.col("end") > F.col("s") - reach))
    pairs = keep(pairs.drop("stretch"))  # few; the shuffles of all words go before the next ones
    inside = F.max(((F.col("start") < F.col("e")) & (F.col("end") > F.col("s"))).cast("int")).over(Window.partitionBy(*TEXT, "start"))
    gap = F.when(F.col("start") >= F.col("e"), F.col("start") - F.col("e")).otherwise(F.col("end") - F.col("s") - 1)
    outside = pairs.withColumn("inside", inside).where("inside = 0").select(*TEXT, "term", "start", "end", gap.alias("gap"), F.explode("names").alias("entity"))
    outside = outside.groupBy(*TEXT, "term", "start", "end", "entity").agg(_nearest("gap"))
    return outside.join(texts.select(*TEXT, "n"), TEXT)


def _at_least(hits: Column, n: Column, z: float) -> Column:
    """The lower bound of a share of which hits of n were seen (Wilson)."""
    p = F.least(hits / n, F.lit(1.0))
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def term_spans(docs: DataFrame, texts: DataFrame, spans: DataFrame, keep, disclosure: float = 0.5, reach: int = 160, z: float = 1.64, rare: int = 2, bin: int = 16) -> DataFrame:
    """The text, kind (term), start, end, value: words that disclose an entity near them."""
    near = keep(_near(texts, spans, reach, keep))
    met = near.groupBy("entity", "term").agg(F.sum("n").alias("n_et"), F.count("*").alias("size"), _nearest("gap"))
    every = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0))).alias("term"))
    counts = keep(every.groupBy("term").agg(F.count("*").alias("n_t")))
    weighed = keep(met.join(counts, "term").withColumn("bin", F.floor(F.col("gap") / bin)))
    few = F.col("n_t") <= rare
    usual = counts.agg((F.sum(F.when(few, F.col("n_t"))) / F.sum("n_t")).alias("x0")).first()["x0"] or 0.0
    values = weighed.where(~F.contains("entity", F.lit(" group:")))
    by_bin = values.groupBy("bin").agg(_at_least(F.coalesce(F.sum(F.when(few, F.col("n_et"))), F.lit(0)), F.sum("n_et"), z).alias("x"))
    telling_bins = [r.bin for r in by_bin.collect() if r.x > 0 and 1 - usual / r.x >= disclosure]  # 2 * reach / bin rows and two
    alone = few & (F.col("n_et") >= F.col("n_t")) & F.col("bin").isin(telling_bins) & ~F.contains("entity", F.lit(" group:"))
    telling = keep(weighed.where((_at_least(F.col("n_et"), F.col("n_t"), z) >= disclosure) | alone).select("entity", "term", "size"))
    hits = join_groups(near, telling, ["entity", "term"], near.count()).select(*TEXT, "start", "end", "term").distinct()
    return hits.select(*TEXT, F.lit("term").alias("kind"), "start", "end", F.col("term").alias("value"))


def all_spans(docs: DataFrame, **options) -> DataFrame:
    """Of each distinct text with any: spans, an array of (start, rank of kind, kind, end, value) in order."""
    with scratch(docs.sparkSession) as keep:
        texts = keep(entity_texts(docs))
        base = keep(base_spans(texts))
        spans = base.unionByName(term_spans(docs, texts, base, keep, **options))
        rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
        return kept(spans.groupBy(*TEXT).agg(F.array_sort(F.collect_list(F.struct("start", rank.alias("rank"), "kind", "end", "value"))).alias("spans")))


def sanitize(docs: DataFrame, **options) -> DataFrame:
    """docs with every span of ``text`` generalised to its kind, as in [EMAIL] (where spans overlap, the
    first one's), and the spans."""
    rows = _by_text(docs.drop("spans")).join(merged(all_spans(docs, **options)), TEXT, "left").drop(*TEXT)
    start = F.struct(F.lit(0).cast("long").alias("to"), F.array().cast("array<string>").alias("out"))

    def step(acc, x):
        mark = F.when(x["start"] < acc["to"], F.array()).otherwise(F.array(F.substr("text", (acc["to"] + 1).cast("int"), (x["start"] - acc["to"]).cast("int")), F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]"))))
        return F.struct(F.greatest(acc["to"], x["end"]).alias("to"), F.concat(acc["out"], mark).alias("out"))

    done = F.aggregate("spans", start, step)
    text = F.concat(F.array_join(done["out"], ""), F.substr("text", (done["to"] + 1).cast("int")))
    return rows.withColumn("text", F.when(F.col("spans").isNull(), F.col("text")).otherwise(text))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = _by_text(docs).drop("text").join(merged(all_spans(docs)), TEXT, "left")
    spans = F.coalesce("spans", F.array().cast("array<struct<start:bigint,rank:bigint,kind:string,end:bigint,value:string>>"))

    def told(which: Column) -> Column:
        return F.array_join(F.transform(which, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    base = F.filter(spans, lambda x: x["kind"].isin(*BASE))
    found = F.size(spans).cast("long").alias("n_spans")
    return rows.select("doc_id", *counts[:4], F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(spans).alias("spans"), *counts[4:], found)
