"""Operators that compare documents or lines, against brute force."""

import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from muster.llm import decontaminate, line_dedup, ngram_join, suffix_dedup
from muster.llm.components import components
from muster.llm.tables import join_groups, kept, scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, n=5, whole=True):
    words = WORD.findall(text or "")
    if len(words) < n:
        return {tuple(words)} if words and whole else set()
    return set(zip(*[words[k:] for k in range(n)], strict=False))


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def jaccard_expected(rows, threshold=0.8):
    sets = {i: shingles(t) for i, t, *_ in rows}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9]
    n = Counter(x for pair in links for x in pair)
    root = roots(sets, links)
    return {(i, root[i], n[i]) for i in sets}


def test_ngram_join(docs, corpus):
    assert {tuple(r) for r in ngram_join.ngram_join(docs).collect()} == jaccard_expected(corpus)


def test_ngram_join_in_blocks(docs, corpus):
    """Buckets and clusters that are split give the same result."""
    got = ngram_join.ngram_join(docs, bucket_block=3, cluster_block=4, cluster_shingles=2000)
    assert {tuple(r) for r in got.collect()} == jaccard_expected(corpus)


def test_ngram_join_odd_tables(spark, docs, corpus, empty):
    assert ngram_join.ngram_join(empty).count() == 0
    extra = docs.withColumn("n", F.lit("x")).withColumn("class_id", F.lit(1)).withColumn("sig", F.lit(None).cast("string"))
    assert {tuple(r) for r in ngram_join.ngram_join(extra).collect()} == jaccard_expected(corpus)
    nulls = spark.createDataFrame([(None, "one two three four five six", None, None, None), (None, None, None, None, None)], docs.schema)
    assert ngram_join.ngram_join(docs.union(nulls)).count() == len(corpus) + 2
    twice = ngram_join.ngram_join(docs.where("doc_id < 3").union(docs.where("doc_id < 3"))).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in twice) == [(i, i, 1) for i in (0, 0, 1, 1, 2, 2)]


def test_drop_near_duplicates(docs, corpus):
    kept = {r.doc_id for r in ngram_join.drop_near_duplicates(docs).collect()}
    assert kept == {i for i, c, _ in jaccard_expected(corpus) if i == c}


def test_ngram_join_of_a_large_cluster(spark):
    """Links of many variants of one text, decided by bounds or on the sets, in one block and in several."""
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(240):
        words = list(base)
        for place in (7 * k, 7 * k + 60, 11 * k)[: 1 + k % 3]:
            words[place % 120] = f"edit{place % 9}"
        rows.append((k, " ".join(words)))
    frame, expected = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), jaccard_expected(rows)
    assert len({n for *_, n in expected}) > 5
    for options in ({}, {"cluster_block": 50}):
        assert {tuple(r) for r in ngram_join.ngram_join(frame, **options).collect()} == expected


def test_least_matches_follow_the_posterior():
    least = ngram_join.least_matches(0.8, 1e-6, 200)
    assert all(m <= 0.8 * n for n, m in enumerate(least.tolist()))
    assert 120 < least[200] < 160


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, 101), (103, 101), (200, 200)]
    for small in (10_000, 0):
        got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), small).collect()}
        assert got == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hot_keys_are_joined_by_broadcast(spark):
    rows = spark.range(3000).selectExpr("if(id < 2000, 0, id) k", "id")
    groups = kept(rows.groupBy("k").agg(F.count("*").alias("size")))
    got = join_groups(rows, groups, ["k"], 3000)
    assert sorted((r.k, r.id, r.size) for r in got.collect()) == sorted((r.k, r.id, r.size) for r in rows.join(groups, "k").collect())


def test_scratch_tables_are_deleted(spark):
    with scratch(spark) as keep:
        one = keep(spark.range(5))
        two = kept(one.where("id > 2"))
    assert two.count() == 2
    with pytest.raises(Exception, match="(?i)path"):
        spark.read.parquet(*one.inputFiles())


def lines_expected(rows):
    first, places = {}, []
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        for k, line in enumerate((text or "").split("\n") if text is not None else []):
            words = tuple(WORD.findall(line))
            if words:
                first.setdefault(words, (i, k))
                places.append((i, k, words))
    near = set()
    by_size = defaultdict(list)
    for w in first:
        by_size[len(w)].append(w)

    def close(a, b):
        if len(a) == len(b):
            return len(a) > 1 and sum(x != y for x, y in zip(a, b, strict=True)) == 1
        long, short = (a, b) if len(a) > len(b) else (b, a)
        return bool(short) and any(long[:p] + long[p + 1 :] == short for p in range(len(long)))

    for a in first:
        others = (b for n in (len(a) - 1, len(a), len(a) + 1) for b in by_size[n])
        if any(first[b] < first[a] and close(a, b) for b in others if b != a):
            near.add(a)
    return {(i, k) for i, k, w in places if first[w] != (i, k) or w in near}


def test_line_dedup(docs, corpus):
    gone = lines_expected(corpus)
    assert len(gone) > 20
    for r in line_dedup.dedup_lines(docs).collect():
        text = corpus[r.doc_id][1]
        lines = text.split("\n") if text is not None else []
        stay = [x for k, x in enumerate(lines) if (r.doc_id, k) not in gone]
        assert (r.n_lines, r.n_removed) == (len(lines), len(lines) - len(stay))
        assert r.text == (None if text is None else "\n".join(stay))


def test_line_dedup_odd_tables(spark, docs, corpus, empty):
    assert line_dedup.dedup_lines(empty).count() == 0
    extra = docs.withColumn("lines", F.lit(1)).withColumn("first", F.lit("x")).withColumn("n_lines", F.lit("old"))
    out = line_dedup.dedup_lines(extra)
    assert set(out.columns) == {*docs.columns, "lines", "first", "n_lines", "n_removed"}
    assert out.agg(F.sum("n_removed")).first()[0] == len(lines_expected(corpus))
    rows = spark.createDataFrame([(None, "same line of five words"), (1, "same line of five words"), (1, "same line of five words")], "doc_id long, text string")
    assert [r.n_removed for r in line_dedup.dedup_lines(rows).collect()] == [0, 0, 0]


def test_line_dedup_template_lines(spark):
    """A large group of lines that differ in one word keeps its earliest only."""
    rows = [(k, f"order number {k} was shipped on monday") for k in range(300)]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.doc_id for r in out.where("text <> ''").collect()] == [0]


def test_line_dedup_short_and_long_lines(spark):
    """One word of any line may differ, if another is left; a repeated row is cut like its twin."""
    long = " ".join(f"w{k}" for k in range(2500))
    rows = [(1, "alpha beta gamma delta\none two\nsolo\n" + long), (2, "alpha beta gamma zeta\none three\nother\n" + long.replace("w777 ", "")), (2, "alpha beta gamma zeta\none three\nother\n" + long.replace("w777 ", "")), (3, "two one\nsolo more\nx y z\nx y"), (4, "y x z\nz")]
    out = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    got = sorted((r.doc_id, r.text if r.doc_id > 1 else "") for r in out.collect())
    assert got == [(1, ""), (2, "other"), (2, "other"), (3, "two one\nx y z"), (4, "y x z\nz")]


def test_decontaminate(spark, docs, corpus):
    items = [(0, corpus[80][1]), (1, corpus[3][1]), (2, "too short"), (3, None), (4, " ".join(corpus[6][1].split()[:9]).upper()), (5, ""), (6, "a  B"), (7, " ".join(corpus[9][1].split()[3:6])), (7, " ".join(corpus[9][1].split()[3:6])), (8, "WORD")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    fold = lambda t: re.sub("[A-Z]", lambda m: m.group().lower(), t or "")
    expected = set()
    for i, t, *_ in corpus:
        for k, x in items:
            want = shingles(fold(x))
            found = len(want & shingles(fold(t), n=min(5, max(1, len(WORD.findall(x or "")))), whole=False))
            if want and found >= 0.8 * len(want) - 1e-9:
                expected.add((i, k, len(want), found))
    for size in (2_000_000, 10):  # one block, and a block an item
        got = decontaminate.contaminated(docs, frame, block_shingles=size)
        rows = [tuple(r)[:4] for r in got.collect()]
        assert set(rows) == expected and len(rows) == len(expected) + sum(e[1] == 7 for e in expected)
        left = decontaminate.decontaminate(docs.withColumn("item_id", F.lit("x")), frame, block_shingles=size)
        assert {r.doc_id for r in left.collect()} == {r[0] for r in corpus} - {e[0] for e in expected}
    assert decontaminate.contaminated(docs, frame.limit(0)).count() == 0 and decontaminate.contaminated(docs.limit(0), frame).count() == 0
    assert {e[1] for e in expected} >= {6, 7, 8}
    twice = decontaminate.contaminated(docs.union(docs), frame)
    assert twice.count() == 2 * len(rows)


def test_sketch_loses_nothing():
    for n in range(1, 300):
        assert decontaminate.sketch_size(n, 0.8) >= n - -(-8 * n // 10) + 1 or decontaminate.sketch_size(n, 0.8) == n


def spans_expected(rows, length):
    seen, out = set(), {}
    for i, text, *_ in sorted(rows, key=lambda r: r[0]):
        data, merged = (text or "").encode(), []
        for p in range(len(data) - length + 1):
            s = data[p : p + length]
            if s in seen:
                if merged and p <= merged[-1][1]:
                    merged[-1][1] = p + length
                else:
                    merged.append([p, p + length])
            seen.add(s)
        left, at = b"", 0
        for a, b in merged:
            left, at = left + data[at:a], b
        out[i] = (len(data), sum(b - a for a, b in merged), len(merged), left + data[at:])
    return out


def test_suffix_dedup(docs, corpus):
    for hot in (1000, 0):  # in a task, and by distributed minimums
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(docs, hot=hot).collect()}
        assert got == spans_expected(corpus, 100)


@pytest.mark.parametrize("length", [40, 64, 100])
def test_buckets_are_refined_like_a_suffix_sort(length):
    """A round's buckets, made of the buckets of later suffixes only, are those of a plain sort by the bytes that it covers."""
    rnd = np.random.default_rng(length)
    motif = rnd.integers(0, 3, 300).astype(np.uint8)
    runs = [np.concatenate([rnd.integers(0, 3, 20), motif[k % 90 : k % 90 + 150], rnd.integers(0, 3, k)]).astype(np.uint8) for k in range(8)]
    data, end = np.concatenate(runs), np.repeat(np.cumsum([len(x) for x in runs]), [len(x) for x in runs])

    def plain(h):
        text = [bytes(data[k : k + h]) if k + h <= end[k] else None for k in range(len(data))]
        seen = Counter(t for t in text if t is not None)
        return [t if t is not None and seen[t] > 1 else None for t in text]

    def same(bucket, text):
        assert [b < 0 for b in bucket] == [t is None for t in text]
        pairs = {(b, t) for b, t in zip(bucket.tolist(), text, strict=True) if t is not None}
        assert len(pairs) == len({b for b, _ in pairs}) == len({t for _, t in pairs})

    ids = {t: n for n, t in enumerate(sorted({t for t in plain(8) if t is not None}))}
    bucket = np.array([ids.get(t, -1) for t in plain(8)])
    for h in (8, 16):
        bucket = suffix_dedup._refined(bucket, h, end, 2 * h)
        same(bucket, plain(2 * h))
    same(suffix_dedup.string_buckets(data, end, length), plain(length))


def test_buckets_are_refined_a_few_at_a_time():
    """Memory follows a bucket, not the batch: 2 MB of contexts, about 100 bytes each byte of those refined together."""
    rnd = random.Random(3)
    texts = [rnd.randbytes(168) for _ in range(6000)]
    rows = pa.record_batch({
        "bucket": pa.array([k // 2 for k in range(12000)]), "doc_id": pa.array(range(12000)), "pos": pa.array([68] * 12000, pa.int32()), "before": pa.array([68] * 12000, pa.int32()),
        "bytes": pa.array([texts[k // 2] for k in range(12000)], pa.binary()),
    })
    tracemalloc.start()
    got = [x for b in suffix_dedup._refine_buckets(100)(iter([rows])) for x in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted((x["doc_id"], x["start"], x["end"]) for x in got) == [(k, 0, 168) for k in range(1, 12000, 2)]
    assert peak < 100e6


def test_suffix_dedup_of_a_hot_passage(spark):
    """One passage in all documents of many partitions, with other words around it: a bucket that no task gathers."""
    rnd = random.Random(9)
    passage = " ".join(str(rnd.random()) for _ in range(12))
    rows = [(k, f"{rnd.random()} {passage[k % 40 :]} {rnd.random()}") for k in range(150)]
    got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), hot=50).collect()}
    assert got == {i: v[1] for i, v in spans_expected(rows, 100).items()}


def test_suffix_dedup_small_batches(spark, docs, corpus):
    """Buckets that span Arrow batches."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = {r.doc_id: r.n_removed for r in suffix_dedup.remove_repeats(docs).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {i: v[1] for i, v in spans_expected(corpus, 100).items()}


def test_suffix_dedup_odd_tables(spark, docs, empty):
    assert suffix_dedup.remove_repeats(empty).count() == 0
    text = "abcdefghij" * 30
    rows = spark.createDataFrame([(None, text, 1), (2, text, 2), (2, text, 3), (3, text, 4), (4, None, 5)], "doc_id long, text string, spans int")
    got = sorted((r.doc_id or 0, r.n_removed) for r in suffix_dedup.remove_repeats(rows).collect())
    assert got == [(0, 0), (2, 290), (2, 290), (3, 300), (4, 0)]


def test_texts_over_a_block(spark):
    """A text of several MB is judged whole: its end is found like its start."""
    rnd = random.Random(17)
    words = [f"w{rnd.randrange(10**7)}" for _ in range(330_000)]
    long = " ".join(words)
    assert len(long) > 2 << 20
    middle, end = " ".join(words[150_000:150_040]), " ".join(words[-30:])
    frame = spark.createDataFrame([(1, long), (2, f"~{middle}~ unlike"), (3, " ".join([*words[:200_000], "other", *words[200_001:]])), (4, "short text of its own")], "doc_id long, text string").repartition(2)
    items = spark.createDataFrame([(7, end), (8, "not in any of these texts")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(frame, items).collect()) == [(1, 7), (3, 7)]
    assert {r.doc_id: r.class_id for r in ngram_join.ngram_join(frame).collect()} == {1: 1, 2: 2, 3: 1, 4: 4}
    cut = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffix_dedup.remove_repeats(frame).collect()}
    assert cut[1] == (len(long), 0) and cut[2][1] == len(middle) and cut[4][1] == 0
    assert 0 <= cut[3][0] - cut[3][1] - len("other") <= 2
