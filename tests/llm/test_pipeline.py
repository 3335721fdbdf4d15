"""The pipeline's stages one after the other, each against brute force on its own input."""

import random

from pyspark.sql import functions as F

import corpus_pipeline
from muster.llm.tables import kept
from tests.llm.test_pairs import WORD, jaccard_expected, lines_expected, shingles


def rows(frame):
    return sorted([tuple(r) for r in frame.select("doc_id", "text", "lang", "source", "n_chars").collect()], key=lambda r: r[0])


def test_stages(spark, tmp_path, docs, corpus):
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    items = [(0, corpus[3][1]), (1, corpus[70][1])]
    spark.createDataFrame(items, "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    where, stages = str(tmp_path), [f for _, f in corpus_pipeline.STAGES]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_jaccard_join", "decontaminate", "mix_sources"]

    one = kept(stages[0](spark, docs, where))
    assert one.columns == docs.columns
    assert rows(one) == [r for r in corpus if r[1] and any(c.isalpha() for c in r[1])]

    two = kept(stages[1](spark, one, where))
    gone, expected = lines_expected(rows(one)), []
    for i, text, lang, source, _ in rows(one):
        text = "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone)
        if WORD.search(text):
            expected.append((i, text, lang, source, len(text)))
    assert two.columns == docs.columns and rows(two) == expected

    three = kept(stages[2](spark, two, where))
    first = {i for i, c, _ in jaccard_expected(rows(two)) if i == c}
    assert three.columns == docs.columns and rows(three) == [r for r in rows(two) if r[0] in first]

    four = kept(stages[3](spark, three, where))
    wants = [shingles(t.lower(), whole=False) for _, t in items]
    dirty = lambda t: any(w and len(w & shingles(t.lower(), whole=False)) >= 0.8 * len(w) - 1e-9 for w in wants)
    assert four.columns == docs.columns and rows(four) == [r for r in rows(three) if not dirty(r[1])]

    five = kept(stages[4](spark, four, where))
    counts = {r.doc_id: r["count"] for r in five.groupBy("doc_id").count().collect()}
    assert set(counts) <= {r[0] for r in rows(four)} and max(counts.values()) <= 3
    assert [tuple(r) for r in corpus_pipeline.run(spark, where).orderBy("doc_id", "copy").collect()] == [tuple(r) for r in five.orderBy("doc_id", "copy").collect()]


def test_empty_tables(spark, tmp_path, empty):
    empty.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_documents(spark, tmp_path, docs, corpus):
    """Rows without a doc_id are judged by their own text, never as copies; repeated rows share their fate; a text over a
    block is whole; columns of any name stay, but ``copy``, which the last stage overwrites."""
    rnd = random.Random(6)
    long = " ".join(rnd.choice(corpus[30 + k % 20][1].split() or ["a"]) + str(rnd.randrange(10**6)) for k in range(180_000))
    odd = [(None, corpus[4][1] + " alone here", "en", None, 1), (None, corpus[70][1], "en", "s1", 1), (1000, long, "en", "s1", None), (None, None, None, None, None), (1001, corpus[6][1] + " twice told", None, None, 3)]
    frame = spark.createDataFrame(corpus + [*odd, odd[-1]], docs.schema).withColumns({c: F.lit(7) for c in ("copy", "size", "group", "score", "word", "item_id", "class_id", "lines", "_range")})
    frame.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, corpus[70][1])], "item_id long, text string").coalesce(1).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert len(long) > 2 << 20
    where, got = str(tmp_path), frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = got
        got = kept(stage(spark, got, where))
        assert got.columns == frame.columns and got.count() <= before.count()
    left = got.collect()
    assert [r.text for r in left if r.doc_id is None] == [odd[0][1]]
    assert [len(r.text) for r in left if r.doc_id == 1000] == [len(long)]
    assert sum(r.doc_id == 1001 for r in left) in (0, 2)
    mixed = kept(corpus_pipeline.STAGES[-1][1](spark, got, where))
    assert mixed.columns == [c for c in frame.columns if c != "copy"] + ["copy"] and mixed.where("copy < 1").count() == 0
