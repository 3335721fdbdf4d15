"""Looks over ranges of a list give what windows over the whole list give, and no task has more than its range."""

import random

import pytest
from pyspark.sql import functions as F

from muster.operators import scan, search, sequence
from muster.staging import staged


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(2)
    data = [("long", k, rnd.choice([None, None, None, f"v{k}"]), rnd.randint(0, 2)) for k in range(600)]
    data += [(f"s{k % 7}", k, rnd.choice([None, f"v{k}"]), 1) for k in range(60)] + [("none", k, None, 0) for k in range(40)]
    rnd.shuffle(data)
    return staged(spark.createDataFrame(data, "source string, row_pos long, v string, n long"))


def looks():
    v = F.col("v")
    return {"a": scan.above(v), "u": scan.upto(v), "t": scan.total(F.col("n")), "b": scan.before(v), "f": scan.after(F.struct("v", "n"))}


@pytest.mark.parametrize("n", [1, 3, 25, None])
def test_ranges_equal_windows(spark, rows, n):
    plain = scan.look(rows, ["source"], **looks())
    dealt = scan.in_ranges(rows, ["source"], staged, n)
    cut = scan.look(dealt, ["source"], **looks())
    key = lambda df: sorted((tuple(r) for r in df.select("source", "row_pos", *looks()).collect()), key=repr)
    assert key(plain) == key(cut)
    if n == 25:
        sizes = [r["count"] for r in dealt.groupBy("source", scan.RANGE).count().collect()]
        assert max(sizes) < 100 and dealt.where("source = 'long'").select(scan.RANGE).distinct().count() > 10


def test_no_task_has_more_than_a_range(spark, rows):
    cut = scan.look(scan.in_ranges(rows, ["source"], staged, 20), ["source"], **looks())
    plan = cut._jdf.queryExecution().executedPlan().toString()
    windows = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line and scan.RANGE not in line]
    assert all("source" in x for x in windows)  # only the rows that ranges give, one a range and list, meet by list
    assert "SinglePartition" not in plan


def test_wrapped_rows_over_borders(spark):
    data = [("a", k, str(k) if k % 9 == 0 else None, f"N{k}" if k % 9 == 0 else None, f"u{k}@x.vn" if k % 9 in (0, 5) else ".", None) for k in range(300)]
    frame = spark.createDataFrame(data, "source string, row_pos long, stt string, raw_name string, raw_email string, raw_phone string")
    key = lambda df: sorted(map(tuple, df.select("row_pos", "n_rows", "raw_name", "raw_email").collect()))
    assert key(sequence.merge_continuations(frame)) == key(sequence.merge_continuations(scan.in_ranges(frame, ["source"], staged, 40)))
    fragments = spark.createDataFrame([("a", k, "", "Lê Văn" if k % 2 == 0 else "Mười", "a@x.vn" if k % 2 == 0 else "", "") for k in range(40)], frame.schema)
    key = lambda df: sorted(map(tuple, df.select("row_pos", "raw_name").collect()))
    assert key(sequence.join_name_fragments(fragments)) == key(sequence.join_name_fragments(scan.in_ranges(fragments, ["source"], staged, 13)))


def test_natural_order_and_pages(spark):
    values = ["a10", "a2", "A1", "b", "Đ3", "d03", "", None, "a2.10", "a2.9", "007", "7", "10"]
    frame = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v string, id long")
    got = [r.v for r in search.preview(frame, "v", ["id"]).collect()]
    assert got == ["", None, "007", "7", "10", "A1", "a2", "a2.9", "a2.10", "a10", "b", "Đ3", "d03"]
    pages = search.paged(frame, "v", ["id"], staged, 5).orderBy("nth").collect()
    assert [r.v for r in pages] == got and [r.page for r in pages] == [1] * 5 + [2] * 5 + [3] * 3
    first = search.preview(frame, "v", ["id"], limit=5).collect()
    assert [r.v for r in search.preview(frame, "v", ["id"], limit=5, start=first[-1].asDict()).collect()] == got[5:10]
    assert [r.v for r in search.preview(frame, "v", ["id"], True, 5, first[2].asDict()).collect()] == ["7", "", None]
    assert search.counts(frame, ["v"], "a").first() == (13, 5) and search.counts(frame, ["v"], " ").first() == (13, 13)
