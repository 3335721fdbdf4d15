"""The parallel CSV reader against Python's csv module, on files whose splits fall anywhere."""

import csv
import io
import random

import pytest

from muster.sources import read_cells, read_csv
from muster.sources.csv_text import _splits, csv_lines


def expected(text):
    rows = csv.reader(io.StringIO(text.removeprefix("﻿"), newline=""))
    return {(i, j): v for i, row in enumerate(rows) for j, v in enumerate(row) if v.strip()}


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(4)
    signs = ["a", "b", ",", '"', '""', "\n", "x y", '"', ",", "é"]
    out = {f"r{k}": "".join(rnd.choice(signs) for _ in range(rnd.randint(0, 300))) + 'z"' for k in range(40)}
    big = io.StringIO()
    csv.writer(big, quoting=csv.QUOTE_ALL, lineterminator="\n").writerows([k, rnd.choice(["a\nb", "x,y", 'say "hi"', "", "p\n\nq\n", '"']), f"u{k}@x.vn"] for k in range(2000))
    return out | {"big": big.getvalue(), "bom": '﻿a,b\r\n"c\r\nd",e\r\n\r\nf', "open": 'a,b\nc,"d\ne,f', "tên lạ [1]": "x,y\n"}


def test_equals_the_csv_module(spark, texts, tmp_path):
    for name, text in texts.items():
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    got = {}
    for r in read_csv(spark, str(tmp_path), split_bytes=600).collect():
        got.setdefault(r.file.removesuffix(".csv"), {})[r.row_pos, r.col_idx] = r.value
    for name, text in texts.items():
        assert got.get(name, {}) == expected(text), text


def test_small_splits_share_tasks(spark, texts, tmp_path):
    (tmp_path / "big.csv").write_bytes(texts["big"].encode())
    with _splits(spark, 100):
        lines = csv_lines(spark, [str(tmp_path)], 100)
        tasks, rows = lines.rdd.getNumPartitions(), lines.orderBy("_range", "place").collect()
    assert len({r._range for r in rows}) > 300 and tasks <= 8 * spark.sparkContext.defaultParallelism
    assert len({r.place for r in rows}) == len(rows) and "\n".join(r.line for r in rows) + "\n" == texts["big"]


def test_all_files_are_one_scan_and_a_file_is_read_once(spark, tmp_path):
    paths = [str(tmp_path / f"f{k}.csv") for k in range(60)]
    for k, path in enumerate(paths):
        with open(path, "w") as f:
            f.write(f"v{k},w\n")
    cells = read_cells(spark, [*paths, paths[0], str(tmp_path / "none.csv"), str(tmp_path / "x.pdf")])
    assert cells.where("error is null").count() == 122 and cells.where("error is not null").count() == 2
    assert sorted({r.source_no for r in cells.where("file = 'f0.csv'").collect()}) == [0, 60]
