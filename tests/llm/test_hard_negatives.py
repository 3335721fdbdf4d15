"""Hard-negative mining against brute force: ties, few rows, hot vectors, both ways that blocks meet."""

import math
import random

import pytest
from pyspark.sql import functions as F

from muster.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, every=100, n_positives=5, n_negatives=10):
    ok = {}
    for i, v, label in rows:
        if i is not None and v is not None and label is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(256 * float(x)) for x in v]
            ok[i] = min(ok.get(i, (label, q)), (label, q))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, q) in ok.items():
        if a % every:
            continue
        scored = [(-dot(q, r), i, same == label) for i, (same, r) in ok.items() if i != a]
        for s, p, _ in sorted(x for x in scored if x[2])[:n_positives]:
            found = sorted(x for x in scored if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s)[:n_negatives]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(found)]
    return sorted(out)


def got(frame):
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in frame.collect())


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(12)
    centre = [[rnd.gauss(0, 1) for _ in range(6)] for _ in range(3)]
    near = lambda c: [round(x + rnd.gauss(0, 0.6), 2) for x in c]
    rows = [(k, near(centre[k % 3]), rnd.randrange(4)) for k in range(700)]
    hot = [0.5, 0.25, 0.0, 0.5, 0.5, 0.5]
    return rows + [(k, hot, k % 2) for k in range(700, 1100)]


def test_equals_brute_force(spark, rows):
    odd = [(None, [1.0] * 6, 1), (2000, None, 1), (2100, [float("nan")] * 6, 1), (2200, [1.0, None], 1), (2300, [1.0] * 6, None), (2400, [float("inf")] * 6, 1), (2500, [1.0, 1.0], 1), (2600, [], 2)]
    odd += [(600, [9.0] * 6, 9), (3, rows[3][1], rows[3][2])]
    want = brute(rows + odd)
    assert want and got(H.mine(spark.createDataFrame(rows + odd, SCHEMA).repartition(5))) == want


def test_blocks_and_digits_do_not_matter(spark, rows):
    frame, want = spark.createDataFrame(rows, SCHEMA).repartition(5), brute(rows)
    assert got(H.mine(frame, row_block=100, anchor_block=3, buckets=8, broadcast=0)) == want


def test_ids_of_any_size_and_few_rows(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(0, [1.0, 0.0], 1), (low, [0.5, 0.5], 2), (high, [0.5, 0.25], 2), (5, [1.0, 1.0], 1), (7, [0.5, 0.0], 1), (9, [0.6, 0.0], 3), (11, [-1.0, 0.0], 1)]
    assert got(H.mine(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    alone = [(0, [1.0], 1), (100, [1.0], 2)]
    assert got(H.mine(spark.createDataFrame(alone, SCHEMA))) == []
    assert H.mine(spark.createDataFrame([], SCHEMA)).count() == 0
    assert H.mine(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).count() == 0


def test_integers_beyond_doubles(spark):
    rows = [(k, [float(2**18 + k), float(2**17 * (k % 3))], k % 2) for k in range(0, 130)]
    assert got(H.mine(spark.createDataFrame(rows, SCHEMA))) == brute(rows)
    with pytest.raises(ValueError):
        H.mine(spark.createDataFrame([(0, [1e30], 1), (1, [1e30], 1)], SCHEMA))


def test_clashing_columns(spark, rows):
    frame = spark.createDataFrame(rows[:200], SCHEMA).withColumns({c: F.lit(1) for c in ("id", "q", "block", "score", "w", "rank", "row", "vector")})
    assert got(H.mine(frame)) == brute(rows[:200])
