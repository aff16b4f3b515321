"""Hard negatives against all pairs in plain Python."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from holdfast.llm import hard_negatives as hn
from holdfast.llm import queries

SCHEMA = "vec_id long, label long, vector array<double>"


def brute(rows, asks, k=5, m=5):
    def clip(s):
        return max(-hn.MOST, min(hn.MOST, s))

    rows = [(i, y, [int(v) for v in x]) for i, y, x in rows]
    out = []
    for a, label, q in rows:
        if not asks(a):
            continue
        seen = sorted(((-clip(sum(p * v for p, v in zip(q, x))), i, y) for i, y, x in rows if i != a), key=lambda r: r[:2])
        for s, p, _ in [r for r in seen if r[2] == label][:k]:
            fits = [(-t, i) for t, i, y in seen if y != label and 80 * -s <= 100 * -t <= 100 * -s]
            out += [(a, p, n, i, -s, t) for n, (t, i) in enumerate(fits[:m], 1)]
    return Counter(out)


def mined(spark, rows, asks, parts=3, **options):
    frame = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    return Counter(tuple(r) for r in hn.mine(frame, asks, **options).collect())


@pytest.mark.parametrize("span,width,labels", [(1, 2, 2), (3, 3, 3), (100, 6, 4), (100, 1, 2)])
def test_all_pairs(spark, span, width, labels):
    # A small span gives many equal scores; pages of 7 rows give a tree with many boxes.
    rng = random.Random(span)
    rows = [(i * 3, rng.randrange(labels), [float(rng.randint(-span, span + 2)) for _ in range(width)]) for i in range(300)]
    rows += [(5000 + i, 1, [2.0] * width) for i in range(100)]  # equal vectors
    want = brute(rows, lambda i: i % 9 == 0)
    assert want
    for options in ({"page_rows": 7, "chunk": 16}, {}):
        assert mined(spark, rows, F.col("vec_id") % 9 == 0, **options) == want


def test_large_and_tiny_numbers(spark):
    rng = random.Random(1)
    rows = [(i, i % 3, [float(rng.randint(-9, 9)) * scale for _ in range(4)])
            for i, scale in enumerate([1] * 40 + [2.0**30] * 10 + [2.0**70] * 6 + [1e200, 1e307] + [0] * 3)]
    assert mined(spark, rows, F.col("vec_id") % 4 == 0, page_rows=5) == brute(rows, lambda i: i % 4 == 0)


def test_scores_are_exact():
    rng = np.random.default_rng(0)
    q = np.rint(rng.normal(size=(20, 8)) * 10.0 ** rng.integers(0, 25, (20, 1)))
    x = np.rint(rng.normal(size=(30, 8)) * 10.0 ** rng.integers(0, 25, (30, 1)))
    want = [[max(-hn.MOST, min(hn.MOST, sum(int(a) * int(b) for a, b in zip(r, s)))) for s in x] for r in q]
    assert hn.scores(q, x).tolist() == want
    box = hn.Box(x.min(axis=0)[None], x.max(axis=0)[None], *[np.zeros(1, np.int64)] * 3)
    low, high = box.bounds(q)
    assert all(a <= min(w) and max(w) <= b for a, b, w in zip(low[:, 0].tolist(), high[:, 0].tolist(), want))


def test_rows_that_take_no_part_and_repeated_ids(spark):
    rng = random.Random(6)
    rows = [(i, rng.randrange(2), [float(rng.randint(-5, 5)) for _ in range(3)]) for i in range(60)]
    rows += [(8, 1, [4.0, 4.0, 4.0]), (8, 0, [-1.0, 2.0, 3.0]), (9, 0, [5.0, 5.0, 5.0]), (9, 0, [5.0, 5.0, 5.0])]
    odd = [(None, 1, [9.0] * 3), (70, None, [9.0] * 3), (71, 1, None), (72, 1, [9.0, None, 9.0]), (73, 1, [9.0, float("nan"), 1.0]),
           (74, 1, [9.0, float("inf"), 1.0]), (75, 1, []), (76, 1, [9.0] * 4), (100, None, [1.0] * 3), (104, 1, None)]
    want = brute(rows, lambda i: i % 4 == 0)
    results = [mined(spark, rows + odd, F.col("vec_id") % 4 == 0, parts) for parts in (1, 2, 5)]
    assert results == [want] * 3


def test_nothing_to_find(spark):
    some = [(1, 1, [1.0]), (100, 1, [1.0])]
    assert not mined(spark, some, F.col("vec_id") % 100 == 0)  # no other label
    assert not mined(spark, some[:1], F.col("vec_id") % 100 == 0)  # no anchor
    assert hn.mine(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 100 == 0).count() == 0


def test_whole_256ths(spark):
    values = [0.5, -0.001, 1 / 256, 3.4e38, -1e308, float("nan"), float("inf"), None, -0.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(hn.whole_256ths(F.col("x"))).collect()]
    assert got[:4] == [128.0, -1.0, 1.0, 256 * 3.4e38] and got[4] == -1.7976931348623157e308
    assert got[5] != got[5] and got[6] == float("inf") and got[7] is None and got[8] == 0


def test_registered_query(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").collect()
    ready = [(r.vec_id, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label, [np.floor(256 * float(x)) for x in r.embedding])
             for r in rows]
    got = Counter(tuple(r) for r in queries.op13_hard_negatives(spark, folder).collect())
    assert got == brute(ready, lambda i: i % 100 == 0) and got
