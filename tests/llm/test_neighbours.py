"""Nearest neighbours: recall against brute force, and the cases that take no part."""

import numpy as np
from pyspark.sql import functions as F

from holdfast.llm import neighbours, queries


def brute(ids, x, q, k=20):
    score = x @ x[np.flatnonzero(ids == q)[0]]
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
    return ids[order], score[order]


def recall(rows, ids, x):
    hits = total = 0
    for q, part in rows.groupby("query_id"):
        part = part.sort_values("rank")
        want, _ = brute(ids, x, q)
        hits, total = hits + len(set(want) & set(part.vec_id)), total + len(want)
        assert part["rank"].tolist() == list(range(1, len(part) + 1)) and (np.diff(part.score) <= 0).all()
        place = {v: i for i, v in enumerate(ids)}
        assert np.allclose(part.score, [x[place[v]] @ x[place[q]] for v in part.vec_id], atol=1e-12)
    return hits / total


def test_embeddings(spark, folder):
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids, x = table.vec_id.to_numpy(), np.stack(table.embedding).astype(float)
    rows = queries.op6_neighbours(spark, folder).toPandas()
    assert set(rows.query_id) == {i for i in ids if i % 20 == 0} and recall(rows, ids, x) >= 0.9


def test_many_cells_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CELL_ROWS", 100)
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "QUERIES", 7)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(12, 16))
    x = centres[rng.integers(12, size=1500)] + 0.3 * rng.normal(size=(1500, 16))
    x[500:900] = x[0]
    ids = np.arange(1500)
    frame = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>").repartition(4)
    rows = neighbours.nearest(frame, F.col("vec_id") % 20 == 0).toPandas()
    assert rows.query_id.nunique() == 75 and recall(rows, ids, x) >= 0.9


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [None, 1.0]),
            (6, [2.0, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (6, [2.0, 1.0]), (40, [inf, 0.0]), (8, [])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("score", F.lit("own"))
    got = sorted(tuple(r) for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 6, 2.0), (0, 2, 1, 1.0), (0, 3, 20, 1.0), (20, 1, 6, 2.0), (20, 2, 0, 1.0), (20, 3, 1, 1.0)]
    assert neighbours.nearest(frame.where("false"), F.lit(True)).count() == 0
    assert neighbours.nearest(frame.where("vec_id = 1"), F.lit(True)).count() == 0


def test_quantile_is_the_chi_square_one():
    assert abs(neighbours.chi_square_quantile(0.95, 8) - 15.50731) < 1e-4
    assert abs(neighbours.chi_square_quantile(0.5, 2) - 2 * np.log(2)) < 1e-9


def test_large_tiny_and_repeated(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6))
    x[7], x[20], x[40], x[60] = [1e200] + [0] * 5, x[20] * 1e-200, x[40] * 1e150, 0.5
    ids = np.arange(400)
    again = [(i, (x[i] + 1).tolist()) for i in range(0, 400, 3)]  # the least vector of an id counts
    rows = [(int(i), v.tolist()) for i, v in zip(ids, x)] + again + again[:20]
    least = np.array([min(v for i, v in rows if i == j) for j in ids])
    results = []
    for parts in (1, 2, 3, 5):
        frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(parts)
        results.append(sorted(tuple(r) for r in neighbours.nearest(frame, F.col("vec_id") % 20 == 0).collect()))
    assert all(r == results[0] for r in results)
    got = {}
    for q, rank, v, score in results[0]:
        got.setdefault(q, []).append(v)
    hits = [len(set(got[q]) & set(brute(ids, least, q)[0])) for q in range(0, 400, 20)]
    assert len(got) == 20 and all(len(v) == 20 for v in got.values()) and sum(hits) >= 0.9 * 400


def test_scores_beyond_the_doubles(spark):
    rows = [(0, [1e200, 1e200]), (1, [1e200, 0.0]), (2, [-1e200, 1e200]), (3, [1.0, 1.0]), (20, [1e-200, 1e-200])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [tuple(r)[2:] for r in neighbours.nearest(frame, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert got == [(1, float("inf")), (3, 2e200), (20, 2.0), (2, float("-inf"))]
