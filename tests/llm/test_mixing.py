"""The mix against its SQL, and its targets."""

import duckdb
import pytest

from holdfast.llm import mixing, queries


def test_same_as_sql(spark, folder):
    got = queries.op5_mixing(spark, folder).toPandas().sort_values("doc_id", ignore_index=True)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(mixing.MIX_SQL).df().sort_values("doc_id", ignore_index=True)[got.columns]
    assert got.equals(want.astype(got.dtypes))
    assert (got.taken <= 2 * got["size"]).all()


def test_targets_are_reshared(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), (None, 50)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    # 1740 words at weights 5, 2, 1, 5: a, b and NULL stop at 20, 200 and 100; c has the rest.
    assert got == {"a": 20.0, "b": 200.0, "c": pytest.approx(1420.0), None: 100.0}


def test_taken_words_come_near_the_targets(spark):
    rows = [(i, "w " * (1 + i % 7), "abc"[i % 3]) for i in range(3000)]
    got = mixing.taken_words(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)).toPandas()
    for _, part in got.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max() / 2 + 1e-6
    again = mixing.taken_words(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string")).toPandas()
    key = ["doc_id", "taken"]
    assert sorted(got[key].itertuples(index=False)) == sorted(again[key].itertuples(index=False))


def test_awkward_rows(awkward, empty):
    taken = mixing.taken_words(awkward).collect()
    assert len(taken) == awkward.count() and all(0 <= r.taken <= 2 * r.size for r in taken)
    assert {r.size for r in taken if r.doc_id in (2, 3, 4)} == {0}
    mixed = mixing.mix(awkward)
    assert mixed.columns == awkward.columns
    assert mixing.taken_words(empty).count() == mixing.mix(empty).count() == 0
    blank = awkward.where("doc_id in (2, 3, 4)")
    assert mixing.mix(blank).count() == 0 and {r.target for r in mixing.taken_words(blank).collect()} == {0.0}
