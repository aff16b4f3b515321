"""Every query with an SQL equivalent gives the same rows on a second engine."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from holdfast.operators.models import Boosting
from holdfast.plans import model_queries

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def engine(folder):
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)


def canonical(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(repr(tuple(row)) for row in frame.itertuples(index=False))


@pytest.fixture(autouse=True)
def quick_fits(monkeypatch):
    """What the model queries state does not depend on how long a fit takes."""
    monkeypatch.setattr(model_queries, "PRESETS", {k: Boosting(4, 0.3, 3, patience=2) for k in model_queries.PRESETS})
    monkeypatch.setattr(model_queries, "FOREST", {"trees": 5, "depth": 4})
    monkeypatch.setattr(model_queries, "ITERATIONS", 20)


@pytest.mark.parametrize("key", sorted(SQL))
def test_same_rows(spark, folder, engine, key):
    ours = QUERIES[key](spark, folder).toPandas()
    theirs = engine.execute(SQL[key]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert {c: str(ours[c].dtype) for c in ours} == {c: str(theirs[c].dtype) for c in ours}
    assert canonical(ours) == canonical(theirs)
