"""Cases that earlier versions got wrong: grids, exact ids, one class only, boosting that trains."""

import os

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from holdfast.functions.scalars import half_up, half_up_sql
from holdfast.operators import blend, boosting, campaign, metrics, models, split
from holdfast.operators.models import Boosting
from holdfast.schema import ID, TARGET
from holdfast.session import durable, scratch_root
from holdfast.sources.csv import load_customers, read_table


def test_grid_is_the_published_one(spark):
    assert metrics.GRID == np.linspace(0.05, 0.95, 181).tolist()
    on_grid = spark.createDataFrame([(float(p),) for p in metrics.GRID], "p double")
    steps = [r[0] for r in on_grid.orderBy("p").select(metrics.grid_index(F.col("p"))).collect()]
    assert steps == list(range(1, 182))
    edges = spark.createDataFrame([(0.0,), (0.06,), (0.95,), (1.0,)], "p double")
    assert [r[0] for r in edges.orderBy("p").select(metrics.grid_index(F.col("p"))).collect()] == [0, 3, 181, 181]


def test_rounding_does_not_saturate(spark):
    row = spark.createDataFrame([(2e13, -2.5, 1e300)], "a double, b double, c double").select(
        half_up(F.col("a"), 6), F.expr(half_up_sql("b", 0)), F.expr(half_up_sql("c", 2))).first()
    assert list(row) == [2e13, -3.0, 1e300]


def test_base_rate_shift_at_the_ends(spark):
    row = spark.createDataFrame([(0.0,), (1.0,)], "p double").select(campaign.shift_base_rate(F.col("p"), 0.5, 0.2)).collect()
    assert sorted(r[0] for r in row) == [0.0, 1.0]


def test_one_class_keeps_its_row(spark):
    scores = spark.createDataFrame([("a", 1, 0.3), ("a", 1, 0.6), ("b", 0, 0.2), ("b", 1, 0.4)], f"model string, {TARGET} int, p double")
    found = {r["model"]: r for r in metrics.ranking_metrics(scores).collect()}
    assert found["a"]["roc_auc"] is None and found["a"]["positives"] == 2 and found["b"]["roc_auc"] == 1.0
    assert metrics.roc_curve(scores).where("model = 'a' and fpr is null").count() == 2


def test_rows_without_a_segment_get_controls(spark):
    rows = durable(spark.createDataFrame([(i, None if i < 50 else "x") for i in range(100)], f"{ID} long, segment string"))
    arms = split.hash_holdout(rows, "segment").where("arm = 'control'").groupBy("segment").count().collect()
    assert {r["segment"]: r["count"] for r in arms} == {None: 5, "x": 5}


def test_long_member_names_stay_apart(spark):
    names = ["m" * 120 + "1", "m" * 120 + "2"]
    wide = spark.createDataFrame([(1, 0.1, 0.2)], f"{ID} long, `p_{names[0]}` double, `p_{names[1]}` double")
    assert {r["model"] for r in blend.long_scores(wide, names, [ID]).collect()} == set(names)


def write(folder, name, text):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)


def test_ids_are_kept_exactly(spark, tmp_path):
    write(tmp_path, "Client.csv", "Customer_ID,months\n9007199254740993,3\n9007199254740992,4.5\n")
    write(tmp_path, "Record.csv", "churn,Customer_ID\n1,9007199254740993\n0.0,9007199254740992\n")
    rows = load_customers(spark, str(tmp_path)).collect()
    assert {r[ID]: (r["months"], r[TARGET]) for r in rows} == {9007199254740993: (3.0, 1), 9007199254740992: (4.5, 0)}


def test_text_ids(spark, tmp_path):
    write(tmp_path, "Client.csv", "Customer_ID,months\nC-001,3\n12,NA\n")
    write(tmp_path, "Record.csv", "Customer_ID,churn\nC-001,1\n12,0\n")
    assert {r[ID]: r["months"] for r in load_customers(spark, str(tmp_path)).collect()} == {"C-001": 3.0, "12": None}


@pytest.mark.parametrize("target", ["0.5", "1.7", "yes"])
def test_fractional_targets_are_rejected(spark, tmp_path, target):
    write(tmp_path, "Client.csv", "Customer_ID,months\n1,3\n2,4\n")
    write(tmp_path, "Record.csv", f"Customer_ID,churn\n1,{target}\n2,0\n")
    with pytest.raises((ValueError, PySparkException)):
        load_customers(spark, str(tmp_path)).collect()


def test_codes_quotes_and_line_breaks(spark, tmp_path):
    write(tmp_path, "t.csv", 'code,said,n\n1D,"he said ""hi, you""",7\n2F,"two\nlines",8.5\n')
    rows = read_table(spark, str(tmp_path / "t.csv")).orderBy("n").collect()
    assert [tuple(r) for r in rows] == [("1D", 'he said "hi, you"', 7.0), ("2F", "two\nlines", 8.5)]


@pytest.fixture(scope="module")
def planted(spark):
    """Customers whose churn follows several thresholds, so that one tree cannot say it all."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(4000, 5))
    odds = 1.2 * np.sin(2 * x[:, 0]) + x[:, 1] * x[:, 2] + 0.8 * x[:, 3]
    churn = rng.random(4000) < 1 / (1 + np.exp(-2 * odds))
    rows = [(i, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(churn, x))]
    return durable(spark.createDataFrame(rows, f"{ID} long, {TARGET} int, a double, b double, c double, d double, e double"))


def auc(scored):
    return metrics.ranking_metrics(scored.withColumn("model", F.lit("m"))).first()["roc_auc"]


def test_boosting_uses_its_rounds(planted):
    train, valid = planted.where(f"{ID} % 4 > 0"), planted.where(f"{ID} % 4 = 0")
    fitted = models.fit_boosting(train, Boosting(20, 0.4, 3, patience=10), valid)
    single = models.fit_boosting(train, Boosting(1, 0.2, 3), valid)
    assert fitted.pipeline.stages[-1].getNumTrees > 10
    assert auc(fitted.score(valid)) > auc(single.score(valid)) + 0.02


def test_best_round_and_patience():
    assert boosting.best_round([3.0, 2.0, 2.5, 2.4, 2.3], 3) == (2, True)
    assert boosting.best_round([3.0, 2.0, 2.5], 3) == (2, False)
    assert boosting.best_round([3.0, 2.0, 1.0], 1) == (3, False)


def test_logistic_without_text_and_with_an_empty_column(planted):
    train = planted.withColumn("nothing", F.lit(None).cast("double"))
    model = models.fit_logistic(train, iterations=5)
    assert model.score(train).where("p between 0 and 1").count() == 4000 and "numeric__nothing" not in model.inputs


def test_fits_leave_no_tables(spark, planted):
    def left():
        return len(os.listdir(scratch_root(spark).removeprefix("file:")))

    before = left()
    models.fit_boosting(planted, Boosting(2, 0.2, 2))
    models.fit_forest(planted, 2, 2)
    assert left() == before
