"""Fitted models on data with a planted driver: they rank, save, reload, and never see test rows."""

import random

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from holdfast.operators import importance, metrics, models, prep, split
from holdfast.operators.features import FeatureEngineer
from holdfast.operators.models import Boosting
from holdfast.operators.stages import CategoryFill, MedianImputer, RareCategoryGrouper, Standardiser
from holdfast.plans import jobs, training
from holdfast.schema import DERIVED_FEATURES, ID, TARGET
from holdfast.session import durable, new_scratch_path
from holdfast.sources import results
from holdfast.sources.subscriber import subscriber_table

SMALL = Boosting(3, 0.3, 3)
SMALL_PRESETS = {name: Boosting(2, 0.3, 2) for name in models.BOOSTING}


@pytest.fixture(scope="module")
def customers(spark):
    rng = random.Random(11)
    rows = []
    for i in range(600):
        driver, noise = rng.gauss(0, 1), rng.gauss(0, 1)
        kind = rng.choice("abc")
        y = int(rng.random() < (0.85 if driver + (kind == "c") > 0.4 else 0.15))
        rows.append((i, y, driver if rng.random() > 0.1 else None, noise, kind if rng.random() > 0.1 else None))
    df = spark.createDataFrame(rows, f"{ID} long, {TARGET} int, driver double, noise double, kind string")
    return durable(split.stratified_split(durable(df)))


def auc(scored):
    return metrics.ranking_metrics(scored.withColumn("model", F.lit("m"))).first().roc_auc


@pytest.mark.parametrize("fit", [
    lambda train: models.fit_logistic(train, iterations=30),
    lambda train: models.fit_forest(train, 10, 4),
    lambda train: models.fit_boosting(train, SMALL),
], ids=["logistic", "forest", "boosting"])
def test_models_rank_and_reload(spark, customers, fit):
    model = fit(training.part(customers, "train"))
    test = training.part(customers, "test")
    scored = durable(model.score(test))
    assert scored.columns == [*test.columns, "p"] and auc(scored) > 0.7
    path = new_scratch_path(spark)
    models.save(model.pipeline, path)
    again = models.score(PipelineModel.load(path), test)
    assert {r[ID]: r.p for r in again.collect()} == {r[ID]: r.p for r in scored.collect()}


def test_drawn_classes_weigh_the_same_in_every_tree(spark, customers):
    rows = models.with_label(customers.where(f"{TARGET} = 1 or {ID} % 5 = 0"))
    for tree in range(4):
        drawn = models.balanced_bootstrap(rows, tree)
        totals = {r["_label"]: r["w"] for r in drawn.groupBy("_label").agg(F.sum("_weight").alias("w")).collect()}
        assert totals[0.0] == pytest.approx(totals[1.0])
        share = drawn.count() / rows.count()
        assert 0.5 < share < 0.75  # about 1 - 1/e of the rows are drawn
        again = models.balanced_bootstrap(rows.repartition(7), tree)
        assert sorted(again.select(ID, "_weight").collect()) == sorted(drawn.select(ID, "_weight").collect())


def test_balanced_forest_ranks_and_reloads(spark, customers):
    model = models.fit_balanced_forest(training.part(customers, "train"), 5, 4)
    test = training.part(customers, "test")
    scored = durable(model.score(test))
    assert auc(scored) > 0.7 and model.pipeline.stages[-1].getNumTrees == 5
    path = new_scratch_path(spark)
    models.save(model.pipeline, path)
    assert {r[ID]: r.p for r in models.score(PipelineModel.load(path), test).collect()} == {r[ID]: r.p for r in scored.collect()}


def test_linear_inputs_have_names(customers):
    model = models.fit_logistic(training.part(customers, "train"), iterations=5)
    assert model.inputs == ["numeric__driver", "numeric__noise", "categorical__kind_a", "categorical__kind_b", "categorical__kind_c"]
    assert model.pipeline.stages[-1].numFeatures == 5


def test_permuted_names_may_hold_any_character(customers):
    odd = customers.withColumnRenamed("noise", "no|ise")
    table = importance.permutation_importance(odd, lambda d: d.withColumn("p", F.coalesce("driver", F.lit(0.0))), ["driver", "no|ise"])
    drops = {r.feature: r.importance_mean for r in table.collect()}
    assert set(drops) == {"driver", "no|ise"} and drops["no|ise"] == 0 and drops["driver"] > 0.05


def test_gain_and_permutation_find_the_driver(customers):
    model = models.fit_boosting(training.part(customers, "train"), SMALL)
    gains = dict(models.gain_importance(model))
    assert max(gains, key=gains.get) == "numeric__driver"
    assert {"numeric__missingindicator_driver", "categorical__kind", "categorical__missingindicator_kind"} <= set(gains)
    valid = training.part(customers, "validation").drop("part")
    table = importance.permutation_importance(valid, model.score, ["driver", "noise", "kind"])
    drops = {r.feature: r.importance_mean for r in table.collect()}
    assert max(drops, key=drops.get) == "driver" and drops["driver"] > 0.05


def test_encoded_categories_and_validation_stop(customers):
    encoded = training.encode_categories(customers)
    assert "kind" not in encoded.columns and encoded.filter("kind_te is null").count() == 0
    model = training.fit_categorical(encoded, "cat_d6", {"cat_d6": SMALL})
    assert auc(model.score(training.part(encoded, "test"))) > 0.7


def test_selection_scores_test_once_for_the_winner(customers):
    fitted = {"boosting": models.fit_boosting(training.part(customers, "train"), SMALL),
              "forest": models.fit_forest(training.part(customers, "train"), 5, 3)}
    name, threshold, table, test = training.select_model(customers, fitted)
    rows = table.collect()
    assert name == max(rows, key=lambda r: r.roc_auc).model and 0.05 <= threshold <= 0.95
    assert {r.model for r in test.collect()} == {name}


def test_preset_sizes():
    assert models.BOOSTING["cat_d8"] == Boosting(1500, 0.035, 8, measure="auc", l2=10.0)
    assert models.BOOSTING["gbt_engineered"].l1 == 0.5 and models.BOOSTING["gbt_base"].measure == "loss"


def test_sensitive_predictors_can_be_left_out(customers):
    numeric, text = models.feature_groups(customers, leave_out=["kind"])
    assert numeric == ["driver", "noise"] and text == []


def test_stages_in_a_pipeline_save_and_reload(spark):
    rows = [(1.0, 2.0, "x"), (None, 4.0, "x"), (3.0, 8.0, None)] * 6 + [(5.0, 1.0, "y")]
    df = spark.createDataFrame(rows, "a double, b double, c string")
    pipeline = Pipeline(stages=[MedianImputer(columns=["a", "b"]), Standardiser(columns=["b"]),
                                CategoryFill(columns=["c"], flagged=["c"]), RareCategoryGrouper(columns=["c"])])
    fitted = pipeline.fit(df)
    path = new_scratch_path(spark)
    fitted.write().overwrite().save(path)
    again = PipelineModel.load(path)
    probe = spark.createDataFrame([(None, 2.0, None), (1.0, None, "y"), (1.0, 1.0, "new")], df.schema)
    want, got = fitted.transform(probe).collect(), again.transform(probe).collect()
    assert want == got
    assert [r.numeric__missingindicator_a for r in got] == [1.0, 0.0, 0.0]
    assert [r.c for r in got] == ["__INFREQUENT__" if r is got[1] else None if r is got[2] else got[0].c for r in got]


def test_feature_stage_reloads(spark, tmp_path):
    columns = sorted({c for f in DERIVED_FEATURES for c in (f.left, f.right)})
    df = spark.range(3).select(*[(F.col("id") + i).cast("double").alias(c) for i, c in enumerate(columns)])
    FeatureEngineer().write().overwrite().save(str(tmp_path / "fe"))
    out = FeatureEngineer.load(str(tmp_path / "fe")).transform(df)
    assert len(out.columns) == len(columns) + 34


def test_target_lookup_agrees_with_the_ordered_encoding(customers):
    lookup, prior = prep.fit_target_lookup(training.part(customers, "train"), ["kind"])
    ordered = {r[ID]: r.encoded for r in prep.ordered_target_encode(customers, ["kind"]).collect() if r.part == "test"}
    test = training.part(customers, "test")
    got = {r[ID]: r.kind_te for r in prep.apply_target_lookup(test, lookup, prior, ["kind"]).collect()}
    assert got == pytest.approx(ordered)
    unseen = prep.apply_target_lookup(test.limit(1).withColumn("kind", F.lit("new")), lookup, prior, ["kind"])
    assert unseen.first().kind_te == pytest.approx(prior)


def test_whole_runs_write_their_results(spark, folder):
    """Baselines, ensemble and final blend, each on every customer, then scoring without labels."""
    df = durable(split.stratified_split(durable(subscriber_table(spark, folder))))
    out = new_scratch_path(spark)
    document = jobs.run_baselines(df, f"{out}/base", SMALL_PRESETS, trees=3, forest_depth=3, iterations=10).first()
    assert document.feature_count == 42 and document.split_rows.train + document.split_rows.test < df.count()
    table = results.read_result_csv(spark, f"{out}/base/validation_metrics", results.METRICS_SCHEMA)
    assert table.count() == 3
    jobs.run_ensemble(df, f"{out}/ensemble", SMALL_PRESETS)
    final = jobs.run_final(df, f"{out}/ensemble", f"{out}/final", SMALL_PRESETS).first()
    assert final.weights.engineered == 0.65 and 0 <= final.test_metrics_at_0_5.roc_auc <= 1
    fresh = df.drop(TARGET, "part")
    scored = jobs.score_customers(spark, fresh, f"{out}/final/model")
    assert scored.filter("p between 0 and 1").count() == df.count()
    with pytest.raises(ValueError, match="Missing required features"):
        jobs.score_customers(spark, fresh.drop("months"), f"{out}/final/model")
