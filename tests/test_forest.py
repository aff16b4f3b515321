"""Forests grown by histograms and subtrees: the same trees however large nodes are split, with the stated draws."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from holdfast.operators import forest, forest_model, models
from holdfast.schema import ID
from holdfast.session import durable, new_scratch_path


@pytest.fixture(scope="module")
def rows(spark):
    rng, listed = random.Random(5), []
    for i in range(900):
        x = [rng.gauss(0, 1), rng.gauss(0, 1), float(rng.randrange(4)), 1.0]
        y = float(rng.random() < (0.8 if x[0] + (x[2] == 2) > 0.3 else 0.2))
        listed.append((i if i % 90 else None, Vectors.dense(x), y))
    attrs = {"numeric": [{"idx": i, "name": f"x{i}"} for i in (0, 1, 3)], "nominal": [{"idx": 2, "name": "kind", "vals": list("abcd")}]}
    df = spark.createDataFrame(listed, [ID, "features", "_label"])
    return durable(df.withColumn("features", F.col("features").alias("features", metadata={"ml_attr": {"attrs": attrs, "num_attrs": 4}})))


def scored(model, rows):
    got = model.transform(rows).select("features", vector_to_array("probability")[1].alias("p")).collect()
    return sorted((tuple(r.features.toArray()), r.p) for r in got)


@pytest.mark.parametrize("depth", [3, 30])
@pytest.mark.parametrize("by_tree", [False, True])
def test_large_nodes_and_subtrees_give_the_same_trees(rows, monkeypatch, depth, by_tree):
    whole = forest.grow_forest(rows, 4, depth, 5, by_tree=by_tree)
    monkeypatch.setattr(forest, "NODE_ROWS", 60)
    monkeypatch.setattr(forest, "NODES_AT_ONCE", 3)
    split = forest.grow_forest(rows.repartition(5), 4, depth, 5, by_tree=by_tree)
    assert scored(whole, rows) == scored(split, rows)
    assert whole.totalNumNodes == split.totalNumNodes > 4 * 3 and whole.getNumTrees == 4
    assert max(t.depth for t in split.trees) <= depth and (depth == 3 or max(t.depth for t in split.trees) > 4)
    assert "in {" in whole.toDebugString  # categories are split as sets


def test_rows_of_a_large_leaf_are_not_moved(spark, monkeypatch):
    monkeypatch.setattr(forest, "NODE_ROWS", 50)
    same = spark.createDataFrame([(i, Vectors.dense([1.0, 2.0]), float(i % 3 == 0)) for i in range(400)], [ID, "features", "_label"])
    model = forest.grow_forest(same, 2, 30, 5)
    assert model.totalNumNodes == 2 and {round(p, 1) for _, p in scored(model, same)} == {0.5}


def test_draws_are_those_of_the_bootstrap(rows):
    hashed = rows.select(F.xxhash64(F.col(ID), F.lit(models.SEED)).alias("h")).collect()
    for tree in (0, 7, 299):
        drawn = forest.draws(np.array([r.h for r in hashed], np.int64), tree)
        by_class = models.balanced_bootstrap(rows, tree)
        assert (drawn > 0).sum() == by_class.count()
        # the drawn classes weigh the same: all weights together are the draws
        assert by_class.agg(F.sum("_weight")).first()[0] == pytest.approx(drawn.sum())


def test_leaves_hold_their_rows(rows):
    """A tree's leaf gives the weighted share of churners among the rows it drew there."""
    model = forest.grow_forest(rows, 1, 3, 5)
    listed = rows.select(F.xxhash64(F.col(ID), F.lit(forest.SEED)).alias("h"), "features", "_label").collect()
    drawn = forest.draws(np.array([r.h for r in listed], np.int64), 0)
    ones = sum(r._label for r in listed)
    weight = {0.0: len(listed) / (2 * (len(listed) - ones)), 1.0: len(listed) / (2 * ones)}
    tree = model.trees[0]
    by_leaf = {}
    for r, n in zip(listed, drawn):
        if n:
            by_leaf.setdefault(tree.predictLeaf(r.features), []).append((r._label, weight[r._label] * n, n, r.features))
    assert len(by_leaf) > 2
    for got in by_leaf.values():
        share = sum(w for y, w, _, _ in got if y) / sum(w for _, w, _, _ in got)
        assert sum(n for _, _, n, _ in got) >= 5 and model.predictProbability(got[0][3])[1] == pytest.approx(share)


def test_trees_are_files_and_nothing_of_them_is_on_the_driver(spark, rows):
    model = forest.grow_forest(rows, 3, 30, 5)
    assert not hasattr(model, "_java_obj") and sorted(os.listdir(model.folder)) == ["0.arrow", "1.arrow", "2.arrow"]
    path = new_scratch_path(spark)
    model.write().save(path)
    again = forest_model.ForestModel.load(path)
    assert again.folder != model.folder and sorted(os.listdir(again.folder)) == sorted(os.listdir(model.folder))
    assert scored(again, rows) == scored(model, rows) and again.toDebugString.splitlines()[1:] == model.toDebugString.splitlines()[1:]
    assert again.featureImportances == model.featureImportances and sum(model.featureImportances) == pytest.approx(1)
    one = rows.first()
    got = model.transform(rows.limit(1)).first()
    assert model.predictProbability(one.features) == got.probability and model.predict(one.features) == got.prediction


def test_rows_are_scored_in_bounded_chunks(monkeypatch):
    monkeypatch.setattr(forest_model, "SCORE_ROWS", 10)
    shape = forest_model.Bins([np.array([0.5]), np.zeros(0)], np.array([0, 3]), 32)
    x = [[i % 2, i % 3] for i in range(47)]
    batches = [pa.array([list(map(float, r)) for r in x[a:b]], pa.list_(pa.float64())) for a, b in ((0, 3), (3, 30), (30, 30), (30, 47))]
    chunks = list(forest_model._chunks(iter(batches), shape))
    assert max(map(len, chunks)) <= 10 and np.concatenate(chunks).tolist() == x
