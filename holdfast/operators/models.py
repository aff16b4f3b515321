"""Distributed classifiers for the churn target, fitted on the training part only.

MLlib learners stand in for single-machine boosters: same role and hyper-parameters where MLlib
has them. Training rows stay distributed; what reaches the driver is the model.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.ml import Model, Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.functions.scalars import hash_fraction, numeric_columns, text_columns
from holdfast.operators import metrics, prep
from holdfast.operators.boosting import Boosting, boost
from holdfast.operators.forest import POISSON, grow_forest
from holdfast.operators.stages import CategoryFill, MedianImputer, RareCategoryGrouper, Standardiser
from holdfast.schema import ID, TARGET
from holdfast.session import durable, frees_scratch

SEED = 42
RESERVED = (ID, TARGET, "part", "_weight", "_holdout", "_label")


# The settings each model was published with.
BOOSTING = {
    "gbt_base": Boosting(250, 0.08, 5, 30, patience=10, l2=1.0),
    "cat_d6": Boosting(1500, 0.05, 6, measure="auc", l2=5.0),
    "cat_d7": Boosting(1500, 0.04, 7, measure="auc", l2=7.0),
    "cat_d8": Boosting(1500, 0.035, 8, measure="auc", l2=10.0),
    "gbt_engineered": Boosting(2500, 0.015, 6, 150, "0.75", measure="auc", l2=7.0, l1=0.5),
    "tutorial": Boosting(300, 0.05, 6, l2=1.0),
}
# The published forest has no depth limit; 30 is the most that MLlib allows.
FOREST_TREES, FOREST_DEPTH, FOREST_MIN_ROWS = 300, 30, 5


def feature_groups(df: DataFrame, leave_out: Sequence[str] = ()) -> tuple[list[str], list[str]]:
    """Numeric and categorical predictors by type; ``leave_out`` names predictors not to use."""
    skip = (*RESERVED, *leave_out)
    numeric, categorical = numeric_columns(df, skip), text_columns(df, skip)
    other = set(df.columns) - set(skip) - set(numeric) - set(categorical)
    if other:
        raise ValueError(f"Predictors that are neither numeric nor text: {sorted(other)}")
    return numeric, categorical


def with_class_weights(train: DataFrame) -> DataFrame:
    """Weight n / (2 * rows of the class), so both classes weigh the same in total."""
    counts = {r[TARGET]: r["n"] for r in train.groupBy(TARGET).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    weight = F.lit(1.0)
    for cls, n in counts.items():
        weight = F.when(F.col(TARGET) == cls, total / (len(counts) * n)).otherwise(weight)
    return train.withColumn("_weight", weight)


def with_label(df: DataFrame) -> DataFrame:
    return df.withColumn("_label", F.col(TARGET).cast("double"))


class FittedModel(NamedTuple):
    """A fitted pipeline and the names of its input vector's slots."""

    pipeline: PipelineModel
    inputs: list[str]

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with the churn probability ``p``; saved and unsaved models give the same."""
        return score(self.pipeline, df)


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    added = model.transform(df).withColumn("p", vector_to_array("probability")[1])
    return added.select(*[F.col(f"`{c}`") for c in df.columns], "p")


def save(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load(spark: SparkSession, path: str) -> PipelineModel:
    return PipelineModel.load(path)


def fit_logistic(train: DataFrame, inverse_penalty: float = 1.0, iterations: int = 1000,
                 leave_out: Sequence[str] = ()) -> FittedModel:
    """Balanced logistic regression on standardised numbers and one-hot categories."""
    numeric, categorical = feature_groups(train, leave_out)
    weighted = durable(with_class_weights(with_label(train)))
    indexed = [f"_i_{c}" for c in categorical]
    hot = [f"_h_{c}" for c in categorical]
    rows = weighted.count()
    imputer = MedianImputer(columns=numeric, indicate=False).fit(weighted)
    numeric = [c for c in imputer.output_columns() if c in numeric]  # without those that are all NULL
    stages = [imputer]
    if numeric:
        stages.append(Standardiser(columns=numeric))
    if categorical:
        stages += [
            RareCategoryGrouper(columns=categorical),
            StringIndexer(inputCols=categorical, outputCols=indexed, stringOrderType="alphabetAsc", handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=hot, dropLast=True),  # drops only the unseen slot
        ]
    stages += [
        VectorAssembler(inputCols=[*numeric, *hot], outputCol="features"),
        LogisticRegression(labelCol="_label", weightCol="_weight", regParam=1.0 / (inverse_penalty * rows),
                           elasticNetParam=0.0, standardization=False, maxIter=iterations),
    ]
    pipeline = Pipeline(stages=stages).fit(weighted)
    names = [f"numeric__{c}" for c in numeric]
    if categorical:
        indexer = next(stage for stage in pipeline.stages if isinstance(stage, StringIndexerModel))
        names += [f"categorical__{c}_{level}" for c, levels in zip(categorical, indexer.labelsArray) for level in levels]
    return FittedModel(pipeline, names)


def _fit_trees(fitting: DataFrame, training: DataFrame, numeric: list[str], categorical: list[str],
               fit: Callable[[DataFrame, int], Model]) -> FittedModel:
    """Imputers and indexers learn from ``training``; ``fit(rows, bins)`` sees ``fitting``, which may
    add flagged validation rows. Every stage ends up in one pipeline."""
    imputer = MedianImputer(columns=numeric).fit(training)
    flagged = prep.columns_with_nulls(training, categorical) if categorical else []
    inputs = imputer.output_columns()
    names = [c if "__missingindicator_" in c else f"numeric__{c}" for c in inputs]
    stages, bins = [imputer], 32
    if categorical:
        fill = CategoryFill(columns=categorical, flagged=flagged)
        indexed = [f"_i_{c}" for c in categorical]
        indexer = StringIndexer(inputCols=categorical, outputCols=indexed, stringOrderType="alphabetAsc",
                                handleInvalid="keep").fit(fill.transform(training))
        indicators = [prep.indicator_name(c, "categorical") for c in flagged]
        inputs = [*inputs, *indexed, *indicators]
        names += [f"categorical__{c}" for c in categorical] + indicators
        stages += [fill, indexer]
        widest = max(len(labels) for labels in indexer.labelsArray)
        bins = max(bins, widest + 1)
    stages.append(VectorAssembler(inputCols=inputs, outputCol="features"))
    prepared = durable(PipelineModel(stages).transform(fitting).select(
        ID, "features", "_label", *[c for c in ("_weight", "_holdout") if c in fitting.columns]))
    return FittedModel(PipelineModel([*stages, fit(prepared, bins)]), names)


@frees_scratch
def fit_forest(train: DataFrame, trees: int = FOREST_TREES, depth: int = FOREST_DEPTH,
               leave_out: Sequence[str] = ()) -> FittedModel:
    """Random forest with balanced classes and square-root feature subsets (see ``forest``)."""
    numeric, categorical = feature_groups(train, leave_out)
    labelled = durable(with_label(train))
    return _fit_trees(labelled, labelled, numeric, categorical,
                      lambda rows, bins: grow_forest(rows, trees, depth, FOREST_MIN_ROWS, bins))


def balanced_bootstrap(rows: DataFrame, tree: int, key: str = ID, label: str = "_label", seed: int = SEED) -> DataFrame:
    """The rows that one tree draws, each as often as it is drawn, weighted so that the drawn classes weigh the same.

    Draws are Poisson numbers with mean one from the hash of (key, seed, tree); they do not depend on partitions.
    ``_weight`` is draws x drawn rows / (classes x drawn rows of the class).
    """
    u = F.pmod(F.xxhash64(F.col(key), F.lit(seed), F.lit(tree)), F.lit(1 << 52)) / float(1 << 52)
    draws = sum((F.when(u >= below, 1).otherwise(0) for below in POISSON), F.lit(0))
    drawn = rows.withColumn("_draws", draws).where("_draws > 0")
    totals = {r[label]: r["n"] for r in drawn.groupBy(label).agg(F.sum("_draws").alias("n")).collect()}
    whole, weight = sum(totals.values()), F.lit(1.0)
    for cls, n in totals.items():
        weight = F.when(F.col(label) == cls, whole / (len(totals) * n)).otherwise(weight)
    return drawn.withColumn("_weight", weight * F.col("_draws")).drop("_draws")


@frees_scratch
def fit_balanced_forest(train: DataFrame, trees: int = FOREST_TREES, depth: int = FOREST_DEPTH,
                        leave_out: Sequence[str] = ()) -> FittedModel:
    """Random forest whose trees each balance the classes of their own bootstrap (see ``balanced_bootstrap``)."""
    numeric, categorical = feature_groups(train, leave_out)
    labelled = durable(with_label(train))
    return _fit_trees(labelled, labelled, numeric, categorical,
                      lambda rows, bins: grow_forest(rows, trees, depth, FOREST_MIN_ROWS, bins, by_tree=True))


@frees_scratch
def fit_boosting(train: DataFrame, settings: Boosting, validation: DataFrame | None = None,
                 holdout: float = 0.15, leave_out: Sequence[str] = ()) -> FittedModel:
    """Gradient-boosted trees with the number of rounds that is best on held-out rows (see ``boosting``).

    The held-out rows are ``validation``, or a hash share of the training rows. ``settings.rounds`` is the
    most that are fitted.
    """
    numeric, categorical = feature_groups(train, leave_out)
    training = durable(with_label(train))
    if validation is None:
        fitting = training.withColumn("_holdout", hash_fraction(F.col(ID), "early-stop") < holdout)
    else:
        fitting = training.withColumn("_holdout", F.lit(False)).unionByName(
            with_label(validation).withColumn("_holdout", F.lit(True)))
    return _fit_trees(fitting, training, numeric, categorical, lambda rows, bins: boost(rows, settings, bins).model)


def gain_importance(model: FittedModel) -> list[tuple[str, float]]:
    """(input name, share of the total gain) per slot of a tree model."""
    weights = model.pipeline.stages[-1].featureImportances
    return [(name, float(weights[i])) for i, name in enumerate(model.inputs)]


def importance_table(spark: SparkSession, model: FittedModel) -> DataFrame:
    return spark.createDataFrame(gain_importance(model), "feature string, gain double").orderBy(F.desc("gain"), "feature")


def part_metrics(scored: DataFrame, name: str) -> DataFrame:
    """Six metrics at 0.5 for each part of a scored table."""
    measured = metrics.classification_metrics(durable(
        scored.select(F.col("part").alias("model"), TARGET, "p")))
    return measured.select(F.lit(name).alias("model"), F.col("model").alias("part"),
                           *[c for c in measured.columns if c not in ("model", "threshold")])
