"""Training jobs: baseline selection, the categorical ensemble, and the final blend."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import partial, reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators import metrics, models, prep
from holdfast.operators.features import add_features
from holdfast.operators.models import BOOSTING, Boosting, FittedModel
from holdfast.schema import TARGET
from holdfast.session import durable


def part(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.col("part") == name)


def fit_baselines(df: DataFrame, presets: Mapping[str, Boosting] = BOOSTING, trees: int = models.FOREST_TREES,
                  forest_depth: int = models.FOREST_DEPTH, iterations: int = 1000) -> dict[str, FittedModel]:
    train = part(df, "train")
    return fit_side_by_side({
        "logistic_regression": partial(models.fit_logistic, train, iterations=iterations),
        "random_forest": partial(models.fit_forest, train, trees, forest_depth),
        "gradient_boosting": partial(models.fit_boosting, train, presets["gbt_base"]),
    })


def select_model(df: DataFrame, fitted: Mapping[str, FittedModel]) -> tuple[str, float, DataFrame, DataFrame]:
    """Best validation ROC-AUC wins; its F1 threshold comes from validation; test is scored once.

    Returns (name, threshold, validation table, test metrics at 0.5 and at the threshold).
    """
    valid = part(df, "validation")
    scored = reduce(DataFrame.unionByName, [
        m.score(valid).select(F.lit(name).alias("model"), TARGET, "p") for name, m in fitted.items()])
    scored = durable(scored)
    table = durable(metrics.compare_models(scored))
    best = table.orderBy(F.desc("roc_auc"), "model").first()["model"]
    threshold = metrics.best_f1_threshold(scored.filter(F.col("model") == best)).first()["threshold"]
    test = fitted[best].score(part(df, "test")).select(F.lit(best).alias("model"), TARGET, "p")
    return best, threshold, table, metrics.classification_metrics(durable(test), sorted({0.5, threshold}))


def fit_side_by_side(fits: Mapping[str, Callable[[], FittedModel]], at_once: int = 4) -> dict[str, FittedModel]:
    """Fits that do not need each other, ``at_once`` at a time: a round of one fills the waits of another."""
    inherits = inheritable_thread_target(SparkSession.getActiveSession())
    with ThreadPool(min(at_once, len(fits))) as pool:
        running = {name: pool.apply_async(inherits(fit)) for name, fit in fits.items()}
        return {name: result.get() for name, result in running.items()}


def encode_categories(df: DataFrame) -> DataFrame:
    """Replace text predictors by their ordered target statistic."""
    _, categorical = models.feature_groups(df)
    return durable(prep.encode_ordered(df, categorical).drop(*categorical))


def fit_categorical(encoded: DataFrame, name: str, presets: Mapping[str, Boosting] = BOOSTING) -> FittedModel:
    """Boosting on target-encoded categories, stopped on the validation part."""
    return models.fit_boosting(part(encoded, "train"), presets[name], part(encoded, "validation"))


def fit_engineered(df: DataFrame, presets: Mapping[str, Boosting] = BOOSTING) -> FittedModel:
    """Boosting on raw and derived features with missing indicators."""
    wide = add_features(df)
    return models.fit_boosting(part(wide, "train"), presets["gbt_engineered"], part(wide, "validation"))
