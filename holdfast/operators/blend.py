"""Weighted blends of member probabilities."""

from __future__ import annotations

import math
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.scalars import probability_sql

# Blend weights.
CATEGORICAL_ENSEMBLE = {"hist": 0.3, "cat_d6": 0.1, "cat_d7": 0.2, "cat_d8": 0.4}
TREE_ONLY_ENSEMBLE = {"cat_d6": 0.1, "cat_d7": 0.2, "cat_d8": 0.4}
ENGINEERED_WEIGHT = 0.65


def normalised(weights: Mapping[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    return {name: w / total for name, w in weights.items()}


def check_weights(weights: Mapping[str, float], available: list[str]) -> None:
    missing = sorted(set(weights) - set(available))
    if missing:
        raise ValueError(f"No probability for members: {missing}")
    if not math.isclose(sum(weights.values()), 1.0, rel_tol=1e-5, abs_tol=1e-8):
        raise ValueError("Blend weights must sum to one.")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Exactly the required columns, in order; raises naming those that are missing."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"Missing required features: {missing}")
    return df.select(*columns)


def weighted_sql(weights: Mapping[str, float]) -> str:
    """Sum of weight times ``p_<member>``."""
    return probability_sql(" + ".join(f"{w!r}D * p_{n}" for n, w in weights.items()))


def add_blend(df: DataFrame, weights: Mapping[str, float], output: str) -> DataFrame:
    check_weights(weights, [c[2:] for c in df.columns if c.startswith("p_")])
    return df.selectExpr("*", f"{weighted_sql(weights)} as {output}")


def add_nested_blend(df: DataFrame, engineered_weight: float = ENGINEERED_WEIGHT,
                     inner: Mapping[str, float] = CATEGORICAL_ENSEMBLE, output: str = "p_final") -> DataFrame:
    """Engineered member against the categorical ensemble."""
    with_inner = add_blend(df, inner, "p_ensemble")
    return add_blend(with_inner, {"engineered": engineered_weight, "ensemble": 1.0 - engineered_weight}, output)


def class_probabilities(p: Column) -> Column:
    """Two-class output (stay, churn)."""
    return F.struct((F.lit(1.0) - p).alias("stay"), p.alias("churn"))


def predict(p: Column, threshold: float = 0.5) -> Column:
    """1 when the probability reaches the threshold (inclusive)."""
    return (p >= F.lit(threshold)).cast("int")


def long_scores(df: DataFrame, members: list[str], keep: list[str]) -> DataFrame:
    """(kept columns, model, p): one row per customer and member."""
    return df.unpivot(keep, [f"p_{m}" for m in members], "model", "p").withColumn(
        "model", F.expr("substring(model, 3)"))
