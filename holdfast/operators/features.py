"""The derived ratio and difference features: one narrow projection, no shuffle."""

from __future__ import annotations

from pyspark import keyword_only
from pyspark.ml import Transformer
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.functions.scalars import clean_numeric, ratio_sql
from holdfast.schema import DERIVED_FEATURES, Derived


def derived_sql(feature: Derived) -> str:
    if feature.kind == "ratio":
        return ratio_sql(feature.left, feature.right, feature.times, feature.over)
    return f"cast({feature.left} as double) - cast({feature.right} as double)"


def add_features(df: DataFrame, features: tuple[Derived, ...] = DERIVED_FEATURES) -> DataFrame:
    """Append the derived columns and turn NaN and infinities into NULL in every numeric column."""
    return clean_numeric(df.selectExpr("*", *[f"{derived_sql(f)} as {f.name}" for f in features]))


def feature_stats(df: DataFrame, names: list[str]) -> DataFrame:
    """Known rows, NULLs and mean per derived feature, in one aggregation."""
    row = df.agg(F.expr("count(1) as _n"), *[F.expr(f"count({c}) as n_{c}") for c in names],
                 *[F.expr(f"avg({c}) as m_{c}") for c in names])
    cells = ", ".join(f"'{c}', n_{c}, _n - n_{c}, m_{c}" for c in names)
    return row.selectExpr(f"stack({len(names)}, {cells}) as (feature, known, missing, mean)")


class FeatureEngineer(Transformer, DefaultParamsReadable, DefaultParamsWritable):
    """Pipeline stage form of :func:`add_features`; it has nothing to fit."""

    @keyword_only
    def __init__(self):
        super().__init__()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return add_features(dataset)
