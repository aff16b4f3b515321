"""Reference state of a deployed model: frozen bins and counts that later weeks only add to.

The state is two small tables, kept with the model. A week is counted once against the frozen bins; counts of
weeks, regions or partial loads add up, and drift and calibration are read off the sums.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.operators.quantiles import exact_quantiles
from holdfast.schema import TARGET

_LEAST_SHARE = 1e-6


def freeze_bins(expected: DataFrame, features: Sequence[str], bins: int = 10) -> DataFrame:
    """(``feature``, ``edges``): inner edges of quantile bins; ``expected`` is a written table."""
    edges = exact_quantiles(expected, features, [i / bins for i in range(1, bins)])
    rows = [(c, [e for e in edges[c] if e is not None]) for c in features]
    return expected.sparkSession.createDataFrame(rows, "feature string, edges array<double>")


def count_bins(df: DataFrame, frozen: DataFrame) -> DataFrame:
    """(``feature``, ``bin``, ``n``) in one reading of ``df``; NULLs are bin -1."""
    cells = []
    for row in frozen.collect():  # one row for each feature
        x = F.col(f"`{row['feature']}`")
        slot = reduce(lambda a, e: a + F.when(x > F.lit(e), 1).otherwise(0), row["edges"], F.lit(0))
        cells.append(F.struct(F.lit(row["feature"]).alias("feature"), F.when(x.isNull(), -1).otherwise(slot).alias("bin")))
    return df.select(F.inline(F.array(*cells))).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def add_counts(first: DataFrame, *more: DataFrame) -> DataFrame:
    """Counts of several weeks or loads as one; every column that is not a bin's name is summed."""
    names = [c for c in first.columns if c in ("feature", "bin")]
    sums = [F.sum(c).alias(c) for c in first.columns if c not in names]
    return reduce(DataFrame.unionByName, more, first).groupBy(*names).agg(*sums)


def drift(reference: DataFrame, week: DataFrame) -> DataFrame:
    """Population stability index per feature from two tables of counts; an empty bin is a share of one millionth."""
    def shares(counts: DataFrame, name: str) -> DataFrame:
        totals = counts.groupBy("feature").agg(F.sum("n").alias("total"))
        return counts.join(totals, "feature").select("feature", "bin", (F.col("n") / F.col("total")).alias(name))

    both = shares(reference, "e").join(shares(week, "a"), ["feature", "bin"], "full_outer")
    e, a = (F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(_LEAST_SHARE)) for c in ("e", "a"))
    return both.groupBy("feature").agg(F.sum((a - e) * F.log(a / e)).alias("psi"))


def count_scores(scored: DataFrame, bins: int = 10, target: str = TARGET) -> DataFrame:
    """Per equal-width score bin: rows, sum of scores, churners, sum of squared errors."""
    slot = F.least(F.floor(F.col("p") * bins) + 1, F.lit(bins)).cast("int")
    return scored.groupBy(slot.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("sum_p"), F.sum(F.col(target).cast("long")).alias("churners"),
        F.sum(F.pow(F.col("p") - F.col(target), F.lit(2.0))).alias("squares"))


def calibration(counts: DataFrame) -> DataFrame:
    """Mean score against observed rate per bin."""
    return counts.select("bin", F.col("n").alias("customers"), (F.col("sum_p") / F.col("n")).alias("mean_p"),
                         (F.col("churners") / F.col("n")).alias("observed_rate"))


def calibration_error(counts: DataFrame) -> DataFrame:
    """Brier score and expected calibration error of all bins."""
    gap = F.abs(F.col("sum_p") - F.col("churners"))
    return counts.agg(F.sum("n").alias("customers"), (F.sum("squares") / F.sum("n")).alias("brier"),
                      (F.sum(gap) / F.sum("n")).alias("calibration_error"))


def save_state(folder: str, **tables: DataFrame) -> None:
    for name, df in tables.items():
        df.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


def load_state(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    return [spark.read.parquet(f"{folder}/{name}") for name in names]
