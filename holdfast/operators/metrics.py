"""Exact binary-classification metrics over a long score table ``(model, churn, p)``.

Rows are first grouped by (model, score); curves are running sums over those groups and threshold
sweeps are one grouping into the threshold grid. Nothing collects or re-reads rows per threshold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.scalars import safe_div
from holdfast.operators.ordered import running_sums
from holdfast.schema import TARGET
from holdfast.session import durable

# 181 evenly spaced thresholds from 0.05 to 0.95; the last one is exactly 0.95.
GRID_POINTS = 181
GRID_STEP = (0.95 - 0.05) / (GRID_POINTS - 1)
GRID = [i * GRID_STEP + 0.05 for i in range(GRID_POINTS - 1)] + [0.95]


def score_groups(scores: DataFrame, target: str = TARGET) -> DataFrame:
    """One row per (model, distinct score): positives and negatives."""
    return scores.groupBy("model", "p").agg(
        F.sum(F.col(target).cast("long")).alias("tp"), F.sum(1 - F.col(target).cast("long")).alias("fp"))


def cumulative(scores: DataFrame, target: str = TARGET) -> DataFrame:
    """Score groups with the positives and negatives at or above each score, and class totals."""
    groups = durable(score_groups(scores, target))
    totals = durable(groups.groupBy("model").agg(F.sum("tp").alias("pos"), F.sum("fp").alias("neg")))
    running = running_sums(groups, [F.desc("p")], {"ctp": "tp", "cfp": "fp"}, group=["model"])
    return running.join(totals, "model")


def ranking_metrics(scores: DataFrame, target: str = TARGET) -> DataFrame:
    """ROC-AUC (ties count half), the same area by trapezoids, and average precision, per model."""
    c = cumulative(scores, target)
    pairs = F.col("fp") * (F.col("ctp") - F.col("tp") * 0.5)
    neg, pos = F.nullif(F.col("neg"), F.lit(0)), F.nullif(F.col("pos"), F.lit(0))
    trapezoid = (F.col("fp") / neg) * ((F.col("ctp") * 2 - F.col("tp")) / pos) * 0.5
    step = F.col("tp") * (F.col("ctp") / (F.col("ctp") + F.col("cfp")))
    # Of one class only: the model keeps its row, and what is not defined is NULL.
    return c.groupBy("model").agg(
        F.max("pos").alias("positives"), F.max("neg").alias("negatives"),
        F.try_divide(F.sum(pairs), F.max("pos") * F.max("neg")).alias("roc_auc"),
        F.sum(trapezoid).alias("curve_area"),
        F.try_divide(F.sum(step), F.max("pos")).alias("average_precision"),
    )


def roc_curve(scores: DataFrame, target: str = TARGET) -> DataFrame:
    """(model, threshold, fpr, tpr) at every distinct score, plus the origin (NULL threshold)."""
    c = cumulative(scores, target)
    points = c.select("model", F.col("p").alias("threshold"),
                      F.try_divide("cfp", "neg").alias("fpr"), F.try_divide("ctp", "pos").alias("tpr"))
    origin = c.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(origin)


def _rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    return {
        "accuracy": safe_div(tp + tn, tp + fp + fn + tn),
        "precision": safe_div(tp, tp + fp),
        "recall": safe_div(tp, tp + fn),
        "f1": safe_div(2 * tp, 2 * tp + fp + fn),
    }


def threshold_metrics(scores: DataFrame, thresholds: list[float], target: str = TARGET) -> DataFrame:
    """Counts and rates at each threshold (reached means predicted positive), in one pass."""
    y, p = F.col(target), F.col("p")
    aggs = [F.count_if(y == 1).alias("pos"), F.count_if(y == 0).alias("neg")]
    for i, t in enumerate(thresholds):
        aggs += [F.count_if((y == 1) & (p >= t)).alias(f"tp{i}"), F.count_if((y == 0) & (p >= t)).alias(f"fp{i}")]
    wide = scores.groupBy("model").agg(*aggs)
    cells = wide.select("model", "pos", "neg", F.inline(F.array(*[
        F.struct(F.lit(t).alias("threshold"), F.col(f"tp{i}").alias("tp"), F.col(f"fp{i}").alias("fp"))
        for i, t in enumerate(thresholds)
    ])))
    tp, fp = F.col("tp"), F.col("fp")
    fn, tn = F.col("pos") - tp, F.col("neg") - fp
    return cells.select("model", "threshold", "tp", "fp", fn.alias("fn"), tn.alias("tn"),
                        *[v.alias(k) for k, v in _rates(tp, fp, fn, tn).items()])


def classification_metrics(scores: DataFrame, thresholds: list[float] | float = 0.5,
                           target: str = TARGET) -> DataFrame:
    """The six metrics per model and threshold."""
    wanted = thresholds if isinstance(thresholds, list) else [thresholds]
    ranking = ranking_metrics(scores, target).select("model", "roc_auc", F.col("average_precision").alias("pr_auc"))
    return threshold_metrics(scores, wanted, target).join(ranking, "model", "left").select(
        "model", "threshold", "roc_auc", "pr_auc", "accuracy", "precision", "recall", "f1")


def confusion_matrix(scores: DataFrame, threshold: float = 0.5, target: str = TARGET) -> DataFrame:
    """Customers per (actual, predicted); all four cells are present."""
    m = threshold_metrics(scores, [threshold], target)
    return m.selectExpr("model", "stack(4, 0, 0, tn, 0, 1, fp, 1, 0, fn, 1, 1, tp) as (actual, predicted, customers)")


def grid_threshold(index: Column) -> Column:
    """The grid's double at ``index``; NULL outside the grid."""
    return F.get(F.array(*map(F.lit, GRID)), index)


def grid_index(p: Column) -> Column:
    """How many grid thresholds are not above ``p``; the guess is corrected against the grid itself."""
    guess = F.least(F.greatest(F.floor((p - F.lit(GRID[0])) / F.lit(GRID_STEP)), F.lit(-1)), F.lit(GRID_POINTS - 1)).cast("int")
    up = F.when(grid_threshold(guess + 1) <= p, 1).otherwise(0)
    down = F.when(grid_threshold(guess) > p, 1).otherwise(0)
    return guess + up - down + 1


def threshold_sweep(scores: DataFrame, target: str = TARGET) -> DataFrame:
    """Counts at every grid threshold: one grouping into at most 182 buckets, then suffix sums."""
    buckets = scores.groupBy("model", grid_index(F.col("p")).alias("bucket")).agg(
        F.sum(F.col(target).cast("long")).alias("b_tp"), F.count(F.lit(1)).alias("b_n"))
    grid = buckets.select("model").distinct().select(
        "model", F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS))).alias("bucket"))
    dense = grid.join(buckets, ["model", "bucket"], "left").na.fill(0, ["b_tp", "b_n"])
    above = Window.partitionBy("model").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.partitionBy("model")  # 182 rows per model
    counts = dense.select(
        "model", "bucket",
        F.sum("b_tp").over(above).alias("tp"), F.sum("b_n").over(above).alias("flagged"),
        F.sum("b_tp").over(everything).alias("pos"), F.sum("b_n").over(everything).alias("n"),
    ).filter("bucket >= 1")
    tp, fp = F.col("tp"), F.col("flagged") - F.col("tp")
    fn = F.col("pos") - tp
    return counts.select(
        "model", (F.col("bucket") - 1).alias("step"), grid_threshold(F.col("bucket") - 1).alias("threshold"),
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), safe_div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def best_f1_threshold(scores: DataFrame, target: str = TARGET) -> DataFrame:
    """Grid threshold with the highest F1 per model, the lowest one on ties."""
    best = threshold_sweep(scores, target).groupBy("model").agg(
        F.max_by(F.struct("threshold", "f1", "tp", "fp", "fn"), F.struct(F.col("f1"), -F.col("step"))).alias("b"))
    return best.select("model", "b.*")


def cheapest_threshold(scores: DataFrame, cost_fp: float = 15.0, cost_fn: float = 60.0,
                       target: str = TARGET) -> DataFrame:
    """Grid threshold with the lowest total error cost per model, the lowest one on ties."""
    cost = F.col("fp") * F.lit(cost_fp) + F.col("fn") * F.lit(cost_fn)
    best = threshold_sweep(scores, target).withColumn("cost", cost).groupBy("model").agg(
        F.min_by(F.struct("threshold", "cost", "fp", "fn"), F.struct("cost", "step")).alias("b"))
    return best.select("model", "b.*")


def compare_models(scores: DataFrame, threshold: float = 0.5, target: str = TARGET) -> DataFrame:
    """Six metrics per model, best ROC-AUC first (name decides ties)."""
    return classification_metrics(scores, threshold, target).drop("threshold").orderBy(F.desc("roc_auc"), "model")
