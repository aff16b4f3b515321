"""Descriptive profiles of a customer table; each is one or two aggregations over all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.functions import array_to_vector
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.scalars import long_cells, numeric_columns, text_columns
from holdfast.operators.quantiles import exact_quantiles
from holdfast.schema import TARGET
from holdfast.session import durable

QUARTILE_FEATURES = ("eqpdays", "change_mou", "mou_Mean")
QUARTILES = ("Q1", "Q2", "Q3", "Q4")


def preview(df: DataFrame, rows: int = 5) -> tuple[DataFrame, tuple[int, int]]:
    """First rows and the (rows, columns) shape."""
    return df.limit(rows), (df.count(), len(df.columns))


def table_profile(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(len(numeric_columns(df))).alias("n_numeric"),
        F.lit(len(text_columns(df))).alias("n_text"),
    )


def missing_counts(df: DataFrame, top: int | None = 20) -> DataFrame:
    """NULLs per column, worst first: one aggregation over all columns, then one row per column."""
    nulls = df.agg(F.expr("count(1) as _rows"), *[F.expr(f"count_if(`{c}` is null) as `{c}`") for c in df.columns])
    cells = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    out = nulls.selectExpr("_rows", f"stack({len(df.columns)}, {cells}) as (column_name, missing)").selectExpr(
        "column_name", "missing", "missing * 100D / nullif(_rows, 0) as missing_pct",
    ).orderBy(F.desc("missing"), "column_name")
    return out if top is None else out.limit(top)


def target_balance(df: DataFrame, target: str = TARGET) -> DataFrame:
    """Customers and share per class (NULL labels excluded), with the overall rate."""
    counts = df.filter(F.col(target).isNotNull()).groupBy(target).agg(F.count(F.lit(1)).alias("customers"))
    totals = counts.agg(F.sum("customers").alias("n"), F.sum(F.col(target) * F.col("customers")).alias("p"))
    total = totals.select(F.struct("n", "p")).scalar()
    return counts.select(
        target, "customers",
        (F.col("customers") / total["n"]).alias("proportion"),
        (total["p"] / total["n"]).alias("overall_rate"),
    )


def class_means(df: DataFrame, features: Sequence[str], target: str = TARGET) -> DataFrame:
    return df.filter(F.col(target).isNotNull()).groupBy(target).agg(
        *[F.avg(c).alias(f"mean_{c}") for c in features])


def bin_by_cuts(value: Column, cuts: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins: the first label whose upper cut is not below the value."""
    expr = None
    for cut, label in zip(cuts, labels):
        expr = F.when(value <= F.lit(cut), label) if expr is None else expr.when(value <= F.lit(cut), label)
    return F.lit(labels[-1]) if expr is None else expr.otherwise(labels[-1])


def quartile_churn(df: DataFrame, features: Sequence[str] = QUARTILE_FEATURES,
                   target: str = TARGET) -> DataFrame:
    """Churn rate per quartile of each feature. Tied cut points give fewer groups."""
    slim = df.select(target, *features)
    cuts = exact_quantiles(slim.filter(F.col(target).isNotNull()), features, (0.25, 0.5, 0.75))
    cells = F.array(*[
        F.struct(F.lit(c).alias("feature"),
                 F.when(F.col(c).isNotNull(), bin_by_cuts(F.col(c), cuts[c], QUARTILES)).alias("quartile"))
        for c in features if cuts[c][0] is not None
    ])
    return (
        slim.filter(F.col(target).isNotNull())
        .select(target, F.inline(cells)).filter("quartile is not null")
        .groupBy("feature", "quartile")
        .agg(F.count(F.lit(1)).alias("customers"), (F.avg(target) * 100.0).alias("churn_rate_pct"))
    )


def class_histogram(df: DataFrame, feature: str = "eqpdays", bins: int = 30,
                    target: str = TARGET) -> DataFrame:
    """Equal-width histogram per class, each over its own range; empty bins are kept.

    ``df`` is read twice, so pass a written table.
    """
    rows = df.select(target, F.col(feature).alias("x")).dropna()
    spans = rows.groupBy(target).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    flat = F.col("lo") == F.col("hi")
    spans = durable(spans.select(
        target,
        F.when(flat, F.col("lo") - 0.5).otherwise(F.col("lo")).alias("lo"),
        F.when(flat, F.col("hi") + 0.5).otherwise(F.col("hi")).alias("hi"),
    ))
    slot = F.floor((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo")) * F.lit(float(bins))) + 1
    counts = (
        rows.join(spans, target)
        .groupBy(target, F.least(slot, F.lit(bins)).cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    width = (F.col("hi") - F.col("lo")) / F.lit(float(bins))
    grid = spans.select(target, "lo", "hi", F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"))
    return grid.join(counts, [target, "bin"], "left").select(
        target, "bin",
        (F.col("lo") + (F.col("bin") - 1) * width).alias("lower"),
        (F.col("lo") + F.col("bin") * width).alias("upper"),
        F.coalesce("n", F.lit(0)).alias("customers"),
    )


def class_density(sample: DataFrame, columns: Sequence[str], label: str, points: int = 200,
                  reach: float = 3.0) -> DataFrame:
    """Gaussian kernel density per class on an even grid, scaled by the class's share.

    Bandwidth is n^(-1/5) times the sample deviation. ``sample`` is the bounded pair sample, and
    equal values are merged first, so the work is (distinct values) x (grid points).
    """
    cells = long_cells(sample, [label], columns, "feature", "value").filter("value is not null")
    values = cells.groupBy(label, "feature", "value").agg(F.count(F.lit(1)).alias("w"))
    stats = cells.groupBy(label, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.stddev_samp("value").alias("sd"),
    ).filter("n > 1 and sd > 0")
    totals = stats.groupBy("feature").agg(F.sum("n").alias("total"))
    shape = stats.join(totals, "feature").withColumn("bw", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    start, stop = F.col("lo") - F.col("bw") * reach, F.col("hi") + F.col("bw") * reach
    grid = shape.select(
        label, "feature", "n", "total", "bw",
        F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"),
        start.alias("start"), stop.alias("stop"),
    ).withColumn("x", F.col("start") + (F.col("stop") - F.col("start")) * F.col("point") / F.lit(points - 1.0))
    z = (F.col("x") - F.col("value")) / F.col("bw")
    return (
        values.join(grid, [label, "feature"])
        .groupBy("feature", label, "point")
        .agg(F.first("x").alias("x"),
             (F.sum(F.col("w") * F.exp(z * z * F.lit(-0.5)))
              / (F.first("bw") * F.lit(2.5066282746310002) * F.first("total"))).alias("density"))
    )


def binned_density(df: DataFrame, columns: Sequence[str], label: str = TARGET, points: int = 200, bins: int = 1024,
                   reach: float = 3.0) -> DataFrame:
    """:func:`class_density` of a whole table: every value is shared out between two of ``bins`` even nodes, and the
    kernel is summed over nodes, so the work after one grouping is bins x points at any size.

    Sharing a value between its neighbours moves the kernel by at most (node distance / bandwidth)^2 / 8 of its
    peak, so each density differs from the exact sum by at most that times n / (bandwidth * 2.5066 * total).
    """
    cells = long_cells(df.filter(F.col(label).isNotNull()), [label], columns, "feature", "value").filter("value is not null")
    stats = cells.groupBy(label, "feature").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.stddev_samp("value").alias("sd")).filter("n > 1 and sd > 0")
    totals = stats.groupBy("feature").agg(F.sum("n").alias("total"))
    bw = F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    shape = durable(stats.join(totals, "feature").select(
        label, "feature", "total", bw.alias("bw"), (F.col("lo") - bw * reach).alias("start"), (F.col("hi") + bw * reach).alias("stop")))
    place = (F.col("value") - F.col("start")) / ((F.col("stop") - F.col("start")) / F.lit(bins - 1.0))
    node = F.floor(place)
    shared = cells.join(shape, [label, "feature"]).select(label, "feature", F.inline(F.array(
        F.struct(node.alias("node"), (1 - (place - node)).alias("w")), F.struct((node + 1).alias("node"), (place - node).alias("w")))))
    nodes = shared.groupBy(label, "feature", "node").agg(F.sum("w").alias("w"))
    step = (F.col("stop") - F.col("start")) / F.lit(bins - 1.0)
    grid = shape.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", F.col("start") + (F.col("stop") - F.col("start")) * F.col("point") / F.lit(points - 1.0))
    z = (F.col("x") - (F.col("start") + F.col("node") * step)) / F.col("bw")
    return nodes.join(grid, [label, "feature"]).groupBy("feature", label, "point").agg(
        F.first("x").alias("x"), (F.sum(F.col("w") * F.exp(z * z * F.lit(-0.5)))
                                  / (F.first("bw") * F.lit(2.5066282746310002) * F.first("total"))).alias("density"))


def correlated_pairs(df: DataFrame, columns: Sequence[str], least: float = 0.95) -> DataFrame:
    """All pairs of columns whose absolute correlation over the rows that have both is at least ``least``.

    Every pair's count, sums and products are entries of one cross-product matrix of (value, present, square),
    summed in one pass; values are standardised before, so that squares do not cancel. The matrix has three rows
    for each column, whatever the number of rows of ``df``, which is a written table.
    """
    moments = df.agg(*[F.avg(F.col(f"`{c}`")).alias(f"m{i}") for i, c in enumerate(columns)],
                     *[F.stddev_pop(F.col(f"`{c}`")).alias(f"s{i}") for i, c in enumerate(columns)]).first()
    used = [(c, moments[f"m{i}"], moments[f"s{i}"]) for i, c in enumerate(columns) if moments[f"s{i}"]]
    result = "feature_a string, feature_b string, customers long, correlation double"
    if len(used) < 2:
        return df.sparkSession.createDataFrame([], result)
    values = [(F.col(f"`{c}`").cast("double") - F.lit(m)) / F.lit(s) for c, m, s in used]
    entries = [*[F.coalesce(v, F.lit(0.0)) for v in values], *[v.isNotNull().cast("double") for v in values],
               *[F.coalesce(v * v, F.lit(0.0)) for v in values]]
    rows = MLUtils.convertVectorColumnsFromML(df.select(array_to_vector(F.array(*entries)).alias("v")), "v")
    d = len(used)
    products = RowMatrix(rows).computeGramianMatrix().toArray()
    both, sums, squares, cross = products[d:2 * d, d:2 * d], products[:d, d:2 * d], products[2 * d:, d:2 * d], products[:d, :d]
    found = []
    for i, j in combinations(range(d), 2):
        n = both[i, j]
        spread = (n * squares[i, j] - sums[i, j] ** 2) * (n * squares[j, i] - sums[j, i] ** 2)
        if spread > 0:
            r = (n * cross[i, j] - sums[i, j] * sums[j, i]) / math.sqrt(spread)
            if abs(r) >= least:
                found.append((*sorted((used[i][0], used[j][0])), int(round(n)), float(r)))
    return df.sparkSession.createDataFrame(found, result)


def segment_cube(df: DataFrame, first: str, second: str, target: str = TARGET) -> DataFrame:
    """Customers, churners and churn rate for every pair of levels, with the subtotals of both and the total.

    ``<column>_total`` is 1 where a row sums over that column, 0 where NULL is a level of it.
    """
    return df.filter(F.col(target).isNotNull()).cube(first, second).agg(
        F.grouping(first).cast("int").alias(f"{first}_total"), F.grouping(second).cast("int").alias(f"{second}_total"),
        F.count(F.lit(1)).alias("customers"), F.sum(F.col(target).cast("long")).alias("churners"), F.avg(target).alias("churn_rate"))


def feature_correlation(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Pearson correlation of every pair of the listed features, in one aggregation."""
    pairs = list(combinations(features, 2))
    row = df.agg(*[F.corr(F.col(a), F.col(b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("correlation"))
        for i, (a, b) in enumerate(pairs)
    ])))


def segment_rates(df: DataFrame, segments: Sequence[str], target: str = TARGET) -> DataFrame:
    """Customers, churners and churn rate per level of each segment column."""
    return (
        long_cells(df.filter(F.col(target).isNotNull()), [target], segments, "segment", "level")
        .groupBy("segment", "level")
        .agg(F.count(F.lit(1)).alias("customers"), F.sum(target).alias("churners"), F.avg(target).alias("churn_rate"))
    )


def outlier_counts(df: DataFrame, features: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Values outside the interquartile fences of each feature."""
    cuts = exact_quantiles(df, features, (0.25, 0.75))
    known = [c for c in features if cuts[c][0] is not None]
    fences = {c: (cuts[c][0] - reach * (cuts[c][1] - cuts[c][0]), cuts[c][1] + reach * (cuts[c][1] - cuts[c][0]))
              for c in known}
    row = df.agg(*[F.count_if(F.col(c) < F.lit(fences[c][0])).alias(f"lo_{c}") for c in known],
                 *[F.count_if(F.col(c) > F.lit(fences[c][1])).alias(f"hi_{c}") for c in known])
    return row.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(fences[c][0]).alias("low_fence"),
                 F.lit(fences[c][1]).alias("high_fence"),
                 F.col(f"lo_{c}").alias("below"), F.col(f"hi_{c}").alias("above"))
        for c in known
    ])))
