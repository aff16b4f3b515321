"""Preparation steps fitted on the training part and applied to any rows.

Numeric statistics are a handful of numbers per column. Category tables stay DataFrames: they are
joined, and broadcast only when their row count proves them small.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.functions.scalars import MISSING, fill_category, hash_key, long_cells
from holdfast.operators.ordered import running_sums
from holdfast.operators.quantiles import exact_quantiles
from holdfast.schema import ID, TARGET
from holdfast.session import durable

INFREQUENT = "__INFREQUENT__"
LABEL_MISSING = "nan"


# --- numeric ---------------------------------------------------------------------------------

def fit_medians(train: DataFrame, columns: Sequence[str]) -> dict[str, float]:
    """Exact median per column; a column without any value has none and is left as it is."""
    cuts = exact_quantiles(train, columns, (0.5,))
    return {c: q[0] for c, q in cuts.items() if q[0] is not None}


def impute(df: DataFrame, values: Mapping[str, float | str]) -> DataFrame:
    """Replace NULLs by the fitted value of each column."""
    return df.withColumns({
        c: F.expr(f"coalesce(`{c}`, {v!r}D)") if isinstance(v, float) else F.coalesce(F.col(c), F.lit(v))
        for c, v in values.items()})


def columns_with_nulls(train: DataFrame, columns: Sequence[str]) -> list[str]:
    row = train.agg(*[F.expr(f"count_if(`{c}` is null) as `{c}`") for c in columns]).first()
    return [c for c in columns if row[c] > 0]


def indicator_name(column: str, group: str) -> str:
    return f"{group}__missingindicator_{column}"


def add_indicators(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """0/1 column per listed column (those that had NULLs in training)."""
    return df.withColumns({indicator_name(c, group): F.expr(f"cast(`{c}` is null as double)") for c in columns})


def fit_scales(train: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation; a constant column is scaled by 1."""
    row = train.agg(*[F.expr(f"avg(`{c}`) as `m_{c}`") for c in columns],
                    *[F.expr(f"stddev_pop(`{c}`) as `s_{c}`") for c in columns]).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"] or 1.0) for c in columns if row[f"m_{c}"] is not None}


def standardise(df: DataFrame, scales: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in scales.items()})


# --- categories ------------------------------------------------------------------------------

def category_counts(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, n) for the non-NULL categories of every column, in one grouping."""
    return (
        long_cells(train.select(*columns).withColumn("_k", F.lit(1)), ["_k"], columns)
        .filter("value is not null").groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))
    )


def fit_modes(train: DataFrame, columns: Sequence[str]) -> dict[str, str]:
    """Most frequent category per column, the lowest one on ties."""
    best = category_counts(train, columns).groupBy("feature").agg(
        F.min(F.struct(-F.col("n"), F.col("value"))).alias("best"))
    return {r.feature: r.best.value for r in best.collect()}  # one row per column


def fill_categories(df: DataFrame, columns: Sequence[str], marker: str = MISSING) -> DataFrame:
    return df.withColumns({c: fill_category(F.col(c), marker) for c in columns})


def fit_codes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature, value, code): categories numbered 0, 1, ... in sorted order within each column."""
    distinct = category_counts(train, columns).select("feature", "value", F.lit(1).cast("long").alias("one"))
    ranked = running_sums(distinct, [F.col("value")], {"place": "one"}, group=["feature"])
    return ranked.select("feature", "value", (F.col("place") - 1).cast("int").alias("code"))


def _by_feature(table: DataFrame, columns: Sequence[str], value: str) -> dict[str, DataFrame]:
    """Split a (feature, value, ...) table into one lookup per column, keyed by ``_v``.

    The table is written; the planner knows its size and chooses how to join it.
    """
    written = durable(table.select("feature", F.col("value").alias("_v"), F.col(value).alias("_new")))
    return {c: written.filter(F.col("feature") == c).drop("feature") for c in columns}


def apply_codes(df: DataFrame, codes: DataFrame, columns: Sequence[str], unknown: int = -1,
                suffix: str = "_code") -> DataFrame:
    """Add ``<column>_code``; categories unseen in training, and NULL, get ``unknown``."""
    for c, lookup in _by_feature(codes, columns, "code").items():
        code = F.coalesce(F.col("_new"), F.lit(unknown))
        df = df.join(lookup, F.col(c) == F.col("_v"), "left").withColumn(f"{c}{suffix}", code).drop("_v", "_new")
    return df


def fit_onehot_slots(train: DataFrame, columns: Sequence[str], min_frequency: int = 10) -> DataFrame:
    """(feature, value, slot): rare categories of a column share one slot."""
    return category_counts(train, columns).select(
        "feature", "value", F.when(F.col("n") < min_frequency, INFREQUENT).otherwise(F.col("value")).alias("slot"))


def apply_slots(df: DataFrame, slots: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Replace each category by its slot; a category unseen in training becomes NULL."""
    for c, lookup in _by_feature(slots, columns, "slot").items():
        df = df.join(lookup, F.col(c) == F.col("_v"), "left").withColumn(c, F.col("_new")).drop("_v", "_new")
    return df


def onehot_counts(df: DataFrame, slots: DataFrame, columns: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """Rows that set each one-hot slot. An unseen category sets none of its column's slots."""
    counts = long_cells(df, keep, columns).groupBy(*keep, "feature", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(slots, ["feature", "value"]).groupBy(*keep, "feature", "slot").agg(
        F.sum("n").alias("customers"))


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Codes over all rows, NULL being a category of its own."""
    filled = fill_categories(df, columns, LABEL_MISSING)
    return apply_codes(filled, fit_codes(filled, columns), columns)


def ordered_target_encode(df: DataFrame, columns: Sequence[str], part: str = "part", key: str = ID,
                          target: str = TARGET, smoothing: float = 1.0, seed: int | str = "ordered") -> DataFrame:
    """Smoothed target mean per category, in long form: (key, part, feature, value, encoded).

    A training row sees only the training rows before it in hash order; other rows see the whole
    training part. The prior is the training rate. A category with very many rows is split over
    tasks by the running sum, not kept in one.
    """
    train = F.col(part) == "train"
    prior = df.filter(train).agg(F.avg(target)).first()[0]
    cells = long_cells(fill_categories(df.select(key, part, target, *columns), columns),
                       [key, part, target], columns)
    totals = cells.filter(train).groupBy("feature", "value").agg(
        F.sum(target).alias("_sy"), F.count(F.lit(1)).alias("_sn"))
    others = cells.filter(~train).join(durable(totals), ["feature", "value"], "left").select(
        key, part, "feature", "value",
        _smoothed(F.coalesce("_sy", F.lit(0)), F.coalesce("_sn", F.lit(0)), prior, smoothing).alias("encoded"))
    return _rows_before(cells.filter(train), prior, [key, part], key, target, smoothing, seed).unionByName(others)


def _smoothed(positives: Column, rows: Column, prior: float, smoothing: float) -> Column:
    return (positives + F.lit(smoothing * prior)) / (rows + F.lit(smoothing))


def _rows_before(cells: DataFrame, prior: float, keep: Sequence[str], key: str, target: str, smoothing: float,
                 seed: int | str) -> DataFrame:
    """Training cells with the smoothed mean of the cells before them: columns ``keep``, feature, value, encoded."""
    seen = cells.select(*keep, "feature", "value", hash_key(F.col(key), seed).alias("_h"),
                        F.col(target).cast("long").alias("_y"), F.lit(1).cast("long").alias("_one"))
    running = running_sums(seen, [F.col("_h"), F.col(key)], {"_sy": "_y", "_sn": "_one"}, group=["feature", "value"])
    before = _smoothed(F.col("_sy") - F.col("_y"), F.col("_sn") - 1, prior, smoothing)
    return running.select(*keep, "feature", "value", before.alias("encoded"))


def encode_ordered(df: DataFrame, columns: Sequence[str], part: str = "part", key: str = ID, target: str = TARGET,
                   smoothing: float = 1.0, seed: int | str = "ordered", suffix: str = "_te") -> DataFrame:
    """Add ``<column>_te``, the values of ``ordered_target_encode``, to every row.

    Only training rows, whose values depend on the rows before them, go through one row per cell and back;
    all others, NULL parts among them, look up the totals of the training part.
    """
    train = F.coalesce(F.col(part) == "train", F.lit(False))
    fitting = df.filter(train)
    lookup, prior = fit_target_lookup(fitting, columns, target, smoothing)
    cells = long_cells(fill_categories(fitting.select(key, target, *columns), columns), [key, target], columns)
    own = encoded_columns(fitting, _rows_before(cells, prior, [key], key, target, smoothing, seed), columns, key, suffix)
    return own.unionByName(apply_target_lookup(df.filter(~train), lookup, prior, columns, suffix))


def fit_target_lookup(train: DataFrame, columns: Sequence[str], target: str = TARGET,
                      smoothing: float = 1.0) -> tuple[DataFrame, float]:
    """(feature, value, encoded) over the whole training part, and the prior for unseen categories."""
    prior = train.agg(F.avg(target)).first()[0]
    totals = long_cells(fill_categories(train.select(target, *columns), columns), [target], columns).groupBy(
        "feature", "value").agg(F.sum(target).alias("s"), F.count(F.lit(1)).alias("n"))
    encoded = _smoothed(F.col("s"), F.col("n"), prior, smoothing)
    return totals.select("feature", "value", encoded.alias("encoded")), prior


def apply_target_lookup(df: DataFrame, lookup: DataFrame, prior: float, columns: Sequence[str],
                        suffix: str = "_te") -> DataFrame:
    """Add ``<column>_te`` for rows outside training, such as new customers without a label."""
    for c, table in _by_feature(lookup, columns, "encoded").items():
        encoded = F.coalesce(F.col("_new"), F.lit(prior))
        df = (df.join(table, fill_category(F.col(c)) == F.col("_v"), "left")
              .withColumn(f"{c}{suffix}", encoded).drop("_v", "_new"))
    return df


def encoded_columns(df: DataFrame, encoded: DataFrame, columns: Sequence[str], key: str = ID,
                    suffix: str = "_te") -> DataFrame:
    """Join the long encoding back as one ``<column>_te`` per category column."""
    wide = encoded.groupBy(key).agg(
        *[F.max(F.when(F.col("feature") == c, F.col("encoded"))).alias(f"{c}{suffix}") for c in columns])
    return df.join(wide, key)
