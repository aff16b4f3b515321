"""Reproducible stratified splits and samples, ordered by a hash of the key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.functions.scalars import hash_fraction, hash_key
from holdfast.schema import ID, TARGET
from holdfast.session import durable

SEED = 42
PARTS = (("train", 60), ("validation", 20), ("test", 20))
PARTS_70_30 = (("train", 70), ("test", 30))


def _cut_keys(df: DataFrame, cuts: Sequence[tuple[str, Column]], key: str, stratum: str,
              seed: int | str) -> DataFrame:
    """Per stratum, the hash of the last row of each cut: ``(stratum, cut_<name>)``.

    ``cuts`` are (name, rows up to the cut as a function of ``n``). A histogram over the first
    four hex digits finds the bucket each cut falls in; only that bucket's rows are ordered, so
    the rows themselves are never sorted. ``df`` is read twice here and once more to apply the
    cuts, so pass a written table. Digests of distinct keys are evenly spread by
    construction, and the histogram has at most 65,536 rows per stratum.
    """
    hashed = df.select(stratum, F.col(key).alias("_key"), hash_key(F.col(key), seed).alias("_h"))
    hashed = hashed.withColumn("_b", F.substring("_h", 1, 4))
    histogram = hashed.groupBy(stratum, "_b").agg(F.count(F.lit(1)).alias("_c"))
    by_bucket = Window.partitionBy(stratum).orderBy("_b")
    running = histogram.select(
        stratum, "_b", "_c",
        F.sum("_c").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0)).alias("_through"),
        F.sum("_c").over(Window.partitionBy(stratum)).alias("n"),
    )
    wanted = running.select(stratum, "_b", (F.col("_through") - F.col("_c")).alias("_before"), "_through",
                            F.inline(F.array(*[F.struct(F.lit(name).alias("_cut"),
                                                        rows.cast("long").alias("_rows"))
                                               for name, rows in cuts])))
    wanted = durable(wanted.filter("_before < _rows and _rows <= _through").drop("_through"))
    in_bucket = Window.partitionBy(stratum, "_cut").orderBy("_h", "_key")
    at_cut = (
        _same_stratum(hashed, wanted, stratum, ["_b"])
        .withColumn("_place", F.row_number().over(in_bucket) + F.col("_before"))
        .filter("_place = _rows")
    )
    return durable(at_cut.groupBy(stratum).agg(
        *[F.max(F.when(F.col("_cut") == name, F.col("_h"))).alias(f"cut_{name}") for name, _ in cuts]))


def _same_stratum(rows: DataFrame, more: DataFrame, stratum: str, keys: Sequence[str] = (), how: str = "inner") -> DataFrame:
    """Join on the stratum and ``keys``; NULL is a stratum like any other."""
    a, b = rows.alias("a"), more.alias("b")
    same = F.col(f"a.`{stratum}`").eqNullSafe(F.col(f"b.`{stratum}`"))
    for k in keys:
        same &= F.col(f"a.{k}") == F.col(f"b.{k}")
    added = [F.col(f"b.`{c}`") for c in more.columns if c not in (stratum, *keys)]
    return a.join(b, same, how).select("a.*", *added)


def _assign(df: DataFrame, cut_table: DataFrame, names: Sequence[str], last: str, key: str, stratum: str,
            seed: int | str, output: str) -> DataFrame:
    """Label rows by comparing their hash with the stratum's cuts (a narrow join on the stratum)."""
    digest = hash_key(F.col(key), seed)
    label = None
    for name in names:
        inside = F.col(f"cut_{name}").isNotNull() & (digest <= F.col(f"cut_{name}"))
        label = F.when(inside, name) if label is None else label.when(inside, name)
    joined = _same_stratum(df, cut_table, stratum, how="left")
    return joined.select(*df.columns, label.otherwise(last).alias(output))


def stratified_split(df: DataFrame, parts: Sequence[tuple[str, int]] = PARTS, key: str = ID,
                     stratum: str = TARGET, seed: int | str = SEED, output: str = "part") -> DataFrame:
    """Exact split inside each class: parts get floor(n * cumulative percent / 100) rows in turn."""
    if sum(p for _, p in parts) != 100:
        raise ValueError("Part percentages must sum to 100.")
    cuts, upto = [], 0
    for name, percent in parts[:-1]:
        upto += percent
        cuts.append((name, F.floor(F.col("n") * upto / 100)))
    table = _cut_keys(df, cuts, key, stratum, seed)
    return _assign(df, table, [n for n, _ in cuts], parts[-1][0], key, stratum, seed, output)


def hash_split(df: DataFrame, parts: Sequence[tuple[str, int]] = PARTS, key: str = ID,
               seed: int | str = SEED, output: str = "part") -> DataFrame:
    """Approximate split by a threshold on the key's hash: no shuffle, stable as rows arrive."""
    label, upto = None, 0
    spot = hash_fraction(F.col(key), seed)
    for name, percent in parts[:-1]:
        upto += percent
        inside = spot < F.lit(upto / 100.0)
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return df.withColumn(output, label.otherwise(parts[-1][0]))


def hash_sample(df: DataFrame, rows: int, key: str = ID, seed: int | str = SEED) -> DataFrame:
    """Exactly ``rows`` rows (or all, if fewer): those whose key hash is not above the last one's.

    Finding that hash needs no sort, and no task receives more than a hash bucket.
    """
    whole = df.withColumn("_all", F.lit(0))
    table = _cut_keys(whole, [("sample", F.least(F.col("n"), F.lit(rows)))], key, "_all", seed)
    marked = _assign(whole, table, ["sample"], "rest", key, "_all", seed, "_part")
    return marked.filter("_part = 'sample'").drop("_all", "_part")


def hash_holdout(df: DataFrame, stratum: str, percent: int = 10, key: str = ID,
                 seed: int | str = "holdout", output: str = "arm") -> DataFrame:
    """Random control group: ceil(percent of the segment) rows of every segment."""
    table = _cut_keys(df, [("control", F.ceil(F.col("n") * percent / 100))], key, stratum, seed)
    return _assign(df, table, ["control"], "treatment", key, stratum, seed, output)


def split_summary(df: DataFrame, part: str = "part", target: str = TARGET) -> DataFrame:
    return df.groupBy(part).agg(F.count(F.lit(1)).alias("customers"), F.avg(target).alias("churn_rate"))


def pair_sample(df: DataFrame, rows: int = 5000, key: str = ID, target: str = TARGET,
                seed: int | str = SEED) -> DataFrame:
    """Sample for a pairwise view: complete rows, skewed columns on a log scale, class as text.

    ``log1p`` of a value not above -1 is NULL. Pass a written table.
    """
    skewed = ("rev_Mean", "mou_Mean", "totmrc_Mean", "eqpdays")
    complete = df.select(key, "months", *skewed, target).dropna()
    return hash_sample(complete, rows, key, seed).select(
        key, "months", *[F.log1p(c).alias(f"log_{c}") for c in skewed],
        F.when(F.col(target) == 0, "stayed").when(F.col(target) == 1, "churned").alias("churn_label"),
    )
