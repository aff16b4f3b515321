"""Exact running sums along a global order, without moving all rows into one task.

Rows are range-partitioned on (group, order key), so a large group and a long run of nearly
equal keys are both split over many tasks. The partition number is frozen by writing the ranged
rows to the shared scratch folder; one small table of per-partition totals then gives each
partition the amount that precedes it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.session import durable


def running_sums(df: DataFrame, order: Sequence[Column], sums: Mapping[str, str],
                 group: Sequence[str] = ()) -> DataFrame:
    """Add, for each ``output: input`` in ``sums``, the sum of ``input`` up to and including the row.

    ``order`` must be a total order within ``group`` (end it with a unique key). Input columns of
    ``sums`` must not be NULL.
    """
    keys = [F.col(g) for g in group]
    placed = durable(df.repartitionByRange(*keys, *order).withColumn("_slot", F.spark_partition_id()))
    totals = placed.groupBy(*group, "_slot").agg(*[F.sum(c).alias(f"_t_{c}") for c in set(sums.values())])
    # One row per slot and group present in it; a group has at most as many rows as there are slots.
    before = Window.partitionBy(*group).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, "_slot",
        *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in set(sums.values())],
    )
    if not group:
        offsets = F.broadcast(offsets)  # as many rows as shuffle partitions
    local = Window.partitionBy(*group, "_slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(offsets, [*group, "_slot"])
    return joined.select(
        *df.columns,
        *[(F.sum(c).over(local) + F.col(f"_o_{c}")).alias(out) for out, c in sums.items()],
    )


def global_rank(df: DataFrame, order: Sequence[Column], rank: str = "risk_rank") -> DataFrame:
    """Add a dense 1-based position along ``order`` (which must end with a unique key)."""
    counted = df.withColumn("_one", F.lit(1).cast("long"))
    return running_sums(counted, order, {rank: "_one"}).drop("_one")
