"""Key and target validation, and the checked one-to-one join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.schema import ID, TARGET


def join_one_to_one(record: DataFrame, client: DataFrame, key: str = ID) -> DataFrame:
    """Inner equi-join, record columns first, key once. Check the keys with :func:`validate`."""
    return record.join(client, key, "inner")


def duplicate_keys(df: DataFrame, key: str, table_name: str) -> DataFrame:
    """Every non-NULL key that occurs more than once."""
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(F.col(key).cast("long").alias("key"))
        .agg(F.count(F.lit(1)).alias("copies"))
        .filter("copies > 1")
        .select(F.lit(table_name).alias("table_name"), "key", "copies")
    )


def _sides(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of both tables with a presence mark per side."""
    a = left.filter(F.col(key).isNotNull()).groupBy(key).agg(F.lit(1).alias("in_left"))
    b = right.filter(F.col(key).isNotNull()).groupBy(key).agg(F.lit(1).alias("in_right"))
    return a.join(b, key, "full_outer")


def key_coverage(left: DataFrame, right: DataFrame, key: str = ID) -> DataFrame:
    """How many keys sit on the left only, on the right only, and on both sides."""
    counted = _sides(left, right, key).agg(
        F.count_if(F.col("in_right").isNull()).alias("l"),
        F.count_if(F.col("in_left").isNull()).alias("r"),
        F.count_if(F.col("in_left").isNotNull() & F.col("in_right").isNotNull()).alias("b"),
    )
    return counted.selectExpr("stack(3, 'left_only', l, 'right_only', r, 'both', b) as (side, ids)")


def coverage_offenders(left: DataFrame, right: DataFrame, key: str = ID) -> DataFrame:
    """The keys that one of the two tables lacks."""
    lost_right = left.join(right, key, "left_anti").select(key, F.lit("right").alias("missing_from"))
    lost_left = right.join(left, key, "left_anti").select(key, F.lit("left").alias("missing_from"))
    return lost_right.unionByName(lost_left)


def _key_stats(df: DataFrame, key: str, target: str | None, prefix: str) -> DataFrame:
    aggs = [F.count(F.lit(1)).alias(f"{prefix}_rows")]
    if target is not None and target in df.columns:
        value = F.col(target)
        aggs += [F.count_if(value.isNull()).alias("target_nulls"),
                 F.count_if(~value.isin(0, 1)).alias("target_outside")]
    return df.groupBy(key).agg(*aggs)


def dq_report(client: DataFrame, record: DataFrame, key: str = ID, target: str = TARGET) -> DataFrame:
    """Violations per rule. One grouping per table and one co-partitioned join serve all rules."""
    missing = [name for name, df in (("client", client), ("record", record)) if key not in df.columns]
    spark = client.sparkSession
    rows = [(name, "id_present", int(name in missing)) for name in ("client", "record")]
    rows.append(("joined", "target_present", int(target not in (*client.columns, *record.columns))))
    schema = "table_name string, rule string, violations long"
    report = spark.createDataFrame(rows, schema)
    if missing:
        return report
    owner_is_record = target in record.columns
    c = _key_stats(client, key, None if owner_is_record else target, "client")
    r = _key_stats(record, key, target if owner_is_record else None, "record")
    both = c.join(r, key, "full_outer")
    k, n_c, n_r = F.col(key), F.col("client_rows"), F.col("record_rows")

    def total(value, where):
        return F.coalesce(F.sum(F.when(where, value)), F.lit(0))

    rules = {
        ("client", "id_not_null"): total(n_c, k.isNull()),
        ("record", "id_not_null"): total(n_r, k.isNull()),
        ("client", "id_unique"): total(n_c - 1, k.isNotNull()),
        ("record", "id_unique"): total(n_r - 1, k.isNotNull()),
        ("joined", "same_ids"): total(F.lit(1), k.isNotNull() & (n_c.isNull() | n_r.isNull())),
    }
    if target in both.columns or "target_nulls" in both.columns:
        rules[("joined", "target_not_null")] = total(F.col("target_nulls"), F.lit(True))
        rules[("joined", "target_is_0_or_1")] = total(F.col("target_outside"), F.lit(True))
    one = both.agg(*[v.cast("long").alias(f"v{i}") for i, v in enumerate(rules.values())])
    cells = F.array(*[
        F.struct(F.lit(t).alias("table_name"), F.lit(rule).alias("rule"), F.col(f"v{i}").alias("violations"))
        for i, (t, rule) in enumerate(rules)
    ])
    return report.unionByName(one.select(F.inline(cells)))


def validate(client: DataFrame, record: DataFrame, key: str = ID, target: str = TARGET) -> None:
    """Raise with every broken rule named."""
    broken = dq_report(client, record, key, target).filter("violations > 0").collect()
    if broken:
        raise ValueError("; ".join(sorted(f"{r.table_name}.{r.rule}: {r.violations}" for r in broken)))
