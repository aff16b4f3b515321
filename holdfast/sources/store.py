"""Customer tables kept in buckets of the key, so that repeated joins on it move no rows.

Every bucket is one file sorted by the key. Two tables with the same number of buckets are joined bucket by bucket.
The layout is written beside the rows, and a later session opens the table from its folder alone.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from holdfast.schema import ID

BUCKETS = 64


def save_bucketed(df: DataFrame, folder: str, key: str = ID, buckets: int = BUCKETS) -> DataFrame:
    """Write ``df`` below ``folder`` and return it as the bucketed table."""
    spark = df.sparkSession
    name = _name(folder)
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    (df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key)
       .option("path", f"{folder}/rows").saveAsTable(name))
    layout = {"key": key, "buckets": buckets, "schema": df.schema.jsonValue()}
    spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/layout")
    return spark.table(name)


def open_bucketed(spark: SparkSession, folder: str) -> DataFrame:
    """The table that :func:`save_bucketed` wrote, in this or an earlier session."""
    name = _name(folder)
    if not spark.catalog.tableExists(name):
        layout = json.loads(spark.read.text(f"{folder}/layout").first().value)
        fields = T.StructType.fromJson(layout["schema"]).fields
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
        spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY (`{layout['key']}`) "
                  f"SORTED BY (`{layout['key']}`) INTO {layout['buckets']} BUCKETS LOCATION '{folder}/rows'")
    return spark.table(name)


def join_stores(left: DataFrame, right: DataFrame, key: str = ID) -> DataFrame:
    """Join two tables with the same buckets on their key; no row leaves its bucket."""
    return left.hint("merge").join(right, key)


def _name(folder: str) -> str:
    return f"bucketed_{hashlib.md5(folder.encode()).hexdigest()}"
