"""Parquet source tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_SCHEMAS: dict[tuple[str, str, str], StructType] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Source table ``name``; its schema is read from the files once per application."""
    key = (spark.sparkContext.applicationId, folder, name)
    path = f"{folder}/{name}.parquet"
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)
