"""Session defaults for local runs, and the durable scratch area shared by all executors."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

_LOCAL_SCRATCH: dict[str, str] = {}


def local_session(app_name: str = "holdfast", cores: str = "8", memory: str = "12g",
                  **extra: str) -> SparkSession:
    """Session for tests and benchmarks; a cluster brings its own session and settings."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app_name)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        # Queries share the subscriber stages: keep their compiled code instead of recompiling it.
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        # Skip recording a Python call site for every column expression.
        .config("spark.sql.dataFrameQueryContext.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="holdfast-"))
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in ``spark.checkpoint.dir``.

    A machine-local folder is used only in local mode, where driver and executors share it.
    """
    app = spark.sparkContext.applicationId
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("Set spark.checkpoint.dir to a folder that all executors share.")
        base = _LOCAL_SCRATCH.setdefault(app, tempfile.mkdtemp(prefix="holdfast-"))
    return f"{base.rstrip('/')}/holdfast-{app}"


def new_scratch_path(spark: SparkSession) -> str:
    return f"{scratch_root(spark)}/{uuid.uuid4().hex}"


def new_model_path(spark: SparkSession) -> str:
    """A folder for a fitted model's own files: kept beside the scratch tables until :func:`release_scratch`."""
    return f"{scratch_root(spark)}-models/{uuid.uuid4().hex}"


_OPEN = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Delete, at the end, the tables that :func:`durable` writes inside on this thread.

    For steps whose result does not read them any more: fitted models, written files.
    """
    scopes = _OPEN.__dict__.setdefault("scopes", [])
    scopes.append([])
    try:
        yield
    finally:
        for path in scopes.pop():
            _delete(spark, path)


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """A new folder in the shared scratch area, deleted at the end."""
    path = new_scratch_path(spark)
    try:
        yield path
    finally:
        _delete(spark, path)


def frees_scratch(step: Callable) -> Callable:
    """Run ``step(df, ...)`` in a :func:`scratch_scope`."""
    @wraps(step)
    def run(df: DataFrame, *args, **kwargs):
        with scratch_scope(df.sparkSession):
            return step(df, *args, **kwargs)

    return run


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared scratch folder and continue from the written table.

    Cuts the lineage so that several passes do not recompute the input, and survives the
    loss of executors. The result is columnar, so later passes read only what they use.
    """
    path = new_scratch_path(df.sparkSession)
    if scopes := getattr(_OPEN, "scopes", None):
        scopes[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release_scratch(spark: SparkSession) -> None:
    """Delete this application's scratch tables and unsaved models (call when their readers are done)."""
    _delete(spark, scratch_root(spark))
    _delete(spark, f"{scratch_root(spark)}-models")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
