"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: White space of the word definition used throughout: space and U+0009 to U+000D.
WORD_BREAK = r"[\x20\x09-\x0D]+"
#: Bytes of text handled at once inside a task; a longer text is handled alone.
SLICE_BYTES = 1 << 19


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, with ``value`` evaluated once however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_BLANKS = " \t\n\x0b\f\r"


def words(text: Column) -> Column:
    """The words of a text as an array, in order; empty for NULL and for text without words."""
    inner = F.btrim(text, F.lit(_BLANKS))
    return F.when(F.length(inner) > 0, F.split(inner, WORD_BREAK)).otherwise(F.array().cast("array<string>"))


def word_count(text: Column) -> Column:
    """Number of words of a text as a long; 0 for NULL."""
    inner = F.btrim(text, F.lit(_BLANKS))
    return F.when(F.length(inner) > 0, F.size(F.split(inner, WORD_BREAK))).otherwise(0).cast("long")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the binary ``column`` holds about ``limit`` bytes in each part."""
    start, size = 0, 0
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    for i, n in enumerate(lengths):
        if size and size + n > limit:
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    if start < batch.num_rows:
        yield batch.slice(start)


_TABLES: list[Callable[[], None]] = []
_LAST = [""]


def worker_tables(cached: Callable) -> Callable:
    """Mark a cached function whose tables a worker keeps from task to task of one operator."""
    _TABLES.append(cached.cache_clear)
    return cached


def begin(operator: str) -> None:
    """At the start of a task: a worker that last served another operator drops the tables it kept for that one."""
    if _LAST[0] != operator:
        _LAST[0] = operator
        for clear in _TABLES:
            clear()


def map_texts(docs: DataFrame, keep: list[str | Column], text_col: str, schema: str,
              make: Callable[[], Callable[[pa.RecordBatch, list[bytes]], pa.RecordBatch]]) -> DataFrame:
    """Run a worker function over (columns ``keep``, text as UTF-8 bytes) in small parts.

    ``make`` is called once in each task and returns the function; it gets a part whose columns are
    ``k0, k1, ...`` (the kept ones, in order) and ``t``, and the part's texts, NULL as empty.
    """
    source = docs.select(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(keep)],
                         F.col(text_col).cast("binary").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin(make.__module__)
        work = make()
        for batch in batches:
            for part in slices(batch, "t"):
                yield work(part, [x or b"" for x in part.column("t").to_pylist()])
        # The worker goes on to other tasks; what this one has freed is given back.
        pa.default_memory_pool().release_unused()

    return source.mapInArrow(run, schema)
