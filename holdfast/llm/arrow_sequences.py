"""Token ids as Arrow IPC files of equal-length sequences, and random access to them.

Documents are encoded, each followed by ``end_id``, and dealt to shards by ascending id; a shard is two
Arrow IPC files in a folder that all executors share:

* ``<shard>.arrow``: the shard's token stream cut into sequences of ``length`` ids. Columns ``input_ids``
  (fixed-size list) and ``attention_mask`` (fixed-size list of bits, false only in the last sequence's
  padding). Every batch but the last holds ``BATCH`` sequences, so sequence ``j`` is row ``j % BATCH`` of
  batch ``j // BATCH``: one slice of a memory-mapped file, without a copy.
* ``<shard>.index.arrow``: ``doc_id``, ``offset`` in the shard's stream, ``n_tokens``.

A task writes files under names of its own and reports them in its result; the manifest, which is written
after all tasks have succeeded, names the files that count. A lost or repeated attempt leaves at most a
file that no manifest names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from holdfast.llm.bpe import VOCABULARY, shared_bpe
from holdfast.llm.common import map_texts
from holdfast.session import durable, new_scratch_path

LENGTH = 2048
BATCH = 256
_INDEX = pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


def _sequence_schema(length: int, kind: pa.DataType) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(kind, length)), ("attention_mask", pa.list_(pa.bool_(), length))])


class _Shard:
    """Writer of one shard; holds at most one batch of ids."""

    def __init__(self, folder: str, name: str, length: int, kind: pa.DataType):
        store, path = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        self.schema, self.length = _sequence_schema(length, kind), length
        self.files = [store.open_output_stream(f"{path}/{name}{end}") for end in (".arrow", ".index.arrow")]
        self.out = pa.ipc.new_file(self.files[0], self.schema)
        self.index = pa.ipc.new_file(self.files[1], _INDEX)
        self.held: list[np.ndarray] = []
        self.n_held = self.tokens = self.docs = 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, counts: np.ndarray) -> None:
        offsets = self.tokens + np.cumsum(counts) - counts
        self.index.write_batch(pa.record_batch([doc_ids, pa.array(offsets), pa.array(counts)], schema=_INDEX))
        self.docs += len(counts)
        self.tokens += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BATCH * self.length:
            self._flush(BATCH * self.length)

    def _flush(self, size: int) -> None:
        flat = np.concatenate(self.held)
        for a in range(0, len(flat) - size + 1, size):
            self._write(flat[a:a + size], np.ones(size, bool))
        self.held = [flat[len(flat) // size * size:]]
        self.n_held = len(self.held[0])

    def _write(self, ids: np.ndarray, mask: np.ndarray) -> None:
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        self.out.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.n_held:
            flat = np.concatenate(self.held)
            mask = np.ones(len(flat), bool)
            fill = -len(flat) % self.length
            self._write(np.pad(flat, (0, fill)), np.pad(mask, (0, fill)))
        for x in (self.out, self.index, *self.files):
            x.close()


def _bounds(docs: DataFrame, id_col: str, shards: int) -> np.ndarray:
    """Ids that cut the documents into ``shards`` ranges of about equal numbers of rows."""
    shares = [i / shards for i in range(1, shards)]
    cuts = docs.agg(F.percentile_approx(F.col(id_col), shares, 10 * shards).alias("cuts")).first()["cuts"] if shares else None
    return np.array(cuts or [], np.int64)


def write_sequences(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                    vocabulary: str = VOCABULARY, end_id: int = 1, length: int = LENGTH,
                    shards: int | None = None) -> DataFrame:
    """Write all documents below ``folder``; returns the manifest (shard, file, docs, n_tokens, start).

    ``id_col`` is an integer column. Rows go by ascending id, NULL ids first; rows with equal ids by the
    hash of their texts, and many of them may be spread over several shards. NULL and empty texts are the
    end id alone. A table without rows writes nothing and gives an empty manifest.
    """
    spark = docs.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = _bounds(docs, id_col, shards)
    rows = docs.select(F.col(id_col).cast("long").alias("d"), F.xxhash64(text_col).alias("h"), F.col(text_col).alias("x"))

    kind = np.uint16 if len(shared_bpe(vocabulary).names) <= 1 << 16 else np.uint32

    def encoder():
        bpe = shared_bpe(vocabulary)

        def work(part: pa.RecordBatch, texts: list[bytes]) -> pa.RecordBatch:
            ids, counts = bpe.encode(texts)
            ends = np.cumsum(counts)
            ids = np.insert(ids, ends, end_id).astype(kind)
            doc, order = part.column("k0"), part.column("k1").to_numpy(zero_copy_only=False).view(np.uint64)
            known = np.asarray(doc.is_valid())
            doc = doc.fill_null(0).to_numpy()
            low, high = np.searchsorted(bounds, doc, "left"), np.searchsorted(bounds, doc, "right")
            shard = np.where(known, low + order % (high - low + 1).astype(np.uint64), 0).astype(np.int32)
            ends = (np.concatenate([[0], ends]) + np.arange(len(ends) + 1)) * ids.itemsize
            blobs = pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
            return pa.RecordBatch.from_arrays([pa.array(shard), part.column("k0"), part.column("k1"), blobs],
                                              ["shard", "d", "h", "ids"])

        return work

    encoded = map_texts(rows, ["d", "h"], "x", "shard int, d long, h long, ids binary", encoder)
    dealt = encoded.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("d").asc_nulls_first(), "h", "ids")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, out, name = -1, None, ""

        def ended() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [name],
                                               "docs": [out.docs], "n_tokens": [out.tokens]})

        for batch in batches:
            of = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if int(of[a]) != shard:
                    if out:
                        yield ended()
                    shard, name = int(of[a]), f"{int(of[a]):06d}-{uuid.uuid4().hex}"
                    out = _Shard(folder, name, length, pa.from_numpy_dtype(kind))
                blobs = part.column("ids").to_pylist()
                ids = np.frombuffer(b"".join(blobs), kind)
                out.add(part.column("d"), ids, np.fromiter(map(len, blobs), np.int64) // ids.itemsize)
        if out:
            yield ended()

    found = durable(dealt.mapInArrow(write, "shard int, file string, docs long, n_tokens long"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row for each shard
    return found.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_documents(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """Read a manifest's files back: ``doc_id``, ``start``, ``n_tokens`` and ``ids``, one row per document.

    ``start`` counts the ids of all documents before it. ``ids`` holds the document's ids as little-endian
    unsigned 32-bit integers. The files are mapped where the store is a local disk.
    """
    files = manifest.select("file", "start").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pa.fs.FileSystem.from_uri(folder)

        def opened(name: str) -> pa.ipc.RecordBatchFileReader:
            local = isinstance(store, pa.fs.LocalFileSystem)
            return pa.ipc.open_file(pa.memory_map(f"{path}/{name}") if local else store.open_input_file(f"{path}/{name}"))

        for batch in batches:
            for row in batch.to_pylist():
                sequences, index = opened(f"{row['file']}.arrow"), opened(f"{row['file']}.index.arrow")
                stream = _Stream(sequences)
                for i in range(index.num_record_batches):
                    docs = index.get_batch(i)
                    offsets, counts = (docs.column(c).to_numpy() for c in ("offset", "n_tokens"))
                    ids = [stream.between(a, a + n).astype("<u4").tobytes() for a, n in zip(offsets.tolist(), counts.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [docs.column("doc_id"), pa.array(offsets + row["start"]), docs.column("n_tokens"), pa.array(ids, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"])

    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


class _Stream:
    """Ids ``[a, b)`` of a shard's token stream, by batch and row of its fixed-size lists."""

    def __init__(self, reader: pa.ipc.RecordBatchFileReader):
        self.reader, self.at, self.values = reader, -1, None
        self.span = BATCH * reader.schema.field("input_ids").type.list_size

    def _batch(self, i: int) -> np.ndarray:
        if i != self.at:
            batch = self.reader.get_batch(i)
            real = np.asarray(batch.column("attention_mask").flatten())
            self.at, self.values = i, batch.column("input_ids").flatten().to_numpy()[: int(real.sum())]
        return self.values

    def between(self, a: int, b: int) -> np.ndarray:
        parts = []
        while a < b:
            i, k = divmod(a, self.span)
            parts.append(self._batch(i)[k:k + b - a])
            a += len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts or [np.zeros(0, np.uint16)])


def round_trip(docs: DataFrame, **options) -> DataFrame:
    """Write ``docs`` to the shared scratch folder and read the files back."""
    spark = docs.sparkSession
    folder = new_scratch_path(spark)
    if "://" not in folder:
        folder = f"file://{folder}"
    return read_documents(spark, durable(write_sequences(docs, folder, **options)), folder)
