"""Hard negatives by inner product, searched in an R-tree packed by sort-tile-recursive.

Vectors hold whole numbers, so scores are exact integers. The tree has three levels, in files of the shared folder:
rows are ordered by label, by slabs of the coordinate that varies most, by slabs of the next one inside those, by a
third coordinate and by id (the slabs' cuts come from a bounded sample; every row is in the tree). Runs of rows in
that order are pages, the pages of a range of the order are a file, and files are the root's children. A page and a
file have a minimum bounding box, the range of their labels and their smallest id.

Per coordinate, an anchor's component times a box's interval is an interval; their sum bounds the inner product of
the anchor with anything in the box. A task takes a chunk of neighbouring anchors and a queue of boxes, the one with
the highest bound first. A box is left out for an anchor if its labels are not asked for, if its bounds lie outside
the score window, or if its upper bound is strictly below the anchor's k-th best (or equal, and all its ids are
larger). Files and pages that no anchor of the chunk needs are never read.
"""

from __future__ import annotations

import heapq
import itertools
import math
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdfast.session import durable, new_scratch_path

PAGE_ROWS = 1024
PAGE_BYTES = 1 << 20
FILE_ROWS = 1 << 18
SAMPLE_ROWS = 20_000
CHUNK = 256
OPEN_FILES = 64
KEPT_PAGES = 64
#: Scores beyond 64 bits count as the nearest of these.
MOST = 2**63 - 2
NONE = -(2**63 - 1)


class Box(NamedTuple):
    """Boxes of files or of pages, one in each row of the arrays."""

    low: np.ndarray
    high: np.ndarray
    first_label: np.ndarray
    last_label: np.ndarray
    least_id: np.ndarray

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible score of each row of ``q`` with anything in each box."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        with np.errstate(over="ignore", invalid="ignore"):
            least = up @ self.low.T + down @ self.high.T
            most = up @ self.high.T + down @ self.low.T
            # Exact while sums stay below 2^53; beyond, wider by more than the rounding.
            slack = np.abs(q) @ np.maximum(np.abs(self.low), np.abs(self.high)).T * 2.0**-40
            least = np.nan_to_num(np.ceil(least - slack), nan=-np.inf, posinf=1e300, neginf=-1e300)
            most = np.nan_to_num(np.floor(most + slack), nan=np.inf, posinf=1e300, neginf=-1e300)
        return _whole(least), _whole(most)


def _whole(values: np.ndarray) -> np.ndarray:
    """Whole doubles as 64-bit integers, beyond them the nearest."""
    out = np.clip(values, -(2.0**62), 2.0**62).astype(np.int64)
    return np.where(values >= 2.0**62, MOST, np.where(values <= -(2.0**62), -MOST, out))


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole doubles, as 64-bit integers (see ``MOST``)."""
    out = np.zeros((len(q), len(x)), np.int64)
    if not out.size:
        return out
    size_q, size_x = np.abs(q).max(axis=1, initial=0), np.abs(x).max(axis=1, initial=0)
    limit = 2.0**53 / max(q.shape[1], 1)
    small_x = size_x * min(size_q.max(), limit) < limit
    small_q = size_q * size_x[small_x].max(initial=0) < limit
    if small_q.any() and small_x.any():
        out[np.ix_(small_q, small_x)] = (q[small_q] @ x[small_x].T).astype(np.int64)
    rest = [(np.flatnonzero(~small_q), np.arange(len(x))), (np.flatnonzero(small_q), np.flatnonzero(~small_x))]
    for rows, columns in rest:
        if len(rows) and len(columns):
            big = np.array([[int(v) for v in r] for r in q[rows].tolist()], object)
            other = np.array([[int(v) for v in r] for r in x[columns].tolist()], object)
            out[np.ix_(rows, columns)] = np.clip(big @ other.T, -MOST, MOST).astype(np.int64)
    return out


def whole_256ths(x: Column) -> Column:
    """``floor(256 * x)`` as a double; from 2^53 on doubles are whole, and beyond the largest one it is that one.

    NULL and non-finite components stay what they are.
    """
    scaled = x * 256
    bounded = F.when(F.abs(scaled) < 2.0**53, F.floor(scaled).cast("double")).otherwise(scaled)
    largest = 1.7976931348623157e308
    return F.when(F.abs(x) < float("inf"), F.greatest(F.lit(-largest), F.least(F.lit(largest), bounded))).otherwise(x)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


class _Tree:
    """Reader of the tree's files; keeps a bounded number of boxes and pages."""

    def __init__(self, folder: str, names: list[str], root: Box):
        self.store, self.path = pa.fs.FileSystem.from_uri(folder)
        self.names, self.root, self.width = names, root, root.low.shape[1]
        self.opened: OrderedDict[int, tuple[pa.ipc.RecordBatchFileReader, Box]] = OrderedDict()
        self.held: OrderedDict[tuple[int, int], tuple] = OrderedDict()

    def _reader(self, name: str) -> pa.ipc.RecordBatchFileReader:
        return pa.ipc.open_file(self.store.open_input_file(f"{self.path}/{name}"))

    def pages(self, file: int) -> Box:
        return self._open(file)[1]

    def _open(self, file: int):
        if file not in self.opened:
            index = self._reader(f"{self.names[file]}.index.arrow").read_all().combine_chunks()
            low, high = (_matrix(index.column(c).chunk(0), self.width) for c in ("low", "high"))
            plain = (index.column(c).to_numpy() for c in ("first_label", "last_label", "least_id"))
            self.opened[file] = self._reader(f"{self.names[file]}.arrow"), Box(low, high, *plain)
            if len(self.opened) > OPEN_FILES:
                self.opened.popitem(last=False)
        self.opened.move_to_end(file)
        return self.opened[file]

    def entries(self, file: int, page: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, labels and vectors of a page."""
        if (file, page) not in self.held:
            batch = self._open(file)[0].get_batch(page)
            self.held[file, page] = (batch.column("id").to_numpy(), batch.column("label").to_numpy(),
                                     _matrix(batch.column("vector"), self.width))
            if len(self.held) > KEPT_PAGES:
                self.held.popitem(last=False)
        self.held.move_to_end((file, page))
        return self.held[file, page]


class _Asked(NamedTuple):
    """Searches: the anchor of each, whether it wants the anchor's label, its score window, its best so far."""

    anchor: np.ndarray
    same: bool
    least: np.ndarray
    most: np.ndarray
    scores: np.ndarray
    ids: np.ndarray

    def needing(self, box: Box, i: int | slice, labels: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Which searches a box can still serve, and how high: its bound inside the window, or ``NONE``.

        ``low`` and ``high`` are the boxes' bounds for each anchor; one column for each box of ``i``.
        """
        own, first, last = labels[:, None], box.first_label[i][None], box.last_label[i][None]
        asked = (first <= own) & (own <= last) if self.same else (first != own) | (own != last)
        low, high, asked = low[self.anchor], high[self.anchor], asked[self.anchor]
        top = np.minimum(high, self.most[:, None])
        worst, worst_id = self.scores[:, -1:], self.ids[:, -1:]
        use = asked & (high >= self.least[:, None]) & (low <= self.most[:, None]) & (
            (top > worst) | ((top == worst) & (box.least_id[i][None] < worst_id)))
        return np.where(use, top, NONE)


def _asked(anchor: np.ndarray, same: bool, least: np.ndarray, most: np.ndarray, k: int) -> _Asked:
    n = len(anchor)
    return _Asked(anchor, same, least, most, np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max))


def _search(tree: _Tree, q: np.ndarray, own_ids: np.ndarray, labels: np.ndarray, asked: _Asked) -> None:
    """Fill in the best of every search, boxes with the highest bound first."""
    queue: list[tuple[int, int, int, int]] = []
    turn = itertools.count()

    def push(box: Box, file: int | None) -> None:
        low, high = box.bounds(q)
        top = asked.needing(box, slice(None), labels, low, high).max(axis=0, initial=NONE)
        for i in np.flatnonzero(top > NONE).tolist():
            heapq.heappush(queue, (-int(top[i]), next(turn), *((i, -1) if file is None else (file, i))))

    push(tree.root, None)
    while queue:
        _, _, file, page = heapq.heappop(queue)
        box, i = (tree.root, file) if page < 0 else (tree.pages(file), page)
        one = slice(i, i + 1)
        low, high = Box(*(x[one] for x in box)).bounds(q)
        use = np.flatnonzero(asked.needing(box, one, labels, low, high)[:, 0] > NONE)
        if not len(use):
            continue
        if page < 0:
            push(tree.pages(file), file)
            continue
        ids, of, x = tree.entries(file, page)
        anchors, at = np.unique(asked.anchor[use], return_inverse=True)
        found = scores(q[anchors], x)
        fits = (ids[None] != own_ids[anchors][:, None]) & ((of[None] == labels[anchors][:, None]) == asked.same)
        found = np.where(fits, found, NONE)[at]
        found[(found < asked.least[use, None]) | (found > asked.most[use, None])] = NONE
        _merge(asked, use, found, ids)


def _merge(asked: _Asked, use: np.ndarray, found: np.ndarray, ids: np.ndarray) -> None:
    """Put the best of ``found`` (one row for each search of ``use``) into the searches' lists."""
    k, n = asked.scores.shape[1], found.shape[1]
    limit = asked.scores[use, -1]
    if n > k:
        limit = np.maximum(limit, np.partition(found, n - k, axis=1)[:, n - k])
    row, column = np.nonzero((found >= limit[:, None]) & (found > NONE))
    rows = np.concatenate([row, np.repeat(np.arange(len(use)), k)])
    every = np.concatenate([found[row, column], asked.scores[use].reshape(-1)])
    named = np.concatenate([ids[column], asked.ids[use].reshape(-1)])
    order = np.lexsort((named, -every, rows))
    starts = np.searchsorted(rows[order], np.arange(len(use)))
    best = order[starts[:, None] + np.arange(k)]
    asked.scores[use], asked.ids[use] = every[best], named[best]


def _write_pages(folder: str, width: int, page_rows: int):
    """Worker: writes its ordered rows as one file of pages and one of their boxes; returns the file's box."""
    entry = pa.schema([("id", pa.int64()), ("label", pa.int64()), ("vector", pa.list_(pa.float64(), width))])
    index = pa.schema([("low", pa.list_(pa.float64(), width)), ("high", pa.list_(pa.float64(), width)),
                       ("first_label", pa.int64()), ("last_label", pa.int64()), ("least_id", pa.int64())])

    def fixed(rows: np.ndarray) -> pa.Array:
        return pa.FixedSizeListArray.from_arrays(pa.array(np.ascontiguousarray(rows).reshape(-1)), width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name, boxes, files, out = uuid.uuid4().hex, [], [], None
        options = pa.ipc.IpcWriteOptions(compression="lz4")

        def write(ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
            nonlocal out
            if out is None:
                files.append(store.open_output_stream(f"{path}/{name}.arrow"))
                out = pa.ipc.new_file(files[0], entry, options=options)
            out.write_batch(pa.record_batch([pa.array(ids), pa.array(labels), fixed(x)], schema=entry))
            boxes.append((x.min(axis=0), x.max(axis=0), labels.min(), labels.max(), ids.min()))

        held: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            if batch.num_rows:
                held.append((batch.column("id").to_numpy(), batch.column("label").to_numpy(), _matrix(batch.column("vector"), width)))
            if sum(len(h[0]) for h in held) >= page_rows:
                whole = [np.concatenate(c) for c in zip(*held)]
                end = len(whole[0]) // page_rows * page_rows
                for a in range(0, end, page_rows):
                    write(*(c[a:a + page_rows] for c in whole))
                held = [tuple(c[end:] for c in whole)]
        if held and sum(len(h[0]) for h in held):
            write(*(np.concatenate(c) for c in zip(*held)))
        if out is None:
            return
        low, high, first, last, least = (np.array(c) for c in zip(*boxes))
        out.close()
        files.append(store.open_output_stream(f"{path}/{name}.index.arrow"))
        with pa.ipc.new_file(files[1], index) as f:
            f.write_batch(pa.record_batch([fixed(low), fixed(high), *map(pa.array, (first, last, least))], schema=index))
        for f in files:
            f.close()
        yield pa.RecordBatch.from_pydict({
            "file": [name], "low": [low.min(axis=0)], "high": [high.max(axis=0)], "first_label": pa.array([first.min()]),
            "last_label": pa.array([last.max()]), "least_id": pa.array([least.min()])})

    return run


def _slabs(sample: np.ndarray, pages: int) -> tuple[list[int], list[float], list[list[float]]]:
    """Coordinates that vary most, cuts of the first, and cuts of the second inside each slab of the first."""
    axes = np.argsort(-np.clip(sample, -1e100, 1e100).var(axis=0), kind="stable")[:3].tolist() if len(sample) else []
    axes = (axes or [0]) + [(axes or [0])[-1]] * (3 - len(axes or [0]))
    n = max(1, math.ceil(pages ** (1 / 3)))
    shares = np.arange(1, n) / n
    first = np.quantile(sample[:, axes[0]], shares) if len(sample) else np.zeros(n - 1)
    of = np.searchsorted(first, sample[:, axes[0]], "left")
    inner = [sample[of == i][:, axes[1]] for i in range(n)]
    return axes, first.tolist(), [(np.quantile(x, shares) if len(x) else np.zeros(n - 1)).tolist() for x in inner]


def _cuts(values: list) -> Column:
    return F.array(*[F.lit(float(v)) for v in values]).cast("array<double>")


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, least_percent: int = 80,
         most_percent: int = 100, id_col: str = "vec_id", vector_col: str = "vector", label_col: str = "label",
         page_rows: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """Hard negatives of every anchor and each of its nearest positives.

    ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``. A
    score is the exact inner product with the anchor; higher ones come first, ties by the smaller id. An anchor's
    positives are its first ``positives`` rows with its label; for each of them the first ``negatives`` rows with
    another label are returned whose score is between ``least_percent`` and ``most_percent`` hundredths of the
    positive's, both included.

    ``vector_col`` holds arrays of doubles that are whole numbers, ``label_col`` whole numbers. Rows with a NULL id,
    label or vector, a NULL or non-finite component, an empty vector, or a length that is not the most common one
    (the shorter, if equally common) take no part. Rows with equal ids are separate rows, but rows with an anchor's
    id are not its candidates, and every anchor row has its own results. Scores beyond 64 bits count as the nearest
    64-bit number but one. Tables without anchors or candidates give no rows; other columns are not read.
    """
    spark = vectors.sparkSession
    kind = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    finite = F.forall(F.col(vector_col), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    taken = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & (F.size(vector_col) > 0) & finite
    rows = durable(vectors.where(F.coalesce(taken, F.lit(False))).select(
        F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"),
        F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("asks")))
    shape = rows.groupBy(F.size("vector").alias("width")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("anchors"),
        F.approx_count_distinct("label").alias("labels")).orderBy(F.col("n").desc(), "width").first()
    if shape is None or not shape["anchors"]:
        return spark.createDataFrame([], kind)
    width, rows = shape["width"], rows.where(F.size("vector") == shape["width"])
    page_rows = page_rows or max(64, min(PAGE_ROWS, PAGE_BYTES // (8 * width)))
    sample = rows.orderBy(F.xxhash64("id", "vector")).limit(SAMPLE_ROWS).select("vector").toArrow()
    pages = math.ceil(shape["n"] / page_rows)
    axes, first, inner = _slabs(_matrix(sample.column(0).combine_chunks(), width), math.ceil(pages / max(1, shape["labels"])))
    x = [F.get("vector", F.lit(a)) for a in axes]
    outer_slab = F.size(F.filter(_cuts(first), lambda c: c < x[0]))
    inner_cuts = F.get(F.array(*map(_cuts, inner)), outer_slab)
    order = ["label", outer_slab, F.size(F.filter(inner_cuts, lambda c: c < x[1])), x[2], "id"]
    folder = new_scratch_path(spark)
    folder = folder if "://" in folder else f"file://{folder}"
    workers = spark.sparkContext.defaultParallelism
    n_files = max(math.ceil(shape["n"] / FILE_ROWS), min(workers, math.ceil(pages / 4)))
    box = "file string, low array<double>, high array<double>, first_label long, last_label long, least_id long"
    written = durable(rows.select("id", "label", "vector").repartitionByRange(n_files, *order).sortWithinPartitions(*order)
                      .mapInArrow(_write_pages(folder, width, page_rows), box))
    found = written.orderBy("first_label", "file").toArrow()  # one row for each FILE_ROWS vectors
    low, high = (_matrix(found.column(c).combine_chunks(), width) for c in ("low", "high"))
    root = Box(low, high, *(found.column(c).to_numpy() for c in ("first_label", "last_label", "least_id")))
    names = found.column("file").to_pylist()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = _Tree(folder, names, root)
        for batch in batches:
            for a in range(0, batch.num_rows, chunk):
                part = batch.slice(a, chunk)
                yield _mined(tree, part.column("id").to_numpy(), part.column("label").to_numpy(),
                             _matrix(part.column("vector"), width), positives, negatives, least_percent, most_percent)

    n_tasks = max(math.ceil(shape["anchors"] / chunk), min(workers, math.ceil(shape["anchors"] / 16)))
    asks = rows.where("asks").select("id", "label", "vector").repartitionByRange(n_tasks, *order)
    return asks.mapInArrow(search, kind)


def _mined(tree: _Tree, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, positives: int, negatives: int,
           least_percent: int, most_percent: int) -> pa.RecordBatch:
    """Results of a chunk of anchors: first the positives of all, then the negatives of all positives."""
    n = len(ids)
    near = _asked(np.arange(n), True, np.full(n, -MOST), np.full(n, MOST), positives)
    _search(tree, q, ids, labels, near)
    anchor, place = np.nonzero(near.scores > NONE)
    score = near.scores[anchor, place]
    # Of whole numbers s with least_percent * p <= 100 * s <= most_percent * p.
    least = np.array([-(-least_percent * p // 100) for p in score.tolist()], np.int64)
    most = np.array([most_percent * p // 100 for p in score.tolist()], np.int64)
    hard = _asked(anchor, False, least, most, negatives)
    open_window = least <= most
    some = _Asked(anchor[open_window], False, least[open_window], most[open_window], hard.scores[open_window], hard.ids[open_window])
    _search(tree, q, ids, labels, some)
    hard.scores[open_window], hard.ids[open_window] = some.scores, some.ids
    pair, rank = np.nonzero(hard.scores > NONE)
    return pa.RecordBatch.from_arrays(
        [pa.array(ids[anchor[pair]]), pa.array(near.ids[anchor[pair], place[pair]]), pa.array((rank + 1).astype(np.int32)),
         pa.array(hard.ids[pair, rank]), pa.array(score[pair]), pa.array(hard.scores[pair, rank])],
        ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"])


#: All pairs of anchors and rows, for a second engine.
MINING_SQL = """
WITH e AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5),
ranked AS (
  SELECT p.anchor_id, p.positive_id, s.other_id AS negative_id, p.positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
    AND 80 * p.positive_score <= 100 * s.score AND 100 * s.score <= 100 * p.positive_score)
SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM ranked WHERE rank <= 5
"""
