"""Approximate nearest neighbours by inner product: stable projections, kd-tree, chi-square stopping.

With ``M`` the largest norm, a vector ``x`` becomes ``(x, sqrt(M^2 - |x|^2))`` and a query is scaled to norm
``M``; the squared distance is then ``2 M^2 - 2 q.x``, so nearest is largest inner product. ``DIMENSIONS``
random Gaussian projections keep distances: the squared projected distance over the squared distance is
chi-square distributed. Projected vectors lie in a kd-tree whose upper levels are fitted on a bounded
sample and whose cells hold all vectors; every cell has a kd-tree of its own in the task that searches it.

A query visits leaves by projected distance and verifies their vectors by the true inner product. It stops
when a vector as near as its present k-th best would lie beyond the next leaf with at most ``1 - CERTAINTY``
probability. It first searches its own cell, then only the cells that this test does not rule out.

Equal vectors are one entry with their smallest ids, so a very common vector is no hot spot; cells are
dealt to tasks in blocks of vectors and of queries.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from holdfast.session import durable

DIMENSIONS = 8
CERTAINTY = 0.95
SAMPLE_ROWS = 20_000
CELL_ROWS = 4096
MAX_DEPTH = 10
BLOCK = 4096
QUERIES = 256
LEAF = 64
SEED = 7


def chi_square_quantile(p: float, degrees: int) -> float:
    """Quantile of the chi-square distribution with an even number of degrees, by bisection."""
    def below(x: float) -> float:
        return 1 - math.exp(-x / 2) * math.fsum((x / 2) ** i / math.factorial(i) for i in range(degrees // 2))

    low, high = 0.0, 1.0
    while below(high) < p:
        high *= 2
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def usable(vector: Column) -> Column:
    """Not NULL, not empty, all components finite, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _split(points: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of a kd-tree in heap order: dimension of the widest spread, median."""
    dims, cuts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1)
    parts = {0: points}
    for node in range(len(dims)):
        own = parts.pop(node)
        if len(own):
            dims[node] = (own.max(axis=0) - own.min(axis=0)).argmax()
            cuts[node] = np.median(own[:, dims[node]])
        right = own[:, dims[node]] > cuts[node]
        parts[2 * node + 1], parts[2 * node + 2] = own[~right], own[right]
    return dims, cuts


def _cell(points: np.ndarray, dims: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    node = np.zeros(len(points), np.int64)
    for _ in range((len(dims) + 1).bit_length() - 1):
        node = 2 * node + 1 + (points[np.arange(len(points)), dims[node]] > cuts[node])
    return node - len(dims)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _norms(x: np.ndarray) -> np.ndarray:
    """Lengths of rows, whatever their size (squares of large or tiny numbers are not formed)."""
    most = np.abs(x).max(axis=1, initial=0)
    unit = x / np.where(most > 0, most, 1)[:, None]
    return most * np.sqrt((unit * unit).sum(axis=1))


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products in double precision; one that is not a number (infinities that cancel) is the lowest."""
    with np.errstate(over="ignore", invalid="ignore"):
        found = (x * q).sum(axis=1)
    return np.where(np.isnan(found), -np.inf, found)


class _Space:
    """Projection of vectors and of queries. Vectors are divided by ``scale``, the largest component of all;
    ``largest`` is the largest squared norm after that."""

    def __init__(self, width: int, scale: float, largest: float):
        self.width, self.scale, self.largest = width, scale, largest
        self.axes = np.random.default_rng(SEED).standard_normal((width + 1, DIMENSIONS))

    def vectors(self, x: np.ndarray) -> np.ndarray:
        x = x / self.scale
        rest = np.sqrt(np.maximum(self.largest - (x * x).sum(axis=1), 0))
        return x @ self.axes[:-1] + rest[:, None] * self.axes[-1]

    def queries(self, q: np.ndarray) -> np.ndarray:
        most = np.abs(q).max(axis=1, initial=0)[:, None]
        unit = q / most
        return unit * np.sqrt(self.largest / (unit * unit).sum(axis=1))[:, None] @ self.axes[:-1]

    def distance(self, q: np.ndarray, score: float) -> float:
        """Squared distance of a vector whose inner product with the unscaled query is ``score``."""
        with np.errstate(over="ignore"):
            along = np.float64(score) / self.scale / _norms(q[None])[0]
            return float(np.maximum(2 * self.largest - 2 * along * np.sqrt(self.largest), 0))


class _Block:
    """A block of vectors with its kd-tree."""

    def __init__(self, space: _Space, ids: np.ndarray, x: np.ndarray):
        points = space.vectors(x)
        depth = max(0, math.ceil(math.log2(max(len(x), 1) / LEAF)))
        cell = _cell(points, *_split(points, depth)) if depth else np.zeros(len(x), np.int64)
        order = np.argsort(cell, kind="stable")
        self.space, self.ids, self.x, points = space, ids[order], x[order], points[order]
        bounds = np.flatnonzero(np.diff(cell[order], prepend=-1))
        self.low, self.high = np.minimum.reduceat(points, bounds), np.maximum.reduceat(points, bounds)
        self.bounds = np.append(bounds, len(x))

    def nearest(self, q: np.ndarray, point: np.ndarray, k: int, bound: float, ratio: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k``; ``bound``: squared distance already known to hold ``k``."""
        away = (np.maximum(np.maximum(self.low - point, point - self.high), 0) ** 2).sum(axis=1)
        ids, scores, at = np.zeros(0, np.int64), np.zeros(0), 0
        order = np.argsort(away, kind="stable")
        step = 4
        while at < len(order) and away[order[at]] <= ratio * bound:
            leaves = order[at:at + step]
            leaves = leaves[away[leaves] <= ratio * bound]
            rows = np.concatenate([np.arange(self.bounds[i], self.bounds[i + 1]) for i in leaves.tolist()])
            ids = np.concatenate([ids, self.ids[rows]])
            scores = np.concatenate([scores, _scores(self.x[rows], q)])
            if len(ids) > k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
            if len(ids) == k:
                bound = min(bound, self.space.distance(q, scores.min()))
            at += step
        return ids, scores


def _search(index: DataFrame, queries: DataFrame, space: _Space, k: int, ratio: float) -> DataFrame:
    """(``query_id``, ``entry``, ``score``): the best ``k`` of each query in each block of its cells.

    ``queries``: cell, query_id, vector, bound. ``index``: cell, block, entries. A unit is one block with
    one chunk of about ``QUERIES`` of the queries that visit its cell; ``queries`` is a written table.
    """
    visits = queries.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / QUERIES).alias("chunks"))
    dealt = queries.join(F.broadcast(visits), "cell")  # at most 2^MAX_DEPTH rows
    asked = dealt.withColumn("chunk", F.pmod(F.xxhash64("query_id"), "chunks")).groupBy("cell", "chunk").agg(
        F.collect_list(F.struct("query_id", "vector", "bound")).alias("asked"))
    units = index.join(asked, "cell").select("entries", "asked")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                entries, asked = part.column("entries").flatten(), part.column("asked").flatten()
                block = _Block(space, entries.field("entry").to_numpy(), _matrix(entries.field("vector"), space.width))
                q = _matrix(asked.field("vector"), space.width)
                bounds = asked.field("bound").to_numpy(zero_copy_only=False)
                found = [block.nearest(q[j], p, k, bounds[j], ratio) for j, p in enumerate(space.queries(q))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(asked.field("query_id").to_numpy(), [len(f[0]) for f in found])),
                     pa.array(np.concatenate([f[0] for f in found])), pa.array(np.concatenate([f[1] for f in found]))],
                    ["query_id", "entry", "score"])

    return units.mapInArrow(run, "query_id long, entry long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "entry")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding",
            certainty: float = CERTAINTY) -> DataFrame:
    """(``query_id``, ``rank``, ``vec_id``, ``score``): the ``k`` nearest found of each query row, itself excluded.

    Nearest is the largest inner product in double precision, ties to the smaller id. A query with fewer
    candidates has them all. Rows whose id or vector is NULL, whose vector is empty, zero or has a NULL or
    non-finite component, or whose length is not the most common one (the shorter, if equally common), take
    no part. Rows with equal vectors are separate candidates; of rows with equal ids the one with the least vector
    (by its first different component) counts. Scores beyond the doubles are infinite, and lowest where infinities
    cancel. One vector much longer than the others makes the others look alike, so that queries verify most of them.
    """
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(
        F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"))
    most = F.array_max(F.transform("vector", F.abs))
    sizes = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.max(most).alias("scale"))
    shape = sizes.orderBy(F.col("n").desc(), "width").first()
    if shape is None:
        return empty
    rows = durable(rows.where(F.size("vector") == shape["width"]).groupBy("id").agg(
        F.min("vector").alias("vector"), F.bool_or("asks").alias("asks")))
    scale = shape["scale"]
    squared = F.aggregate("vector", F.lit(0.0), lambda total, x: total + (x / F.lit(scale)) * (x / F.lit(scale)))
    space = _Space(shape["width"], scale, rows.agg(F.max(squared)).first()[0])
    ratio, wanted = chi_square_quantile(certainty, DIMENSIONS), k + 1
    # Of rows with one vector the k + 1 smallest ids can be among the nearest.
    first = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    entries = durable(rows.select("id", "vector").withColumn("place", first).where(F.col("place") <= wanted)
                      .groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids"))
                      .select(F.get("ids", F.lit(0)).alias("entry"), "vector", "ids"))
    asks = rows.where("asks").select(F.col("id").alias("query_id"), "vector")
    n = entries.count()
    if asks.isEmpty():
        return empty
    depth = min(MAX_DEPTH, max(0, math.ceil(math.log2(n / CELL_ROWS))))
    sample = entries.orderBy(F.xxhash64("entry"), "entry").limit(SAMPLE_ROWS).select("vector").toArrow()
    tree = _split(space.vectors(_matrix(sample.column(0).combine_chunks(), space.width)), depth)

    def placing(columns: list[str], of) -> object:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                points = of(_matrix(batch.column("vector"), space.width)) if batch.num_rows else np.zeros((0, DIMENSIONS))
                at = pa.array(np.arange(batch.num_rows + 1) * DIMENSIONS, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in columns), pa.array(_cell(points, *tree)),
                     pa.ListArray.from_arrays(at, pa.array(points.reshape(-1)))], [*columns, "cell", "point"])

        return run

    placed = durable(entries.select("entry", "vector").mapInArrow(
        placing(["entry", "vector"], space.vectors), "entry long, vector array<double>, cell long, point array<double>"))
    low = [F.min(F.get("point", F.lit(i))).alias(f"l{i}") for i in range(DIMENSIONS)]
    high = [F.max(F.get("point", F.lit(i))).alias(f"h{i}") for i in range(DIMENSIONS)]
    boxes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), *low, *high).collect()  # at most 2^MAX_DEPTH
    cells = np.array([b["cell"] for b in boxes])
    lows, highs = (np.array([[b[f"{side}{i}"] for i in range(DIMENSIONS)] for b in boxes]) for side in "lh")
    blocks = F.create_map(*[F.lit(int(x)) for b in boxes for x in (b["cell"], -(-b["n"] // BLOCK))])[F.col("cell")]
    index = durable(placed.withColumn("block", F.pmod(F.xxhash64("entry"), blocks)).groupBy("cell", "block").agg(
        F.collect_list(F.struct("entry", "vector")).alias("entries")))
    own = durable(asks.mapInArrow(placing(["query_id", "vector"], space.queries),
                                  "query_id long, vector array<double>, cell long, point array<double>"))
    home = durable(_best(_search(index, own.withColumn("bound", F.lit(float("inf"))), space, wanted, ratio), wanted))
    worst = home.where(F.col("place") == wanted).select("query_id", F.col("score").alias("worst"))

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = _matrix(batch.column("vector"), space.width) if batch.num_rows else np.zeros((0, space.width))
            points = _matrix(batch.column("point"), DIMENSIONS) if batch.num_rows else np.zeros((0, DIMENSIONS))
            bounds, to, which = np.full(len(q), np.inf), [], []
            for j, (score, cell) in enumerate(zip(batch.column("worst").to_pylist(), batch.column("cell").to_pylist())):
                if score is not None:
                    bounds[j] = space.distance(q[j], score)
                away = (np.maximum(np.maximum(lows - points[j], points[j] - highs), 0) ** 2).sum(axis=1)
                visit = cells[(away <= ratio * bounds[j]) & (cells != cell)]
                to.append(visit)
                which.append(np.full(len(visit), j))
            which = np.concatenate([np.zeros(0, np.int64), *which])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([np.zeros(0, np.int64), *to])), batch.column("query_id").take(pa.array(which)),
                 batch.column("vector").take(pa.array(which)), pa.array(bounds[which])], ["cell", "query_id", "vector", "bound"])

    more = durable(own.join(worst, "query_id", "left").mapInArrow(elsewhere, "cell long, query_id long, vector array<double>, bound double"))
    both = _best(home.drop("place").unionByName(_search(index, more, space, wanted, ratio)), wanted).drop("place")
    named = both.join(entries.select("entry", "ids"), "entry").select("query_id", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return named.where("vec_id <> query_id").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score")
