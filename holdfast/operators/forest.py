"""Deep random forests grown together: large nodes by distributed histograms, small ones whole inside tasks.

MLlib sends a dense table of bins for every node of a level from every task, also for nodes of a few rows; forests
without a depth limit have mostly such nodes. Here features are cut into bins once. As long as a node has more than
``NODE_ROWS`` rows, tasks count its bins and one grouping adds the counts up, for all trees in one pass a level. The
rows of a smaller node are then moved together, once, and its subtree is grown there; no task holds more rows of a
node than that.

What a task moves of a small node's rows are records of many rows; the nodes of a tree are put together by one task and
written to a file (see ``forest_model``), so the driver holds only the large nodes.

A row's draws for a tree are Poisson numbers from its hash (see ``models.balanced_bootstrap``), so they are computed
again wherever they are needed and do not depend on partitions. All counts are whole numbers, so neither do the trees.
As MLlib's, nodes look at the square root of the number of features, and two leaves of one prediction are one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from holdfast.operators.forest_model import Bins, ForestModel, Tree, full_path, store_of, write_tree
from holdfast.schema import ID
from holdfast.session import durable, new_model_path

SEED = 42
#: A node of more rows is split by histograms; the subtree of one with fewer is grown by a single task.
NODE_ROWS = 4096
#: Nodes whose bins a task counts in one pass.
NODES_AT_ONCE = 8192
#: Rows of a batch; with one tree's draws a task holds a few of these.
BATCH_ROWS = 1 << 16
#: Chances of at most 0, 1, 2, ... of a Poisson number with mean one.
POISSON = [math.exp(-1) * sum(1 / math.factorial(i) for i in range(k + 1)) for k in range(12)]

_P1, _P2, _P3, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))


class Shape(NamedTuple):
    """What all nodes share. ``of``: how features are cut."""

    of: Bins
    min_rows: int
    count_draws: bool
    seed: int

    @property
    def arity(self) -> np.ndarray:
        return self.of.arity

    @property
    def bins(self) -> int:
        return self.of.bins

    @property
    def chosen(self) -> int:
        return math.ceil(math.sqrt(len(self.arity)))


class Top(NamedTuple):
    """Large nodes by ascending key (``tree << 32 | path``; the root's path is 1, a node's children 2p and 2p + 1).

    ``feature`` is -1 without a split; ``n0`` and ``n1`` are draws by class.
    """

    keys: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    n0: np.ndarray
    n1: np.ndarray

    def where(self, some: np.ndarray) -> Top:
        return Top(*(c[some] for c in self))

    def added(self, more: Top) -> Top:
        both = Top(*(np.concatenate(pair) for pair in zip(self, more)))
        return both.where(np.argsort(both.keys))

    def of_tree(self, tree: int) -> Top:
        a, b = np.searchsorted(self.keys, [tree << 32, (tree + 1) << 32])
        return self.where(slice(a, b))


def _hash_int(value: int | np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Spark's ``xxhash64`` of one more integer after those whose hashes are ``seeds``."""
    h = (seeds + _P5 + np.uint64(4)) ^ (np.atleast_1d(value).astype(np.uint64) * _P1)
    h = ((h << np.uint64(23)) | (h >> np.uint64(41))) * _P2 + _P3
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def draws(hashes: np.ndarray, tree: int) -> np.ndarray:
    """How often ``tree`` draws the rows with these hashes (``xxhash64(key, seed)``)."""
    u = (_hash_int(tree, hashes.view(np.uint64)) & np.uint64((1 << 52) - 1)) / float(1 << 52)
    return np.searchsorted(POISSON, u, "right")


def _features_of(keys: np.ndarray, shape: Shape) -> np.ndarray:
    """The features that each node looks at, ascending."""
    order = _hash_int(np.arange(len(shape.arity)), (keys.astype(np.uint64) * _P1 + np.uint64(shape.seed))[:, None])
    return np.sort(np.argsort(order, axis=1, kind="stable")[:, :shape.chosen], axis=1)


def _cells(node: np.ndarray, nodes: int, bins: np.ndarray, features: np.ndarray, label: np.ndarray, drawn: np.ndarray,
           shape: Shape) -> np.ndarray:
    """Draws of class 0, of class 1, and rows, by (node, feature looked at, bin)."""
    m, b = shape.chosen, shape.bins
    at = ((node[:, None] * m + np.arange(m)) * b + np.take_along_axis(bins, features[node], axis=1)).ravel()
    weights = (drawn * (label == 0), drawn * (label == 1), np.ones(len(drawn)))
    return np.stack([np.bincount(at, np.repeat(w, m), nodes * m * b) for w in weights]).reshape(3, nodes, m, b)


class _Best(NamedTuple):
    feature: np.ndarray  # -1: no split
    cut: np.ndarray
    left: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    rows: np.ndarray
    left_rows: np.ndarray


def _best(cells: np.ndarray, features: np.ndarray, class_weights: np.ndarray, shape: Shape) -> _Best:
    """The split of the largest Gini gain for each node. ``class_weights``: two columns, by node."""
    _, nodes, m, b = cells.shape
    weights = cells[:2] * class_weights.T[:, :, None, None]
    total, count = weights[:, :, 0].sum(axis=-1), cells[:, :, 0].sum(axis=-1)
    placed = np.stack([*weights, cells[0] + cells[1] if shape.count_draws else cells[2], cells[2]])
    by_rate = shape.arity[features] > 0
    if by_rate.any():
        sub = weights[:, by_rate]
        whole = sub.sum(axis=0)
        rate = np.where(whole > 0, sub[1] / np.where(whole > 0, whole, 1), 2.0)  # categories without rows come last
        order = np.argsort(rate, axis=-1, kind="stable")
        placed[:, by_rate] = np.take_along_axis(placed[:, by_rate], np.broadcast_to(order, (4, *order.shape)), axis=-1)
    l0, l1, n, left_rows = placed.cumsum(axis=-1, out=placed)
    r0, r1 = total[0][:, None, None] - l0, total[1][:, None, None] - l1
    w = total.sum(axis=0)
    parent = 2 * total[0] * total[1] / np.maximum(w, 1e-300)

    def impure(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        both = x + y
        return 2 * x * y / np.where(both > 0, both, 1)

    gain = (parent[:, None, None] - impure(l0, l1) - impure(r0, r1)) / np.maximum(w, 1e-300)[:, None, None]
    gain[(n < shape.min_rows) | (n[:, :, -1:] - n < shape.min_rows)] = -1.0
    flat = gain.reshape(nodes, -1)
    at = flat.argmax(axis=1)
    each, j, cut = np.arange(nodes), at // b, at % b
    left = np.arange(b) <= cut[:, None]
    named = by_rate[each, j]
    if named.any():
        rank = np.empty((int(named.sum()), b), np.int64)
        which = (np.cumsum(by_rate) - 1).reshape(nodes, m)[each, j][named]
        np.put_along_axis(rank, order[which], np.broadcast_to(np.arange(b), rank.shape), axis=1)
        left[named] = rank <= cut[named, None]
    return _Best(np.where(flat[each, at] > 1e-12, features[each, j], -1), cut, left, count[0], count[1], count[2], left_rows[each, j, cut])


def _descend(bins: np.ndarray, tree: int, splits: Top) -> np.ndarray:
    """The path of the node below all ``splits`` that each row ends in."""
    path, live = np.ones(len(bins), np.int64), np.arange(len(bins) if len(splits.keys) else 0)
    while len(live):
        key = path[live] | tree << 32
        at = np.minimum(np.searchsorted(splits.keys, key), len(splits.keys) - 1)
        hit = splits.keys[at] == key
        live, at = live[hit], at[hit]
        path[live] = 2 * path[live] + ~splits.left[at, bins[live, splits.feature[at]]]
    return path


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    """One row for each of the column's byte strings of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _parts(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """All rows, up to ``BATCH_ROWS`` at a time: hashes, labels and bins."""
    held, rows = [], 0
    for batch in batches:
        for start in range(0, batch.num_rows, BATCH_ROWS):
            part = batch.slice(start, BATCH_ROWS)
            if rows + part.num_rows > BATCH_ROWS:
                yield tuple(map(np.concatenate, zip(*held)))
                held, rows = [], 0
            held.append((part.column("hash").to_numpy(), part.column("label").to_numpy(), _matrix(part.column("bins"), kind)))
            rows += part.num_rows
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def grow_subtree(tree: int, root: int, bins: np.ndarray, label: np.ndarray, drawn: np.ndarray, depth: int,
                 class_weights: np.ndarray, shape: Shape) -> Tree:
    """All nodes below ``root`` (a path), itself included, level by level."""
    rows, node = np.arange(len(label)), np.zeros(len(label), np.int64)
    paths, found, starts = np.array([root], np.int64), [], [0]
    while len(paths):
        n1, n, raw = (np.bincount(node, w, len(paths)) for w in (drawn[rows] * label[rows], drawn[rows], None))
        n0, counted = n - n1, n if shape.count_draws else raw
        may = np.flatnonzero((counted >= 2 * shape.min_rows) & (n0 > 0) & (n1 > 0) & (len(found) < depth))
        feature, cut, lefts = np.full(len(paths), -1), np.zeros(len(paths), np.int64), np.zeros((len(paths), shape.bins), bool)
        if len(may):
            place = np.full(len(paths), -1)
            place[may] = np.arange(len(may))
            mine = np.flatnonzero(place[node] >= 0)
            rows, node = rows[mine], node[mine]
            features = _features_of(paths[may] | tree << 32, shape)
            best = _best(_cells(place[node], len(may), bins[rows], features, label[rows], drawn[rows], shape), features,
                         np.broadcast_to(class_weights, (len(may), 2)), shape)
            feature[may], cut[may], lefts[may] = best.feature, best.cut, best.left
        splits = feature >= 0
        found.append((feature, cut, lefts, n0, n1))
        starts.append(starts[-1] + len(paths))
        goes = splits[node]
        rows, node = rows[goes], node[goes]
        left = lefts[node, bins[rows, feature[node]]]
        node = 2 * (np.cumsum(splits) - 1)[node] + ~left
        paths = np.stack([2 * paths[splits], 2 * paths[splits] + 1], axis=1).ravel()
        if not splits.any():
            break
    feature, cut, lefts, n0, n1 = (np.concatenate(c) for c in zip(*found))
    left = np.full(len(feature), -1)  # the right child is next to it
    for level in range(len(found) - 1):
        at = starts[level] + np.flatnonzero(found[level][0] >= 0)
        left[at] = starts[level + 1] + 2 * np.arange(len(at))
    return merged(feature, cut, lefts, left, n0, n1, class_weights, shape, np.flatnonzero(feature >= 0))


def merged(feature: np.ndarray, cut: np.ndarray, lefts: np.ndarray, left: np.ndarray, n0: np.ndarray, n1: np.ndarray,
           class_weights: np.ndarray, shape: Shape, inner: np.ndarray) -> Tree:
    """A tree of these nodes, children after their parents; two leaves of one prediction below a node of ``inner`` are one."""
    prediction = (n1 * class_weights[1] > n0 * class_weights[0]).tolist()
    children = left.tolist()
    for i in inner[::-1].tolist():
        a = children[i]
        if children[a] < 0 and children[a + 1] < 0 and prediction[a] == prediction[a + 1]:
            children[i] = -1
    left = np.array(children)
    alive = np.zeros(len(left), bool)
    alive[0] = True
    level = np.zeros(1, np.int64)
    while len(level):
        level = left[level[left[level] >= 0]]
        level = np.concatenate([level, level + 1])
        alive[level] = True
    number = np.cumsum(alive) - 1
    kept = np.flatnonzero(alive)
    splits = left[kept] >= 0
    feature = np.where(splits, feature[kept], -1)
    named = splits & (shape.arity[feature] > 0)
    return Tree(feature.astype(np.int32), np.where(splits, cut[kept], -1).astype(np.int32),
                np.where(splits, number[left[kept]], -1).astype(np.int32), n0[kept].astype(np.int32), n1[kept].astype(np.int32),
                np.where(named, np.cumsum(named) - 1, -1), lefts[kept[named]])


def categories_by_feature(rows: DataFrame, features: int) -> np.ndarray:
    """Categories of each slot of the vector ``features``, from its attributes; 0 for numbers."""
    arity = np.zeros(features, np.int64)
    for a in rows.schema["features"].metadata.get("ml_attr", {}).get("attrs", {}).get("nominal", []):
        arity[a["idx"]] = len(a["vals"]) if "vals" in a else a.get("num_vals", 0)
    return arity


def _cuts(rows: DataFrame, arity: np.ndarray, bins: int) -> list[np.ndarray]:
    """At most ``bins - 1`` thresholds of each number: its quantiles, without the largest value."""
    numbers = np.flatnonzero(arity == 0).tolist()
    shares = [i / bins for i in range(1, bins)]
    x = rows.select(vector_to_array("features").alias("x"))
    cuts = [np.zeros(0)] * len(arity)
    if numbers:
        row = x.agg(*[F.percentile_approx(F.get("x", F.lit(i)), shares, 10_000).alias(f"q{i}") for i in numbers],
                    *[F.max(F.get("x", F.lit(i))).alias(f"m{i}") for i in numbers]).first()
        for i in numbers:
            at = np.unique(np.array(row[f"q{i}"], float))
            cuts[i] = at[at < row[f"m{i}"]]
    return cuts


def grow_forest(rows: DataFrame, trees: int, depth: int, min_rows: int, bins: int = 32, by_tree: bool = False,
                key: str = ID, seed: int = SEED) -> ForestModel:
    """A forest of ``trees`` trees on ``rows`` (``key``, ``features``, ``_label`` 0 or 1) with balanced classes.

    The classes weigh the same over all rows; with ``by_tree`` they do in the draws of each tree, and ``min_rows``
    counts rows instead of draws.
    """
    spark = rows.sparkSession
    first = rows.select(F.size(vector_to_array("features")).alias("n")).first()
    if first is None:
        raise ValueError("A forest needs rows to fit on.")
    arity = categories_by_feature(rows, first["n"])
    bins = max(bins, int(arity.max(initial=0)))
    shape = Shape(Bins(_cuts(rows, arity, bins), arity, bins), min_rows, not by_tree, seed)
    width, kind = len(arity), shape.of.kind

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            of = shape.of.of(batch.column("x").flatten().to_numpy().reshape(-1, width))
            yield pa.RecordBatch.from_arrays([batch.column("hash"), batch.column("label"), _strings(of, np.arange(len(of) + 1))], ["hash", "label", "bins"])

    table = durable(rows.select(F.xxhash64(F.col(key), F.lit(seed)).alias("hash"), F.col("_label").cast("int").alias("label"),
                                vector_to_array("features").alias("x")).mapInArrow(cut_up, "hash long, label int, bins binary"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((trees, 4), np.int64)
        for hashes, label, _ in _parts(batches, kind):
            for t in range(trees):
                drawn = draws(hashes, t)
                sums[t] += [drawn[label == 0].sum(), drawn[label == 1].sum(), (drawn > 0).sum(), (label == 1).sum()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(trees), pa.int32()), *[pa.array(c) for c in sums.T]],
                                         ["tree", "n0", "n1", "rows", "ones"])

    totals = table.mapInArrow(count, "tree int, n0 long, n1 long, rows long, ones long").groupBy("tree").agg(
        *[F.sum(c).alias(c) for c in ("n0", "n1", "rows", "ones")]).orderBy("tree").collect()  # one row a tree
    whole = table.count()
    of_class = np.array([[r["n0"], r["n1"]] if by_tree else [whole - r["ones"], r["ones"]] for r in totals], float)
    classes = (of_class > 0).sum(axis=1, keepdims=True)
    class_weights = of_class.sum(axis=1, keepdims=True) / (np.maximum(classes, 1) * np.maximum(of_class, 1))

    none = np.zeros(0, np.int64)
    top = Top(none, none, none, np.zeros((0, bins), bool), none, none)
    waiting = np.array([t << 32 | 1 for t in range(trees) if totals[t]["rows"] > NODE_ROWS], np.int64)
    level = 0
    while len(waiting):
        splits, after = top.where(top.feature >= 0), []
        for start in range(0, len(waiting), NODES_AT_ONCE):
            found, rows_of, left_rows = _split_large(table, waiting[start:start + NODES_AT_ONCE], splits, class_weights, shape, kind)
            if level == depth:
                found = found._replace(feature=np.full(len(found.keys), -1))
            top = top.added(found)
            for side, n in enumerate((left_rows, rows_of - left_rows)):
                more = (found.feature >= 0) & (n > NODE_ROWS)
                after.append((found.keys[more] >> 32 << 32) | (2 * (found.keys[more] & 0xFFFFFFFF) + side))
        waiting, level = np.sort(np.concatenate(after)), level + 1

    folder = full_path(spark, new_model_path(spark))
    store, path = store_of(folder)
    store.create_dir(path, recursive=True)
    shared = spark.sparkContext.broadcast((top, shape, class_weights))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top, _, _ = shared.value
        # Large nodes without a split are leaves already; their rows are not moved.
        splits, ends = top.where(top.feature >= 0), top.keys[top.feature < 0]
        for hashes, label, binned in _parts(batches, kind):
            cells = binned.view("u1").reshape(len(binned), -1)
            for t in range(trees):
                drawn = draws(hashes, t)
                at = np.flatnonzero(drawn)
                path = _descend(binned[at], t, splits.of_tree(t))
                if len(ends):
                    goes = ~np.isin(path | t << 32, ends)
                    at, path = at[goes], path[goes]
                order = np.argsort(path, kind="stable")
                at, path = at[order], path[order]
                begins = np.flatnonzero(np.diff(path, prepend=-1))
                packed = np.concatenate([label[at, None].astype("u1"), drawn[at, None].astype("u1"), cells[at]], axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(begins), t), pa.int32()), pa.array(path[begins]), _strings(packed, np.append(begins, len(at)))],
                    ["tree", "path", "rows"])

    def subtree(group: pa.Table) -> pa.Table:
        _, shape, class_weights = shared.value
        tree, path = group.column("tree")[0].as_py(), group.column("path")[0].as_py()
        packed = np.frombuffer(b"".join(group.column("rows").to_pylist()), "u1").reshape(-1, 2 + width * np.dtype(kind).itemsize)
        binned = np.ascontiguousarray(packed[:, 2:]).view(kind)
        grown = grow_subtree(tree, path, binned, packed[:, 0].astype(np.int64), packed[:, 1].astype(np.int64),
                             depth - path.bit_length() + 1, class_weights[tree], shape).table()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, grown.schema) as out:
            out.write_table(grown)
        return pa.table({"tree": pa.array([tree], pa.int32()), "path": pa.array([path], pa.int64()), "nodes": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    def written(group: pa.Table) -> pa.Table:
        top, shape, class_weights = shared.value
        number = group.column("tree")[0].as_py()
        subtrees = {r["path"]: Tree.of(pa.ipc.open_stream(r["nodes"]).read_all(), shape.bins) for r in group.to_pylist() if r["path"]}
        tree = joined(number, top.of_tree(number), subtrees, class_weights[number], shape)
        write_tree(folder, number, tree)
        return pa.table({"tree": pa.array([number], pa.int32()), "size": pa.array([len(tree.left)], pa.int32()),
                         "gains": [tree.gains(class_weights[number], len(shape.arity)).tolist()]})

    subtrees = table.mapInArrow(place, "tree int, path long, rows binary").groupBy("tree", "path").applyInArrow(
        subtree, "tree int, path long, nodes binary")
    tops = spark.createDataFrame([(t, 0, b"") for t in range(trees) if totals[t]["rows"] > NODE_ROWS], "tree int, path long, nodes binary")
    done = subtrees.unionByName(tops).groupBy("tree").applyInArrow(written, "tree int, size int, gains array<double>").collect()  # one row a tree
    sizes, gains = [0] * trees, np.zeros((trees, width))
    for r in done:
        sizes[r["tree"]], gains[r["tree"]] = r["size"], r["gains"]
    whole_gain = gains.sum(axis=0)
    return ForestModel(folder, shape.of, class_weights, sizes, whole_gain / whole_gain.sum() if whole_gain.sum() else whole_gain)


def _strings(rows: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Byte strings, each of the rows from one of ``begins`` to the next."""
    data = np.ascontiguousarray(rows)
    offsets = (begins * data.shape[1] * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _split_large(table: DataFrame, keys: np.ndarray, splits: Top, class_weights: np.ndarray, shape: Shape,
                 kind: str) -> tuple[Top, np.ndarray, np.ndarray]:
    """The best split of every node of ``keys`` (``feature`` is -1 if it has none), their rows and those that go left.

    Bins are counted by tasks, added up and searched by node.
    """
    of_tree = {t: np.flatnonzero(keys >> 32 == t) for t in np.unique(keys >> 32).tolist()}
    shared = table.sparkSession.sparkContext.broadcast((keys, splits, class_weights, shape))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, splits, _, shape = shared.value
        features = _features_of(keys, shape)
        cells = np.zeros((3, len(keys), shape.chosen, shape.bins), np.int64)
        for hashes, label, binned in _parts(batches, kind):
            for t, own in of_tree.items():
                drawn = draws(hashes, t)
                rows = np.flatnonzero(drawn)
                key = _descend(binned[rows], t, splits.of_tree(t)) | t << 32
                at = np.minimum(np.searchsorted(keys[own], key), len(own) - 1)
                hit = keys[own][at] == key
                rows = rows[hit]
                cells[:, own] += _cells(at[hit], len(own), binned[rows], features[own], label[rows], drawn[rows], shape).astype(np.int64)
        some = np.flatnonzero(cells[2, :, 0].sum(axis=-1))
        yield pa.RecordBatch.from_arrays([pa.array(keys[some]), pa.array([cells[:, i].tobytes() for i in some], pa.binary())], ["key", "cells"])

    def search(group: pa.Table) -> pa.Table:
        _, _, class_weights, shape = shared.value
        key = np.array([group.column("key")[0].as_py()], np.int64)
        cells = sum(np.frombuffer(c, np.int64) for c in group.column("cells").to_pylist()).reshape(3, 1, shape.chosen, shape.bins)
        best = _best(cells.astype(float), _features_of(key, shape), class_weights[key >> 32], shape)
        numbers = {c: getattr(best, c).astype(np.int64) for c in ("feature", "cut", "n0", "n1", "rows", "left_rows")}
        return pa.table({"key": key, **numbers, "lefts": pa.array([best.left[0].tobytes()], pa.binary())})

    got = table.mapInArrow(count, "key long, cells binary").groupBy("key").applyInArrow(
        search, "key long, feature long, cut long, n0 long, n1 long, rows long, left_rows long, lefts binary").toArrow()
    # One row for more than NODE_ROWS rows.
    columns = {c: got.column(c).to_numpy() for c in got.column_names if c != "lefts"}
    lefts = np.frombuffer(b"".join(got.column("lefts").to_pylist()), bool).reshape(-1, shape.bins)
    return (Top(columns["key"], columns["feature"], columns["cut"], lefts, columns["n0"], columns["n1"]),
            columns["rows"], columns["left_rows"])


def joined(number: int, top: Top, subtrees: dict[int, Tree], class_weights: np.ndarray, shape: Shape) -> Tree:
    """The tree of its large nodes and of the subtrees below them, by path."""
    if not len(top.keys):
        return subtrees[1]
    paths = (top.keys & 0xFFFFFFFF).tolist()
    splits = np.flatnonzero(top.feature >= 0)
    slot = {1: 0}  # the large nodes and the roots of subtrees, a pair of children after the other
    for i in splits.tolist():
        slot[2 * paths[i]], slot[2 * paths[i] + 1] = len(slot), len(slot) + 1
    size = len(slot) + sum(len(s.left) - 1 for s in subtrees.values())
    feature, cut, left, n0, n1 = (np.full(size, -1, np.int64) for _ in range(5))
    lefts = np.zeros((size, shape.bins), bool)
    at = np.array([slot[p] for p in paths])
    feature[at], cut[at], lefts[at], n0[at], n1[at] = top.feature, top.cut, top.left, top.n0, top.n1
    left[at[splits]] = [slot[2 * paths[i]] for i in splits]
    end = len(slot)
    for path in sorted(subtrees):
        s = subtrees[path]
        to = np.append(slot[path], end + np.arange(len(s.left) - 1))
        feature[to], cut[to], n0[to], n1[to] = s.feature, s.cut, s.n0, s.n1
        left[to] = np.where(s.left >= 0, s.left + (end - 1), -1)
        named = s.named >= 0
        lefts[to[named]] = s.lefts[s.named[named]]
        end += len(s.left) - 1
    return merged(feature, cut, lefts, left, n0, n1, class_weights, shape, np.sort(at[splits]))
