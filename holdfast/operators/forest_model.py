"""The classifier that ``forest`` grows: trees as files of the shared folder, never together on the driver or in a task.

An MLlib forest is a tree of JVM objects on the driver, some hundred bytes a node; a forest without a depth limit has
a node for every few rows and tree. Here a tree is one Arrow file, written by a task, of about 22 bytes a node. To score, a task cuts
its rows into bins and reads one tree after the other, all trees once for ``SCORE_ROWS`` rows; it holds one tree and
two votes a row. Saving copies the files in tasks, loading reads the description alone. Votes, probabilities and
importances are those of MLlib's forest.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.ml import Model
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vector, Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a task scores with one reading of the trees.
SCORE_ROWS = 1 << 18
_FILE = pa.schema([("feature", pa.int32()), ("cut", pa.int32()), ("left", pa.int32()), ("n0", pa.int32()), ("n1", pa.int32()), ("lefts", pa.binary())])


class Bins(NamedTuple):
    """How rows are cut. ``arity``: categories of each feature, 0 for numbers; ``cuts``: thresholds of the numbers."""

    cuts: list[np.ndarray]
    arity: np.ndarray
    bins: int

    @property
    def kind(self) -> str:
        return "<u1" if self.bins <= 256 else "<u2"

    def of(self, x: np.ndarray) -> np.ndarray:
        bins = np.empty(x.shape, self.kind)
        for i, cuts in enumerate(self.cuts):
            bins[:, i] = x[:, i] if self.arity[i] else np.searchsorted(cuts, x[:, i], "left")
        return bins


class Tree(NamedTuple):
    """Nodes, children after their parents: ``feature`` is -1 in leaves, the right child is next to ``left``.

    A row goes left if its bin is not above ``cut``, or by its row of ``lefts`` if the node is numbered in ``named``.
    ``n0`` and ``n1`` are draws by class.
    """

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    n0: np.ndarray
    n1: np.ndarray
    named: np.ndarray
    lefts: np.ndarray

    def leaves_of(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of every row of ``bins``."""
        at, live, node = np.zeros(len(bins), np.int64), np.arange(len(bins)), np.zeros(len(bins), np.int64)
        while len(live):
            feature = self.feature[node]
            inner = feature >= 0
            if not inner.all():
                live, node, feature = live[inner], node[inner], feature[inner]
            of = bins[live, feature]
            right = of > self.cut[node]
            if len(self.lefts):
                named = self.named[node]
                some = np.flatnonzero(named >= 0)
                right[some] = ~self.lefts[named[some], of[some]]
            at[live] = node = self.left[node] + right
        return at

    @property
    def depth(self) -> int:
        level, depth = np.zeros(1, np.int64), -1
        while len(level):
            level = level[self.feature[level] >= 0]
            level, depth = np.concatenate([self.left[level], self.left[level] + 1]), depth + 1
        return depth

    def gains(self, weights: np.ndarray, features: int) -> np.ndarray:
        """By feature, the share of its splits in the fall of the weighted Gini impurity."""
        w0, w1 = self.n0 * weights[0], self.n1 * weights[1]
        impure = 2 * w0 * w1 / np.where(w0 + w1 > 0, w0 + w1, 1)
        at = np.flatnonzero(self.feature >= 0)
        below = self.left[at]
        gains = np.bincount(self.feature[at], impure[at] - impure[below] - impure[below + 1], features).astype(float)
        return gains / gains.sum() if gains.sum() else gains

    def table(self) -> pa.Table:
        packed = np.packbits(self.lefts, axis=1) if len(self.lefts) else np.zeros((0, 1), np.uint8)
        lefts = [packed[i].tobytes() if i >= 0 else None for i in self.named.tolist()]
        return pa.table([*(pa.array(c, pa.int32()) for c in self[:5]), pa.array(lefts, pa.binary())], schema=_FILE)

    @classmethod
    def of(cls, table: pa.Table, bins: int) -> Tree:
        columns = [table.column(c).to_numpy() for c in _FILE.names[:5]]
        lefts = table.column("lefts").combine_chunks()
        some = lefts.is_valid().to_numpy(zero_copy_only=False)
        packed = np.frombuffer(b"".join(lefts.drop_null().to_pylist()), np.uint8).reshape(int(some.sum()), (bins + 7) // 8)
        return cls(*columns, np.where(some, np.cumsum(some) - 1, -1), np.unpackbits(packed, axis=1, count=bins).astype(bool))


def store_of(folder: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(folder)


def write_tree(folder: str, number: int, tree: Tree) -> None:
    """The file of a tree; a task that runs twice leaves it once."""
    store, path = store_of(folder)
    written = f"{path}/{uuid.uuid4().hex}.part"
    with store.open_output_stream(written) as out, pa.ipc.new_file(out, _FILE) as file:
        file.write_table(tree.table())
    store.move(written, f"{path}/{number}.arrow")


def read_tree(store: pa.fs.FileSystem, path: str, number: int, bins: int) -> Tree:
    with store.open_input_file(f"{path}/{number}.arrow") as file:
        return Tree.of(pa.ipc.open_file(file).read_all(), bins)


def full_path(spark: SparkSession, folder: str) -> str:
    """``folder`` with its file system, as ``pyarrow.fs`` names it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return found.removeprefix("file:") if not found.startswith("file://") else found


class ForestTree:
    """One tree of a model, read when it is looked at."""

    def __init__(self, model: ForestModel, number: int):
        self.model, self.number = model, number

    @property
    def _tree(self) -> Tree:
        store, path = store_of(self.model.folder)
        return read_tree(store, path, self.number, self.model.shape.bins)

    @property
    def depth(self) -> int:
        return self._tree.depth

    @property
    def numNodes(self) -> int:
        return self.model.sizes[self.number]

    def predictLeaf(self, features: Vector) -> float:
        return float(self._tree.leaves_of(self.model.shape.of(features.toArray()[None]))[0])

    @property
    def toDebugString(self) -> str:
        tree, lines, shape = self._tree, [], self.model.shape
        stack = [(0, 1, "")]
        while stack:
            at, indent, lead = stack.pop()
            if lead:
                lines.append(" " * indent + lead)
                indent += 1
            f = int(tree.feature[at])
            if f < 0:
                w = (int(tree.n0[at]), int(tree.n1[at])) * self.model.class_weights[self.number]
                lines.append(" " * indent + f"Predict: {float(w[1] > w[0])}")
                continue
            if shape.arity[f]:
                lefts = tree.lefts[tree.named[at]][:shape.arity[f]]
                yes, no = ("in {" + ",".join(f"{float(c)}" for c in np.flatnonzero(side)) + "}" for side in (lefts, ~lefts))
            else:
                yes, no = (f"{sign} {float(shape.cuts[f][tree.cut[at]])}" for sign in ("<=", ">"))
            left = int(tree.left[at])
            stack += [(left + 1, indent, f"Else (feature {f} {no})"), (left, indent, f"If (feature {f} {yes})")]
        return "\n".join(lines) + "\n"


class ForestModel(Model, MLReadable, MLWritable):
    """A binary classifier over the files of ``folder``, one a tree that drew rows (the others have no ``sizes`` and no vote).

    ``class_weights``: weights of a draw of both classes, by tree; ``featureImportances`` as MLlib's.
    """

    def __init__(self, folder: str = "", shape: Bins | None = None, class_weights: np.ndarray | None = None,
                 sizes: list[int] | None = None, importances: np.ndarray | None = None):
        super().__init__()
        self.folder, self.shape, self.class_weights, self.sizes, self.importances = folder, shape, class_weights, sizes, importances

    @property
    def getNumTrees(self) -> int:
        return len(self.sizes)

    @property
    def treeWeights(self) -> list[float]:
        return [1.0] * len(self.sizes)

    @property
    def totalNumNodes(self) -> int:
        return sum(self.sizes)

    @property
    def trees(self) -> list[ForestTree]:
        return [ForestTree(self, t) for t, size in enumerate(self.sizes) if size]

    @property
    def numFeatures(self) -> int:
        return len(self.shape.arity)

    @property
    def numClasses(self) -> int:
        return 2

    @property
    def featureImportances(self) -> DenseVector:
        return Vectors.dense(self.importances)

    @property
    def toDebugString(self) -> str:
        head = f"ForestModel: uid={self.uid}, numTrees={self.getNumTrees}, numClasses=2, numFeatures={self.numFeatures}\n"
        return head + "".join(f"  Tree {t.number} (weight 1.0):\n{t.toDebugString}" for t in self.trees)

    def predictRaw(self, features: Vector) -> DenseVector:
        return Vectors.dense(self._votes(self.shape.of(features.toArray()[None]))[0])

    def predictProbability(self, features: Vector) -> DenseVector:
        raw = self.predictRaw(features).toArray()
        return Vectors.dense(raw / raw.sum() if raw.sum() else raw)

    def predict(self, features: Vector) -> float:
        raw = self.predictRaw(features)
        return float(raw[1] > raw[0])

    def _votes(self, bins: np.ndarray) -> np.ndarray:
        return _votes(bins, self.folder, self.shape, self.class_weights, self.sizes)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        folder, shape, weights, sizes = self.folder, self.shape, self.class_weights, self.sizes

        @F.arrow_udf("array<double>")
        def votes(features: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for bins in _chunks(features, shape):
                found = _votes(bins, folder, shape, weights, sizes)
                yield pa.ListArray.from_arrays(pa.array(np.arange(0, found.size + 1, 2), pa.int32()), pa.array(found.ravel()))

        both = F.col("_votes")[0] + F.col("_votes")[1]
        chances = F.when(both == 0, F.col("_votes")).otherwise(F.transform("_votes", lambda v: v / both))
        return dataset.withColumn("_votes", votes(vector_to_array("features"))).withColumns({
            "rawPrediction": array_to_vector("_votes"), "probability": array_to_vector(chances),
            "prediction": (F.col("_votes")[1] > F.col("_votes")[0]).cast("double")}).drop("_votes")

    def write(self):
        return _ForestWriter(self)

    @classmethod
    def read(cls):
        return _ForestReader()


def _chunks(features: Iterator[pa.Array], shape: Bins) -> Iterator[np.ndarray]:
    """The bins of all rows, ``SCORE_ROWS`` at a time."""
    held, rows = [], 0
    for batch in features:
        for start in range(0, len(batch), SCORE_ROWS):
            x = batch.slice(start, SCORE_ROWS).flatten().to_numpy().reshape(-1, len(shape.arity))
            if rows + len(x) > SCORE_ROWS:
                yield np.concatenate(held)
                held, rows = [], 0
            held.append(shape.of(x))
            rows += len(x)
    if held:
        yield np.concatenate(held)


def _votes(bins: np.ndarray, folder: str, shape: Bins, class_weights: np.ndarray, sizes: list[int]) -> np.ndarray:
    """By row, the sums of the shares of both classes in the leaves it ends in."""
    store, path = store_of(folder)
    votes = np.zeros((len(bins), 2))
    for t, size in enumerate(sizes):
        if size:
            tree = read_tree(store, path, t, shape.bins)
            leaf, of = np.unique(tree.leaves_of(bins), return_inverse=True) if len(bins) < size else (np.arange(size), tree.leaves_of(bins))
            weights = np.stack([tree.n0[leaf], tree.n1[leaf]], axis=1) * class_weights[t]
            whole = weights.sum(axis=1, keepdims=True)
            votes += (weights / np.where(whole > 0, whole, 1))[of]
    return votes


class _ForestWriter(MLWriter):
    def __init__(self, instance: ForestModel):
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        model, spark = self.instance, self.sparkSession
        state = {"cuts": [c.tolist() for c in model.shape.cuts], "arity": model.shape.arity.tolist(), "bins": model.shape.bins,
                 "class_weights": model.class_weights.tolist(), "sizes": model.sizes, "importances": model.importances.tolist()}
        DefaultParamsWriter.saveMetadata(model, path, spark, extraMetadata={"forest": state})
        source, target = model.folder, full_path(spark, f"{path}/trees")
        store, to = store_of(target)
        store.create_dir(to, recursive=True)

        def copied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            (from_store, at), (to_store, to) = store_of(source), store_of(target)
            for batch in batches:
                for t in batch.column("id").to_pylist():
                    part = f"{to}/{uuid.uuid4().hex}.part"
                    with from_store.open_input_stream(f"{at}/{t}.arrow") as file, to_store.open_output_stream(part) as out:
                        while data := file.read(1 << 20):
                            out.write(data)
                    to_store.move(part, f"{to}/{t}.arrow")
                yield batch

        numbers = [(t,) for t, size in enumerate(model.sizes) if size]
        spread = min(max(len(numbers), 1), spark.sparkContext.defaultParallelism)
        spark.createDataFrame(numbers, "id long").repartition(spread).mapInArrow(copied, "id long").collect()  # one row a tree


class _ForestReader(MLReader):
    def load(self, path: str) -> ForestModel:
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        state = metadata["forest"]
        shape = Bins([np.array(c, float) for c in state["cuts"]], np.array(state["arity"], np.int64), state["bins"])
        model = ForestModel(full_path(self.sparkSession, f"{path}/trees"), shape, np.array(state["class_weights"], float).reshape(-1, 2),
                            state["sizes"], np.array(state["importances"], float))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
