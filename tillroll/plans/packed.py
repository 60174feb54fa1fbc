"""Boosted trees grown over packed bins: one byte a feature, sums of a level's nodes in one job, Spark's model at the end.

The algorithm is that of Spark's gradient boosting for two classes over plain numbers: borders between at most 32 bins from a sample of
10,000 rows (of all rows where there are fewer), variance of the residuals, no least gain, the first tree at weight 1 on the labels
-1 and 1. What differs is what a tree costs. Rows are packed once, two features in one number, and stay in blocks; only the smaller child
of a split is summed, the other is the parent less its sibling; a block's margins are carried on, so further trees cost what
the first ones did. The driver holds the sums of one level: at most 2^(depth - 2) nodes of 32 bins for each feature.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.linalg import DenseVector
from pyspark.serializers import BatchedSerializer, CPickleSerializer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.lineage import drop, new_path

BINS = 32
#: Rows in the sample that the borders come from, as in Spark.
SAMPLE_ROWS = max(BINS * BINS, 10_000)
#: Rows of a block at least (fewer blocks than cores where rows are few), and at most.
LEAST_ROWS, MOST_ROWS = 1 << 17, 1 << 19
#: Margins are written anew after so many trees, and cut off from what they came from after so many writings.
MARGINS_EVERY, CHECKPOINT_EVERY = 5, 8
#: Gains below this share of the squared sum are noise of the last bits.
NOISE = 1e-13
#: Sums of more blocks than this are added on the way to the driver.
MANY_BLOCKS = 64


def borders_of(df: DataFrame, values: Column, seed: int) -> list[np.ndarray]:
    """Borders between the bins of each feature of an array column; a value at a border belongs below it."""
    rows, n = df.select(values.alias("x")), df.count()
    sample = rows.sample(SAMPLE_ROWS / n, seed) if n > SAMPLE_ROWS else rows
    found = sample.toArrow().column("x").combine_chunks()
    if not len(found):
        return []
    return [_borders(x) for x in found.flatten().to_numpy(zero_copy_only=False).reshape(len(found), -1).T]


def _borders(x: np.ndarray) -> np.ndarray:
    """Midpoints between values: all of them, or those nearest to equal shares of the rows."""
    value, count = np.unique(x, return_counts=True)
    middle = (value[:-1] + value[1:]) / 2
    if len(middle) < BINS:
        return middle
    seen, stride, picked = np.cumsum(count), len(x) / BINS, []
    target = stride
    for k in range(1, len(value)):
        if abs(seen[k - 1] - target) < abs(seen[k] - target):
            picked.append(k - 1)
            target += stride
    return middle[picked]


def with_bins(df: DataFrame, values: Column, borders: list[np.ndarray], kept: Sequence[str], name: str = "bins") -> DataFrame:
    """``kept`` and the bins of an array column, one byte each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column("_x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                if np.isnan(x).any():
                    raise ValueError("a feature is missing")
                bins = np.stack([np.searchsorted(b, c) for b, c in zip(borders, x.T, strict=True)], axis=1).astype(np.uint8)
                data = pa.FixedSizeBinaryArray.from_buffers(pa.binary(len(borders)), len(bins), [None, pa.py_buffer(bins.tobytes())])
                yield pa.record_batch([*(batch.column(c) for c in kept), data.cast(pa.binary())], [*kept, name])

    types = dict(df.dtypes)
    ddl = ", ".join([*(f"`{c}` {types[c]}" for c in kept), f"`{name}` binary"])
    return df.select(*kept, values.alias("_x")).mapInArrow(pack, ddl)


class Grown:
    """A tree by heap numbers (the children of k are 2k + 1 and 2k + 2); -1 is the feature of a leaf."""

    def __init__(self, depth: int) -> None:
        size = 2 ** (depth + 1) - 1
        self.feature, self.cut = np.full(size, -1), np.zeros(size, np.int64)
        self.count, self.total, self.gain = np.zeros(size, np.int64), np.zeros(size), np.zeros(size)

    def value(self, node: int) -> float:
        return self.total[node] / max(self.count[node], 1)

    def leaves(self, joint: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """The rows of each leaf."""
        open_ = [(0, np.arange(joint.shape[1]))]
        while open_:
            node, rows = open_.pop()
            feature = self.feature[node]
            if feature < 0:
                yield node, rows
                continue
            pair = joint[feature // 2][rows]
            right = (pair % BINS if feature % 2 else pair // BINS) > self.cut[node]
            open_ += [(2 * node + 1, rows[~right]), (2 * node + 2, rows[right])]

    def preorder(self, node: int = 0) -> Iterator[int]:
        yield node
        if self.feature[node] >= 0:
            yield from self.preorder(2 * node + 1)
            yield from self.preorder(2 * node + 2)


def moved(joint: np.ndarray, margin: np.ndarray, trees: Sequence[tuple[Grown, float]]) -> np.ndarray:
    """The margins after further trees."""
    margin = margin.copy()
    for tree, weight in trees:
        for node, rows in tree.leaves(joint):
            margin[rows] += weight * tree.value(node)
    return margin


def level_sums(joint: np.ndarray, target: np.ndarray, tree: Grown, nodes: Sequence[int]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and summed target for each of ``nodes`` (leaves so far), feature and bin."""
    place = {node: k for k, node in enumerate(nodes)}
    own = [(place[node], rows) for node, rows in tree.leaves(joint) if node in place]
    rows = np.concatenate([r for _, r in own])
    base = np.repeat([k * BINS * BINS for k, _ in own], [len(r) for _, r in own])
    weight, size = target[rows], len(nodes) * BINS * BINS
    out = [np.empty((len(nodes), 2 * len(joint), BINS), kind) for kind in (np.int64, np.float64)]
    for pair, column in enumerate(joint):
        at = base + column[rows]
        for part, found in zip(out, (np.bincount(at, minlength=size), np.bincount(at, weight, size)), strict=True):
            cells = found.reshape(len(nodes), BINS, BINS)
            part[:, 2 * pair], part[:, 2 * pair + 1] = cells.sum(axis=2), cells.sum(axis=1)
    return out[0], out[1]


def best_split(count: np.ndarray, total: np.ndarray) -> tuple[float, int, int] | None:
    """Gain a row, feature and last bin of the left side of the first best split of a node, from its sums by feature and bin."""
    n, s = count[0].sum(), total[0].sum()
    left_n, left_s = np.cumsum(count, axis=1)[:, :-1], np.cumsum(total, axis=1)[:, :-1]
    right_n, right_s = n - left_n, s - left_s
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = left_s**2 / left_n + right_s**2 / right_n - s**2 / n
    gain[(left_n == 0) | (right_n == 0)] = -np.inf
    feature, cut = np.unravel_index(np.argmax(gain), gain.shape)
    found = gain[feature, cut]
    return (found / n, int(feature), int(cut)) if found > NOISE * (s**2 / n + 1e-300) else None


class Grower:
    """Trees over ``rows`` (a label of 0 or 1 and ``bins``, see ``with_bins``), as many as are asked for, at any time more."""

    def __init__(self, rows: DataFrame, label: str, borders: list[np.ndarray], rate: float, depth: int) -> None:
        self.spark, self.borders, self.rate, self.depth = rows.sparkSession, borders, rate, depth
        self.trees: list[Grown] = []
        self._since: list[tuple[Grown, float]] = []
        self._writings, self._file = 0, None
        data = rows.select(F.col(label).cast("double").alias("label"), "bins")
        n, cores = data.count(), self.spark.sparkContext.defaultParallelism
        if not n:
            raise ValueError("no rows to learn from")
        parts = max(min(cores, 1 + n // LEAST_ROWS), 1 + n // MOST_ROWS)
        width = len(borders)

        def block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            label, bins = [], []
            for batch in batches:
                label.append(batch.column("label").to_numpy(zero_copy_only=False))
                bins.append(np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(-1, width))
            if label and sum(map(len, label)):
                if np.isnan(np.concatenate(label)).any():
                    raise ValueError("a label is missing")
                each = np.concatenate(bins).T.astype(np.uint16)
                odd = each[1::2] if width % 2 == 0 else np.concatenate([each[1::2], np.zeros_like(each[:1])])
                sign = np.where(np.concatenate(label) > 0, 1, -1).astype(np.int8)
                yield pa.record_batch([pa.array([(each[::2] * BINS + odd).tobytes()]), pa.array([sign.tobytes()])], ["joint", "sign"])

        dealt = data.repartition(parts).mapInArrow(block, "joint binary, sign binary").rdd

        def arrays(row) -> tuple[np.ndarray, np.ndarray]:
            sign = np.frombuffer(row["sign"], np.int8)
            return np.frombuffer(row["joint"], np.uint16).reshape(-1, len(sign)), sign

        self._blocks = _one_by_one(dealt.map(arrays)).persist(StorageLevel.MEMORY_AND_DISK)
        self._margins = _one_by_one(self._blocks.map(lambda b: np.zeros(len(b[1])))).persist(StorageLevel.MEMORY_AND_DISK)
        self._many = parts > MANY_BLOCKS

    def grow(self, trees: int) -> None:
        for _ in range(trees):
            if len(self._since) == MARGINS_EVERY:
                self._write_margins()
            tree = self._tree()
            self._since.append((tree, self.rate if self.trees else 1.0))
            self.trees.append(tree)

    def close(self) -> None:
        for kept in (self._blocks, self._margins):
            kept.unpersist()
        self._drop_file()

    def _drop_file(self) -> None:
        if self._file:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(self._file)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        self._file = None

    def _write_margins(self) -> None:
        since, old = self._since, self._margins
        new = _one_by_one(self._blocks.zip(old).map(lambda x: moved(x[0][0], x[1], since))).persist(StorageLevel.MEMORY_AND_DISK)
        self._writings += 1
        last = self._writings % CHECKPOINT_EVERY == 0
        if last:
            new.checkpoint()
        new.count()
        old.unpersist()
        if last:
            self._drop_file()
            self._file = new.getCheckpointFile()
        self._margins, self._since = new, []

    def _sums(self, tree: Grown, nodes: list[int]) -> tuple[np.ndarray, np.ndarray]:
        since, first = self._since, not self.trees

        def part(x: tuple) -> tuple[np.ndarray, np.ndarray]:
            (joint, sign), margin = x
            target = sign.astype(float) if first else 4 * sign / (1 + np.exp(2 * sign * moved(joint, margin, since)))
            return level_sums(joint, target, tree, nodes)

        def added(a: tuple, b: tuple) -> tuple[np.ndarray, np.ndarray]:
            return a[0] + b[0], a[1] + b[1]

        parts = self._blocks.zip(self._margins).map(part)
        return parts.treeReduce(added, 2) if self._many else _folded(parts.collect(), added)

    def _tree(self) -> Grown:
        tree, width, open_ = Grown(self.depth), len(self.borders), [0]
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        count, total = self._sums(tree, [0])
        held[0] = count[0, :width], total[0, :width]
        tree.count[0], tree.total[0] = held[0][0][0].sum(), held[0][1][0].sum()
        for level in range(self.depth):
            split = []
            for node in open_:
                count, total = held[node]
                found = best_split(count, total)
                if found is None:
                    continue
                gain, feature, cut = found
                tree.feature[node], tree.cut[node], tree.gain[node] = feature, cut, gain
                left, right = 2 * node + 1, 2 * node + 2
                tree.count[left], tree.total[left] = count[feature, : cut + 1].sum(), total[feature, : cut + 1].sum()
                tree.count[right], tree.total[right] = tree.count[node] - tree.count[left], total[feature, cut + 1 :].sum()
                split.append(node)
            if not split or level == self.depth - 1:
                break
            small = [2 * k + 1 if tree.count[2 * k + 1] <= tree.count[2 * k + 2] else 2 * k + 2 for k in split]
            counts, totals = self._sums(tree, small)
            below = {}
            for k, (node, own) in enumerate(zip(split, small, strict=True)):
                other = 4 * node + 3 - own
                below[own] = counts[k, :width], totals[k, :width]
                rest = held[node][0] - below[own][0]
                below[other] = rest, np.where(rest > 0, held[node][1] - below[own][1], 0.0)
            held, open_ = below, sorted(k for k in below if tree.count[k] > 1)
        return tree

    def weights(self) -> list[float]:
        return [1.0] + [self.rate] * (len(self.trees) - 1)

    def threshold(self, tree: Grown, node: int) -> float:
        return float(self.borders[tree.feature[node]][tree.cut[node]])

    def model(self, label: str, features: str, seed: int, size: int) -> GBTClassificationModel:
        """The first ``size`` trees as Spark's model, by way of its files: a fit of one leaf gives the form, its nodes are replaced.

        Nodes hold count, sum and gain of the residuals; the sum of squares is given as that of the means.
        """
        spark, wide = self.spark, len(self.borders)
        two = spark.createDataFrame([(float(y), DenseVector([0.0] * wide)) for y in (0, 1)], [label, features])
        learner = GBTClassifier(labelCol=label, featuresCol=features, maxIter=1, stepSize=self.rate, maxDepth=self.depth, seed=seed)
        form, out = new_path(spark, "form"), new_path(spark, "trees")
        learner.fit(two).write().save(form)
        said = json.loads(spark.read.text(f"{form}/metadata").first()[0])
        said["numTrees"] = size
        said["paramMap"]["maxIter"] = max(size, 1)
        spark.createDataFrame([(json.dumps(said),)], "value string").coalesce(1).write.text(f"{out}/metadata")
        heads = spark.read.parquet(f"{form}/treesMetadata")
        head = heads.first()
        listed = [(k, head[1], w) for k, w in enumerate(self.weights()[:size])]
        spark.createDataFrame(listed, heads.schema).coalesce(1).write.parquet(f"{out}/treesMetadata")
        nodes = [row for k, tree in enumerate(self.trees[:size]) for row in self._nodes(k, tree)]
        spark.createDataFrame(nodes, spark.read.parquet(f"{form}/data").schema).coalesce(1).write.parquet(f"{out}/data")
        model = GBTClassificationModel.load(out)
        for path in (form, out):
            drop(spark, path)
        return model

    def _nodes(self, number: int, tree: Grown) -> Iterator[tuple]:
        order = {node: k for k, node in enumerate(tree.preorder())}
        for node, k in order.items():
            n, value = int(tree.count[node]), float(tree.value(node))
            inner = tree.feature[node] >= 0
            split = (int(tree.feature[node]), [self.threshold(tree, node)], -1) if inner else (-1, [], -1)
            children = (order[2 * node + 1], order[2 * node + 2]) if inner else (-1, -1)
            gain = float(tree.gain[node]) if inner else -1.0
            yield (number, (k, value, 0.0, [float(n), value * n, value * value * n], n, gain, *children, split))


def _one_by_one(rdd: RDD) -> RDD:
    """Each element by itself on its way between Python and the JVM, so that two such tables can be zipped as they are."""
    return rdd._reserialize(BatchedSerializer(CPickleSerializer(), 1))


def _folded(parts: list, added) -> tuple:
    out = parts[0]
    for part in parts[1:]:
        out = added(out, part)
    return out


def has_categories(df: DataFrame, features: str) -> bool:
    """Whether the vector column says that some of its features are categories."""
    return "nominal" in df.schema[features].metadata.get("ml_attr", {}).get("attrs", {})
