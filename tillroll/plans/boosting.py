"""Boosted trees beyond one fit: every prefix of an ensemble evaluated in one pass, the best one kept, and training resumed from it.

Margins, loss and residuals are those of Spark's gradient boosting for two classes: labels -1 and 1, log loss, the first tree at weight 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, StorageLevel
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.operators.lineage import drop, new_path, written
from tillroll.operators.ranks import area_of_stretches
from tillroll.plans.packed import Grower, borders_of, has_categories, with_bins

#: Rows are written out after so many further trees, so that neither plan nor lineage grows with the number of trees.
REWRITE_EVERY = 10


@dataclass
class Tree:
    """Arrays over the nodes of a tree; a leaf has feature -1."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    categories: dict[int, np.ndarray]
    weight: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(len(x))
        open_ = [(0, np.arange(len(x)))]
        while open_:
            node, rows = open_.pop()
            feature = self.feature[node]
            if feature < 0:
                out[rows] = self.value[node]
                continue
            values = x[rows, feature]
            goes_left = np.isin(values, self.categories[node]) if node in self.categories else values <= self.threshold[node]
            open_ += [(self.left[node], rows[goes_left]), (self.right[node], rows[~goes_left])]
        return out


def trees_of(model: GBTClassificationModel) -> list[Tree]:
    """The trees as arrays, read from the model's own files: at most 2^(depth + 1) nodes each."""
    spark = SparkSession.active()
    path = new_path(spark, "trees")
    model.write().save(path)
    weights = {r[0]: r[1] for r in spark.read.parquet(f"{path}/treesMetadata").toDF("tree", "metadata", "weight").select("tree", "weight").collect()}
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*").orderBy("treeID", "id").collect()
    by_tree: dict[int, list] = {}
    for n in nodes:
        by_tree.setdefault(n["treeID"], []).append(n)
    out = []
    for k in sorted(by_tree):
        own = by_tree[k]
        leaf = [n["leftChild"] < 0 for n in own]
        listed = {
            n["id"]: np.array(n["split"]["leftCategoriesOrThreshold"])
            for n, is_leaf in zip(own, leaf, strict=True)
            if not is_leaf and n["split"]["numCategories"] >= 0
        }
        out.append(Tree(
            np.array([-1 if is_leaf else n["split"]["featureIndex"] for n, is_leaf in zip(own, leaf, strict=True)]),
            np.array([0.0 if is_leaf or n["id"] in listed else n["split"]["leftCategoriesOrThreshold"][0]
                      for n, is_leaf in zip(own, leaf, strict=True)]),
            np.array([n["leftChild"] for n in own]), np.array([n["rightChild"] for n in own]),
            np.array([n["prediction"] for n in own]), listed, weights[k],
        ))
    return out


def margins(trees: list[Tree], x: np.ndarray, after: int = 0) -> np.ndarray:
    """A row for each row of ``x`` and a column for each prefix of the ensemble of more than ``after`` trees."""
    out = np.empty((len(x), len(trees) - after))
    total = np.zeros(len(x))
    for k, tree in enumerate(trees):
        total = total + tree.weight * tree.predict(x)
        if k >= after:
            out[:, k - after] = total
    return out


#: Rows that are counted together before they leave Python.
COUNTED_ROWS = 1 << 15
#: Rows of a stretch of the order of one prefix's margins, and the most stretches; one task holds the distinct margins of a stretch.
STRETCH_ROWS, MOST_STRETCHES = 1 << 17, 256
#: Rows drawn for each stretch to place the borders between them; the borders only part the work.
DRAWN_ROWS = 128

PACKED_DDL = "iteration int, stretch int, score binary, positive binary, negative binary, loss double"
PACKED = pa.schema([("iteration", pa.int32()), ("stretch", pa.int32()), ("score", pa.binary()), ("positive", pa.binary()),
                    ("negative", pa.binary()), ("loss", pa.float64())])
PARTS_DDL = "iteration int, stretch int, positive long, negative long, twice long, loss double"
PARTS = pa.schema([("iteration", pa.int32()), ("stretch", pa.int32()), ("positive", pa.int64()), ("negative", pa.int64()),
                   ("twice", pa.int64()), ("loss", pa.float64())])


def packed(counts: np.ndarray, most: int) -> bytes:
    """Counts of at most ``most`` in as few bytes each as hold them; their number tells how many these are."""
    return counts.astype(np.min_scalar_type(most)).tobytes()


def unpacked(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(data, np.dtype(f"u{len(data) // size}")).astype(np.int64)


def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features and label of at least ``COUNTED_ROWS`` rows at a time, as far as there are so many."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in batches:
        if batch.num_rows:
            y = batch.column("label").to_numpy(zero_copy_only=False) > 0
            held.append((batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1), y))
        if sum(len(y) for _, y in held) >= COUNTED_ROWS:
            yield tuple(np.concatenate(part) for part in zip(*held, strict=True))
            held = []
    if held:
        yield tuple(np.concatenate(part) for part in zip(*held, strict=True))


def margin_borders(rows: DataFrame, trees: Broadcast, stretches: int, share: float, after: int = 0) -> dict[int, np.ndarray]:
    """For each prefix the margins that part a draw of the rows into so many stretches, about evenly by distinct margins."""

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, _ in arrays(batches):
            for k, margin in enumerate(margins(trees.value, x, after).T, after + 1):
                score = np.unique(margin)
                yield pa.record_batch([pa.array(np.full(len(score), k, np.int32)), pa.array(score)], ["iteration", "score"])

    drawn = rows.sample(share, seed=7).mapInArrow(evaluate, "iteration int, score double")
    shares = F.array(*[F.lit(k / stretches) for k in range(1, stretches)])
    found = drawn.groupBy("iteration").agg(F.percentile_approx("score", shares, F.lit(10 * stretches)).alias("borders")).collect()
    return {r["iteration"]: np.unique(np.array(r["borders"])) for r in found}


def staged_parts(
    model: GBTClassificationModel | list[Tree],
    data: DataFrame,
    label: str,
    features: str = "features",
    after: int = 0,
    stretch_rows: int = STRETCH_ROWS,
) -> DataFrame:
    """For every prefix of more than ``after`` trees and every stretch of the order of its margins: the rows of each class, ``twice``
    (see ``area_of_stretches``) and the summed loss.

    Rows are counted by distinct margin before they leave Python, and shuffled once: the distinct margins of a prefix in a stretch are
    one packed value, of 10 bytes a margin.
    """
    trees = data.sparkSession.sparkContext.broadcast(model if isinstance(model, list) else trees_of(model))
    rows = data.select(vector_to_array(F.col(features)).alias("x"), F.col(label).cast("double").alias("label")).dropna(subset=["label"])
    n = rows.count()
    stretches = min(MOST_STRETCHES, 1 + n // stretch_rows)
    borders = margin_borders(rows, trees, stretches, min(1.0, DRAWN_ROWS * stretches / n), after) if stretches > 1 else {}

    def evaluate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, y in arrays(batches):
            out = []
            for k, margin in enumerate(margins(trees.value, x, after).T, after + 1):
                score, group = np.unique(margin, return_inverse=True)
                positive = np.bincount(group, y, len(score)).astype(np.int64)
                each = np.bincount(group, minlength=len(score))
                loss = 2 * (positive * np.logaddexp(0, -2 * score) + (each - positive) * np.logaddexp(0, 2 * score))
                ends = [0, *np.searchsorted(score, borders.get(k, ()), "right"), len(score)]
                for stretch, (a, b) in enumerate(pairwise(ends)):
                    if a < b:
                        own, most = positive[a:b], int(each[a:b].max())
                        out.append((k, stretch, score[a:b].tobytes(), packed(own, most), packed(each[a:b] - own, most), float(loss[a:b].sum())))
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), PACKED, strict=True)], schema=PACKED)

    def merge(table: pa.Table) -> pa.Table:
        values = [np.frombuffer(s) for s in table.column("score").to_pylist()]
        counts = {c: np.concatenate([unpacked(data, len(s)) for data, s in zip(table.column(c).to_pylist(), values, strict=True)])
                  for c in ("positive", "negative")}
        score, group = np.unique(np.concatenate(values), return_inverse=True)
        positive, negative = (np.bincount(group, counts[c], len(score)).astype(np.int64) for c in ("positive", "negative"))
        twice = int((positive * (2 * (np.cumsum(negative) - negative) + negative)).sum())
        row = (table.column("iteration")[0].as_py(), table.column("stretch")[0].as_py(), int(positive.sum()), int(negative.sum()), twice,
               float(sum(table.column("loss").to_pylist())))
        return pa.table([pa.array([v], f.type) for v, f in zip(row, PARTS, strict=True)], schema=PARTS)

    return rows.mapInArrow(evaluate, PACKED_DDL).groupBy("iteration", "stretch").applyInArrow(merge, PARTS_DDL)


def validation_curve(
    model: GBTClassificationModel | list[Tree],
    data: DataFrame,
    label: str,
    features: str = "features",
    after: int = 0,
    stretch_rows: int = STRETCH_ROWS,
) -> DataFrame:
    """(iteration, n, loss, auc): mean log loss and exact area under the curve after each tree beyond the first ``after``."""
    parts = written(staged_parts(model, data, label, features, after, stretch_rows))  # a row for each prefix and stretch
    losses = parts.groupBy("iteration").agg((F.sum("loss") / F.sum(F.col("positive") + F.col("negative"))).alias("loss"))
    return area_of_stretches(parts, ["iteration"]).join(losses, "iteration").select("iteration", "n", "loss", "auc")


@dataclass(frozen=True)
class Stop:
    """The best number of trees, its value, and the number at which training stops; ``waited`` if patience ran out."""

    best: int
    value: float | None
    at: int
    waited: bool


def early_stop(curve: DataFrame, patience: int, metric: str = "auc") -> Stop:
    """Walks a curve (a row for each tree) until ``patience`` trees have brought no gain. Of equal values the first is the best."""
    return _walk(curve.select("iteration", metric).orderBy("iteration").collect(), patience, metric)


def _walk(rows: list, patience: int, metric: str) -> Stop:
    best, value = 0, None
    for iteration, found in rows:
        better = found is not None and (value is None or (found > value if metric == "auc" else found < value))
        if better:
            best, value = iteration, found
        elif iteration - best >= patience:
            return Stop(best, value, iteration, True)
    return Stop(best, value, rows[-1][0] if rows else 0, False)


def ensemble(model: GBTClassificationModel, trees: list, weights: list[float]) -> GBTClassificationModel:
    """A model like ``model`` with other trees."""
    gateway = SparkSession.active().sparkContext._gateway
    jvm = gateway.jvm.org.apache.spark.ml
    java_trees = gateway.new_array(jvm.regression.DecisionTreeRegressionModel, len(trees))
    java_weights = gateway.new_array(gateway.jvm.double, len(trees))
    for k, (tree, weight) in enumerate(zip(trees, weights, strict=True)):
        java_trees[k], java_weights[k] = tree._java_obj, float(weight)
    old = model._java_obj
    java = jvm.classification.GBTClassificationModel(old.uid(), java_trees, java_weights, old.numFeatures(), 2)
    out = GBTClassificationModel(java)
    out._resetUid(model.uid)
    return model._copyValues(out)


def prefix(model: GBTClassificationModel, size: int) -> GBTClassificationModel:
    """The ensemble of the first ``size`` trees."""
    return ensemble(model, model.trees[:size], model.treeWeights[:size])


def resumed(
    model: GBTClassificationModel, data: DataFrame, label: str, iterations: int, rate: float, depth: int, seed: int
) -> GBTClassificationModel:
    """``iterations`` further trees on what the ensemble (for instance one read from files) leaves unexplained."""
    sign = 2 * F.col("label") - 1
    base = model.transform(data.select(F.col(label).alias("label"), F.col(model.getFeaturesCol()).alias(model.getFeaturesCol())))
    rows = base.select("label", model.getFeaturesCol(), vector_to_array("rawPrediction")[1].alias("margin"))
    learner = DecisionTreeRegressor(featuresCol=model.getFeaturesCol(), labelCol="residual", predictionCol="step", maxDepth=depth, seed=seed)
    trees, weights = list(model.trees), list(model.treeWeights)
    spark, path, copy = data.sparkSession, None, None
    for k in range(iterations):
        if k % REWRITE_EVERY == 0:
            # a tree reads its rows several times, from memory where they fit; the copy before goes when this one is written
            old, path = (path, copy), new_path(spark, "margins")
            rows = copy = written(rows, path).persist(StorageLevel.MEMORY_AND_DISK)
            _forget(spark, *old)
        missing = 4 * sign / (1 + F.exp(2 * sign * F.col("margin")))
        tree = learner.fit(rows.withColumn("residual", missing))
        trees.append(tree)
        weights.append(rate)
        rows = tree.transform(rows).withColumn("margin", F.col("margin") + rate * F.col("step")).drop("step")
    _forget(spark, path, copy)
    return ensemble(model, trees, weights)


def _forget(spark: SparkSession, path: str | None, copy: DataFrame | None) -> None:
    if copy is not None:
        copy.unpersist()
        drop(spark, path)


def fit_with_patience(
    data: DataFrame, label: str, held: str, iterations: int, rate: float, depth: int, seed: int, patience: int, metric: str = "auc"
) -> tuple[GBTClassificationModel, Stop]:
    """Trees until ``patience`` of them bring no gain on the rows marked by ``held``; the best prefix is kept."""
    known, unseen = data.filter(~F.col(held)), written(data.filter(held))
    if has_categories(data, "features"):
        grower = Refitted(known, label, rate, depth, seed, min(2 * patience, iterations))
    else:
        values = vector_to_array("features")
        borders = borders_of(known, values, seed)
        grower = Grower(with_bins(known, values, borders, [label]), label, borders, rate, depth)
    return grown_with_patience(grower, unseen, label, iterations, seed, patience, metric)


class Refitted:
    """What ``Grower`` does, by Spark's own fit and ``resumed``, for features that are categories.

    The first fit has ``first`` trees at least, as trees of one fit cost less than resumed ones.
    """

    def __init__(self, known: DataFrame, label: str, rate: float, depth: int, seed: int, first: int) -> None:
        self.known, self.label, self.rate, self.depth, self.seed, self.first = known, label, rate, depth, seed, first
        self.fitted: GBTClassificationModel | None = None

    def grow(self, trees: int) -> None:
        if self.fitted is None:
            learner = GBTClassifier(labelCol=self.label, maxIter=max(trees, self.first), stepSize=self.rate, maxDepth=self.depth, seed=self.seed)
            self.fitted = learner.fit(self.known)
        else:
            self.fitted = resumed(self.fitted, self.known, self.label, trees, self.rate, self.depth, self.seed)

    def model(self, label: str, features: str, seed: int, size: int) -> GBTClassificationModel:
        return prefix(self.fitted, size)

    def close(self) -> None:
        """Nothing is kept."""


def grown(grower: Grower | Refitted) -> list[Tree]:
    """The trees so far, over the features' own values."""
    if isinstance(grower, Refitted):
        return trees_of(grower.fitted) if grower.fitted else []
    out = []
    for tree, weight in zip(grower.trees, grower.weights(), strict=True):
        order = list(tree.preorder())
        number, inner = {node: k for k, node in enumerate(order)}, tree.feature[order] >= 0
        child = lambda side: np.array([number[2 * k + side] if i else -1 for k, i in zip(order, inner, strict=True)])  # noqa: B023, E731
        out.append(Tree(
            tree.feature[order], np.array([grower.threshold(tree, k) if i else 0.0 for k, i in zip(order, inner, strict=True)]),
            child(1), child(2), np.array([tree.value(k) for k in order]), {}, weight,
        ))
    return out


def grown_with_patience(
    grower: Grower | Refitted, unseen: DataFrame, label: str, iterations: int, seed: int, patience: int, metric: str = "auc"
) -> tuple[GBTClassificationModel, Stop]:
    """``fit_with_patience`` of a grower and held-out vectors.

    The first round has ``patience`` trees and one, as no fewer can be enough, further ones a quarter of ``patience``, so at most so many
    are in vain. Only new prefixes are evaluated.
    """
    curve: list = []
    while True:
        size = len(curve)
        grower.grow(min(1 + patience if not size else max(1, patience // 4), iterations - size))
        found = validation_curve(grown(grower), unseen, label, after=size)
        curve += found.select("iteration", metric).orderBy("iteration").collect()
        stop = _walk(curve, patience, metric)
        # a curve over no rows has no lines
        if stop.waited or len(curve) in (size, iterations):
            break
    model = grower.model(label, "features", seed, max(stop.best, 1))
    grower.close()
    return model, stop
