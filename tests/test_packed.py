from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tillroll.operators import lineage
from tillroll.plans import boosting, packed


@pytest.fixture(scope="module")
def data(spark):
    """Three features, so that the last pair is padded: two of many values, one of six. A part of the label is noise."""
    noise = lambda k: F.pmod(F.hash("id", F.lit(k)), F.lit(1000)) / 1000.0
    rows = spark.range(0, 1600, 1, 4).select(
        "id", noise(1).alias("a"), noise(2).alias("b"), F.pmod(F.hash("id", F.lit(3)), F.lit(6)).cast("double").alias("c"),
        (F.col("id") % 2 == 0).alias("held"),
    )
    planted = F.col("a") + 0.5 * F.col("c").isin(1.0, 4.0).cast("int") + 0.6 * noise(4) > 1.1
    rows = rows.withColumn("y", planted.cast("double"))
    return VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows).select("id", "held", "y", "features").cache()


def grower_of(rows, rate, depth):
    values = vector_to_array("features")
    borders = packed.borders_of(rows, values, 5)
    return packed.Grower(packed.with_bins(rows, values, borders, ["y"]), "y", borders, rate, depth)


def test_trees_are_those_of_one_spark_fit(spark, data, monkeypatch):
    """In several blocks, in two rounds, with margins written and cut off in between; the model goes through Spark's files."""
    for name, value in (("LEAST_ROWS", 300), ("MARGINS_EVERY", 2), ("CHECKPOINT_EVERY", 2), ("MANY_BLOCKS", 2)):
        monkeypatch.setattr(packed, name, value)
    known = data.filter("NOT held")
    fitted = GBTClassifier(labelCol="y", maxIter=11, stepSize=0.3, maxDepth=4, seed=5).fit(known)
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    grower = grower_of(known, 0.3, 4)
    assert grower._blocks.count() > 2
    grower.grow(4)
    grower.grow(7)
    got = grower.model("y", "features", 5, 11)
    x = np.array([r[0] for r in data.select(vector_to_array("features")).collect()])
    want = boosting.margins(boosting.trees_of(fitted), x)
    assert boosting.margins(boosting.trees_of(got), x) == pytest.approx(want, abs=1e-9)
    assert boosting.margins(boosting.grown(grower), x, after=3) == pytest.approx(want[:, 3:], abs=1e-9)
    assert got.treeWeights == pytest.approx(fitted.treeWeights) and got.numFeatures == fitted.numFeatures
    scored = [[r["probability"][1] for r in m.transform(data).orderBy("id").collect()] for m in (got, fitted)]
    assert scored[0] == pytest.approx(scored[1], abs=1e-9)
    assert grower.model("y", "features", 5, 3).treeWeights == got.treeWeights[:3]
    grower.close()
    assert grower._file is None and spark.sparkContext._jsc.getPersistentRDDs().size() <= cached
    assert not [p for p in lineage._handed_out if "/form-" in p]


def test_further_rounds_refit_nothing(data, monkeypatch):
    """Numbers are never handed to Spark's fit of one more tree, however many rounds there are."""
    monkeypatch.setattr(boosting, "resumed", None)
    model, stop = boosting.fit_with_patience(data, "y", "held", 11, 0.3, 2, 5, patience=3, metric="loss")
    curve = {r["iteration"]: r["loss"] for r in boosting.validation_curve(model, data.filter("held"), "y").collect()}
    assert stop.at > 4 and len(model.treeWeights) == stop.best and curve[stop.best] == pytest.approx(stop.value)


def test_borders_of_few_and_many_values():
    assert packed._borders(np.array([1.0, 3.0, 3.0, 8.0])).tolist() == [2.0, 5.5]
    assert packed._borders(np.full(9, 4.0)).tolist() == []
    many = packed._borders(np.arange(1000.0))
    assert len(many) == packed.BINS - 1 and np.diff(many) == pytest.approx(1000 / packed.BINS, abs=1)


def test_a_constant_target_stays_one_leaf(data):
    grower = grower_of(data.filter("y = 1"), 0.3, 3)
    grower.grow(2)
    assert [len(t.value) for t in boosting.grown(grower)] == [1, 1]
    grower.close()


def test_missing_values_and_no_rows_are_refused(data):
    with pytest.raises(ValueError):
        grower_of(data.limit(0), 0.3, 3)
    with pytest.raises(Exception, match="a label is missing"):
        grower_of(data.withColumn("y", F.when(F.col("id") != 5, F.col("y"))), 0.3, 3).grow(1)
