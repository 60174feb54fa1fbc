from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import functions as F

from tillroll.operators.lineage import new_path
from tillroll.operators.ranks import auc_of
from tillroll.plans import boosting


@pytest.fixture(scope="module")
def data(spark):
    """Noise in which the label shows, the half of it held out; one feature is a category."""
    noise = lambda k: F.pmod(F.hash("id", F.lit(k)), F.lit(1000)) / 1000.0
    rows = spark.range(0, 1600, 1, 4).select(
        "id", noise(1).alias("a"), noise(2).alias("b"), F.pmod(F.hash("id", F.lit(3)), F.lit(6)).cast("string").alias("kind"),
        (F.col("id") % 2 == 0).alias("held"),
    )
    planted = (F.col("a") + 0.5 * (F.col("kind").isin("1", "4")).cast("int") + 0.6 * noise(4) > 1.1)
    rows = rows.withColumn("y", planted.cast("double"))
    indexed = StringIndexer(inputCol="kind", outputCol="kind_index").fit(rows).transform(rows)
    out = VectorAssembler(inputCols=["a", "b", "kind_index"], outputCol="features").transform(indexed)
    return out.select("id", "held", "y", "features").cache()


@pytest.fixture(scope="module")
def fitted(data):
    return GBTClassifier(labelCol="y", maxIter=12, stepSize=0.3, maxDepth=3, seed=5).fit(data.filter("NOT held"))


def test_trees_give_the_margins_of_the_model(data, fitted):
    rows = fitted.transform(data).select("features", "rawPrediction").collect()
    x = np.array([r["features"].toArray() for r in rows])
    trees = boosting.trees_of(fitted)
    assert any(t.categories for t in trees) and len(trees) == 12
    assert boosting.margins(trees, x)[:, -1] == pytest.approx([r["rawPrediction"][1] for r in rows])


def test_curve_against_every_prefix(data, fitted):
    unseen = data.filter("held")
    curve = {r["iteration"]: r for r in boosting.validation_curve(fitted, unseen, "y").collect()}
    assert sorted(curve) == list(range(1, 13)) and {r["n"] for r in curve.values()} == {unseen.count()}
    for size in (1, 5, 12):
        part = boosting.prefix(fitted, size)
        assert part.treeWeights == fitted.treeWeights[:size]
        scored = part.transform(unseen).select("y", F.col("probability"), "rawPrediction").collect()
        loss = sum(2 * math.log1p(math.exp(-2 * (2 * r["y"] - 1) * r["rawPrediction"][1])) for r in scored) / len(scored)
        assert curve[size]["loss"] == pytest.approx(loss)
        pairs = [(a["rawPrediction"][1], b["rawPrediction"][1]) for a in scored if a["y"] == 1 for b in scored if b["y"] == 0]
        # margins of one path sum may differ in the last bit between engines
        won = sum(1 if s > t + 1e-12 else 0.5 if abs(s - t) <= 1e-12 else 0 for s, t in pairs)
        assert curve[size]["auc"] == pytest.approx(won / len(pairs), abs=1e-4)
    from pyspark.ml.functions import vector_to_array

    last = auc_of(fitted.transform(unseen).withColumn("s", vector_to_array("probability")[1]), "s", "y").first()["auc"]
    assert curve[12]["auc"] == pytest.approx(last, abs=1e-6)
    assert fitted.evaluateEachIteration(unseen) == pytest.approx([curve[k]["loss"] for k in range(1, 13)])


def test_stop_waits_for_a_gain(spark):
    values = [0.6, 0.7, 0.69, 0.7, 0.71, 0.5, 0.5, 0.5, 0.9]
    curve = spark.createDataFrame([(i + 1, v, 1 - v) for i, v in enumerate(values)], "iteration int, auc double, loss double")
    assert boosting.early_stop(curve, 3) == boosting.Stop(5, 0.71, 8, True)
    assert boosting.early_stop(curve, 2) == boosting.Stop(2, 0.7, 4, True)
    assert boosting.early_stop(curve, 9) == boosting.Stop(9, 0.9, 9, False)
    assert boosting.early_stop(curve, 3, "loss").best == 5
    assert boosting.early_stop(curve.limit(0), 3) == boosting.Stop(0, None, 0, False)


def test_resuming_from_a_written_prefix_equals_one_fit(spark, data, fitted):
    known = data.filter("NOT held")
    path = new_path(spark, "prefix")
    boosting.prefix(fitted, 5).write().save(path)
    again = boosting.resumed(GBTClassificationModel.load(path), known, "y", 7, 0.3, 3, 5)
    assert again.treeWeights == pytest.approx(fitted.treeWeights)
    want, got = ([r["rawPrediction"][1] for r in m.transform(data).orderBy("id").select("rawPrediction").collect()] for m in (fitted, again))
    assert got == pytest.approx(want, abs=1e-6)


def test_patience_cuts_a_planted_overfit(spark):
    """Labels are noise but for one feature: deep trees learn the noise, and the held-out rows tell."""
    noise = lambda k: F.pmod(F.hash("id", F.lit(k)), F.lit(997)) / 997.0
    rows = spark.range(0, 800, 1, 4).select("id", *[noise(k).alias(f"x{k}") for k in range(4)], (F.col("id") % 2 == 0).alias("held"))
    rows = rows.withColumn("y", ((F.col("x0") > 0.5) != (noise(9) < 0.3)).cast("double"))
    data = VectorAssembler(inputCols=[f"x{k}" for k in range(4)], outputCol="features").transform(rows).cache()
    model, stop = boosting.fit_with_patience(data, "y", "held", 40, 0.5, 5, 3, patience=4, metric="loss")
    assert stop.waited and stop.at - stop.best == 4 and len(model.treeWeights) == stop.best < 20
    curve = {r["iteration"]: r["loss"] for r in boosting.validation_curve(model, data.filter("held"), "y").collect()}
    assert curve[stop.best] == pytest.approx(min(curve.values())) == pytest.approx(stop.value)


def test_curve_in_many_stretches(data, fitted):
    """The borders only part the work: a row for each prefix and stretch, and the same curve."""
    unseen = data.filter("held")
    parts = boosting.staged_parts(fitted, unseen, "y", stretch_rows=100).collect()
    assert 3 < max(p["stretch"] for p in parts) <= 8 and len(parts) <= 12 * 9
    plan = boosting.staged_parts(fitted, unseen, "y", stretch_rows=100)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    one, many = ({r["iteration"]: r for r in boosting.validation_curve(fitted, unseen, "y", stretch_rows=n).collect()} for n in (10**6, 100))
    assert len(one) == len(many) == 12
    for k, r in one.items():
        assert (many[k]["n"], many[k]["auc"]) == (r["n"], r["auc"]) and many[k]["loss"] == pytest.approx(r["loss"])
    later = boosting.validation_curve(fitted, unseen, "y", after=9).collect()
    assert {(r["iteration"], r["auc"]) for r in later} == {(k, one[k]["auc"]) for k in (10, 11, 12)}


def test_curve_without_rows_or_one_class(data, fitted):
    assert boosting.validation_curve(fitted, data.limit(0), "y").count() == 0
    rows = boosting.validation_curve(fitted, data.filter("y = 1"), "y").collect()
    assert len(rows) == 12 and {r["auc"] for r in rows} == {None}


def test_one_fit_where_patience_cannot_end_before_it(data, monkeypatch):
    monkeypatch.setattr(boosting, "resumed", None)
    model, stop = boosting.fit_with_patience(data, "y", "held", 6, 0.3, 2, 5, patience=4)
    assert stop.at in (5, 6) and len(model.treeWeights) == stop.best


def test_resuming_keeps_no_copies(spark, data, fitted, monkeypatch):
    from tillroll.operators import lineage

    monkeypatch.setattr(boosting, "REWRITE_EVERY", 2)
    before = list(lineage._handed_out)
    cached = spark.sparkContext._jsc.getPersistentRDDs().size()
    again = boosting.resumed(boosting.prefix(fitted, 5), data.filter("NOT held"), "y", 5, 0.3, 3, 5)
    assert lineage._handed_out == before and len(again.treeWeights) == 10
    assert spark.sparkContext._jsc.getPersistentRDDs().size() <= cached
