from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tillroll.operators import sampling
from tillroll.plans import model
from tillroll.plans.features import scoring_features


@pytest.fixture(scope="module")
def parts(skewed_labelled):
    """The label shows in the amounts and in one code."""
    planted = skewed_labelled.withColumn("amount", F.col("amount") + 60 * F.col("gender")).withColumn(
        "mcc_code", F.when((F.col("gender") == 1) & (F.col("trans_type") == 1020), 763).otherwise(F.col("mcc_code"))
    )
    rest, held = sampling.holdout(planted, 10)
    return scoring_features(rest).cache(), scoring_features(held).cache()


def test_boosted_trees_find_the_signal(parts):
    known, unknown = parts
    fitted = model.fit_boosted(known, iterations=4, rate=0.1, depth=3, validation_share=0.25)
    scored = model.scored_by_boosted(fitted, unknown)
    assert scored.columns == ["client_id", "probability", "gender"]
    assert scored.count() == unknown.count()
    ends = scored.agg(F.min("probability"), F.max("probability")).first()
    assert 0 <= ends[0] <= ends[1] <= 1
    assert model.auc(scored) > 0.6
    unlabelled = model.scored_by_boosted(fitted, unknown.drop("gender"))
    assert unlabelled.columns == ["client_id", "probability"]


def test_forest_predicts_classes(parts):
    known, unknown = parts
    predicted = model.predicted_by_forest(model.fit_forest(known, trees=4, depth=4), unknown)
    assert {r[0] for r in predicted.select("prediction").distinct().collect()} <= {0.0, 1.0}
    assert model.auc(predicted, "prediction") > 0.55


def test_validation_keeps_clients_together(parts):
    flagged = model.with_validation_flag(parts[0], 0.3)
    sides = flagged.groupBy("client_id").agg(F.count_distinct("is_validation").alias("n"))
    assert sides.filter("n > 1").isEmpty()


def test_numbers_are_finite(spark):
    df = spark.createDataFrame(
        [(1, 5992, 1, "a", 1, float("inf")), (2, None, 1, None, None, None)],
        "client_id long, mcc_code int, trans_type int, trans_city string, mcc_describe int, x double",
    )
    rows = model.prepared(df).orderBy("client_id").collect()
    assert rows[0]["x"] == 1.0e12 and rows[1]["x"] == -1.0e12
    assert rows[1]["mcc_code"] == "missing" and rows[0]["mcc_code"] == "5992"
