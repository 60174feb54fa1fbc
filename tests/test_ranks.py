from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from tillroll.operators.ranks import auc_of, rank_auc, score_counts, with_stretch


def by_hand(rows):
    """All pairs of a positive and a negative row that have a score."""
    won = total = 0.0
    rows = [r for r in rows if not math.isnan(r[0])]
    for s, y, w in rows:
        for t, z, v in rows:
            if y == 1 and z == 0:
                total += w * v
                won += w * v * (1 if s > t else 0.5 if s == t else 0)
    return won / total if total else None


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    values = [-1e300, -2.5, -0.0, 0.0, 1e-9, 0.25, 0.5, 3.0, float("inf"), float("nan"), float("-inf")]
    out = [(g, rng.choice(values) if rng.random() < 0.6 else rng.gauss(0, 1), rng.randint(0, 1), rng.randint(0, 3)) for g in "ab" for _ in range(150)]
    out += [("one class", 0.3, 1, 1), ("a third alike", 0.5, 0, 1)] + [("a third alike", 0.5, i % 2, 1) for i in range(100)]
    return out


@pytest.mark.parametrize("stretches", [2, 7, 256])
def test_auc_against_all_pairs(spark, rows, stretches):
    df = spark.createDataFrame(rows, "g string, s double, y int, w int").repartition(5)
    want = {g: by_hand([(s, y, 1) for h, s, y, _ in rows if h == g]) for g in {r[0] for r in rows}}
    got = {r["g"]: r["auc"] for r in rank_auc(score_counts(df, "s", "y", ["g"]), ["g"], stretches).collect()}
    assert got == pytest.approx(want)
    whole = rank_auc(score_counts(df.filter("g = 'a'"), "s", "y"), (), stretches).first()
    assert whole["auc"] == pytest.approx(want["a"]) and whole["n"] == sum(g == "a" and not math.isnan(s) for g, s, _, _ in rows)


def test_weights(spark, rows):
    df = spark.createDataFrame(rows, "g string, s double, y int, w int")
    want = by_hand([(s, y, w) for g, s, y, w in rows if g == "b"])
    assert auc_of(df.filter("g = 'b'"), "s", "y", weight=F.col("w")).first()["auc"] == pytest.approx(want)
    half = auc_of(df.filter("g = 'b'"), "s", "y", weight=F.col("w") / 2).first()["auc"]
    assert half == pytest.approx(want)


def test_missing_and_empty(spark):
    df = spark.createDataFrame([(None, 1), (0.1, None), (0.2, 1), (0.1, 0)], "s double, y int")
    assert auc_of(df, "s", "y").first().asDict() == {"n": 2, "n_positive": 1, "auc": 1.0}
    assert auc_of(df.limit(0), "s", "y").first().asDict() == {"n": 0, "n_positive": 0, "auc": None}
    assert auc_of(df.limit(0).withColumn("g", F.lit(1)), "s", "y", ["g"]).collect() == []


def test_no_task_is_sent_the_plan_of_a_subquery(spark):
    counts = spark.range(50).selectExpr("id / 7D AS score", "id % 2 AS positive", "1 - id % 2 AS negative")
    assert "ubquery" not in with_stretch(counts, [])._jdf.queryExecution().executedPlan().toString()
    assert rank_auc(counts.limit(0)).collect() == [(0, 0, None)]
