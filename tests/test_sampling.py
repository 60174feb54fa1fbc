from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

from tillroll.operators import sampling


def counted(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_size_and_determinism(skewed_labelled):
    first = sampling.exact_sample(skewed_labelled, 700, ["gender"], seed=3)
    assert {tuple(r) for r in first.groupBy("gender").count().collect()} == {(0, 700), (1, 700)}
    again = sampling.exact_sample(skewed_labelled.repartition(7), 700, ["gender"], seed=3)
    assert counted(first) == counted(again)
    other = sampling.exact_sample(skewed_labelled, 700, ["gender"], seed=4)
    assert counted(first) != counted(other)


def test_no_row_is_taken_more_often_than_it_occurs(skewed_labelled):
    sample = sampling.exact_sample(skewed_labelled, 1500, seed=1)
    assert sample.count() == 1500
    assert sample.exceptAll(skewed_labelled).isEmpty()


@pytest.mark.parametrize("n", [1, 999, 1000, 1001, 1003])
def test_cut_inside_copies(spark, n, monkeypatch):
    """A third of the rows, or more, are one row."""
    df = spark.range(0, 3).select(F.lit(5).alias("a")).union(spark.range(0, 1000).select(F.lit(6).alias("a")))
    monkeypatch.setattr(sampling, "COPIES_PER_ROW", 64)
    assert sampling.exact_sample(df, n, seed=2).count() == n


def test_whole_table(spark):
    df = spark.range(100)
    assert counted(sampling.exact_sample(df, 100)) == counted(df)


def test_too_few_rows(skewed_labelled):
    with pytest.raises(ValueError, match="fewer than"):
        sampling.exact_sample(skewed_labelled, 10_000, ["gender"])


def test_rows_without_class_drop_out(spark):
    df = spark.createDataFrame([(1, 0), (2, 0), (3, None), (4, 1), (5, 1)], "x int, gender int")
    assert sampling.balanced_sample(df, 2).count() == 4


@pytest.mark.parametrize("per_gender", [False, True])
def test_holdout(skewed_labelled, per_gender):
    rest, held = sampling.holdout(skewed_labelled, 9, per_gender)
    inside = {r[0] for r in held.select("client_id").distinct().collect()}
    outside = {r[0] for r in rest.select("client_id").distinct().collect()}
    assert not inside & outside and len(inside) == (18 if per_gender else 9)
    assert rest.count() + held.count() == skewed_labelled.count()
    if per_gender:
        assert {r["count"] for r in sampling.client_list(held).groupBy("gender").count().collect()} == {9}


@pytest.mark.parametrize("edge_rows", [0, 3, 10**6])
def test_parts_are_complements_at_any_edge(skewed_labelled, edge_rows):
    """With few rows allowed at the edge, further digits of the draw are looked at."""
    rest, want = skewed_labelled.count(), counted(sampling.exact_sample(skewed_labelled, 700, ["gender"], seed=5))
    taken, left = sampling.exact_parts(skewed_labelled, 700, ["gender"], seed=5, edge_rows=edge_rows)
    assert counted(taken) == want and left.count() == rest - 1400
    assert sampling.bag_difference(taken.unionByName(left), skewed_labelled).first()[:] == (0, 0)


def test_many_groups(spark):
    """More groups than any driver list would hold, each drawn exactly."""
    df = spark.range(60_000).select((F.col("id") % 20_000).alias("g"), F.col("id").alias("x"))
    sample = sampling.exact_sample(df, 2, ["g"])
    assert sample.groupBy("g").count().filter("count != 2").isEmpty() and sample.count() == 40_000


def test_smallest_class_gives_the_size(skewed_labelled):
    smaller = min(r["count"] for r in skewed_labelled.groupBy("gender").count().collect())
    assert {r["count"] for r in sampling.balanced_sample(skewed_labelled).groupBy("gender").count().collect()} == {smaller}


def test_nothing_and_empty(spark, skewed_labelled):
    taken, left = sampling.exact_parts(skewed_labelled, 0)
    assert taken.isEmpty() and left.count() == skewed_labelled.count()
    taken, left = sampling.exact_parts(skewed_labelled.limit(0), 0)
    assert taken.isEmpty() and left.isEmpty()
    assert sampling.balanced_sample(skewed_labelled.limit(0)).isEmpty()
    with pytest.raises(ValueError, match="fewer than"):
        sampling.exact_sample(skewed_labelled.limit(0), 1)


@pytest.mark.parametrize("n", [7, 10, 64, 1003])
def test_row_split(spark, skewed_labelled, n):
    rows = skewed_labelled.limit(n).cache()
    train, test = sampling.row_split(rows)
    assert test.count() == math.ceil(0.3 * n) and train.count() == n - test.count()
    assert sampling.bag_difference(train.unionByName(test), rows).first()[:] == (0, 0)
    again = sampling.row_split(rows.repartition(5))
    assert counted(train) == counted(again[0]) and counted(test) == counted(again[1])


def test_bag_difference(spark):
    a, b = (spark.createDataFrame([(x, "s") for x in xs], "x int, y string") for xs in ([1, 1, 2, 3], [1, 2, 2, 2, None]))
    assert sampling.bag_difference(a, b.select("y", "x")).first()[:] == (2, 3)
    assert sampling.bag_difference(a.limit(0), b.limit(0)).first()[:] == (0, 0)
