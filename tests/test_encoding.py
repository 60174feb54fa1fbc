from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from tillroll.operators.encoding import ordered_target_encoding, permutation_place


def by_hand(rows, category, prior=0.5, strength=1.0):
    out = Counter()
    for r in rows:
        earlier = [x for x in rows if x[category] == r[category] and x["place"] < r["place"] and x["label"] is not None]
        value = (sum(x["label"] for x in earlier) + strength * prior) / (len(earlier) + strength)
        out[(*r.asDict().values(), round(value, 12))] += 1
    return out


def test_against_earlier_rows(spark, skewed_labelled):
    names = ["client_id", "trans_time", "mcc_code", "trans_type", "term_id"]
    label = F.when(F.col("trans_type") == 1040, None).otherwise(F.col("gender"))
    df = skewed_labelled.limit(700).select(*names, label.alias("label")).withColumn("place", permutation_place(names, 63)).cache()
    rows = df.collect()
    encoded = ordered_target_encoding(df, ["mcc_code", "term_id"], "label", "place")
    assert encoded.columns == [*df.columns, "mcc_code_target", "term_id_target"]
    for c in ("mcc_code", "term_id"):
        got = Counter((*r[:7], round(r[f"{c}_target"], 12)) for r in encoded.collect())
        assert got == by_hand(rows, c)
    other = ordered_target_encoding(df, ["term_id"], "label", "place", prior=0.2, strength=3.0)
    assert Counter((*r[:7], round(r["term_id_target"], 12)) for r in other.collect()) == by_hand(rows, "term_id", 0.2, 3.0)


def test_own_label_never_counts(spark):
    """A category of one row has the prior, whatever its label; copies of a row don't tell each other theirs."""
    rows = [(i, f"c{i}", i % 2) for i in range(50)] + [(99, "copies", 1)] * 5
    df = spark.createDataFrame(rows, "id int, c string, y int").withColumn("place", permutation_place(["id", "c"], 1))
    assert {r["c_target"] for r in ordered_target_encoding(df, ["c"], "y", "place").collect()} == {0.5}


def test_seeds_permute_and_empty_stays_empty(spark):
    df = spark.range(200).select("id", F.lit("x").alias("c"), (F.col("id") % 2).alias("y"))
    first, second = (
        {r["id"]: r["c_target"] for r in ordered_target_encoding(df.withColumn("p", permutation_place(["id"], s)), ["c"], "y", "p").collect()}
        for s in (1, 2)
    )
    assert first != second and len(first) == len(second) == 200
    assert sorted(first.values())[0] >= 0 and max(first.values()) < 1
    assert ordered_target_encoding(df.limit(0).withColumn("p", F.lit("0")), ["c"], "y", "p").collect() == []


def test_a_hot_category_is_dealt_to_many_tasks(spark):
    """One exchange of the rows for each category column, by category and stretch."""
    df = spark.range(1000).select("id", F.concat(F.lit("x"), F.col("id") % 1).alias("c"), (F.col("id") % 2).alias("y")).withColumn("p", permutation_place(["id"], 1))
    plan = ordered_target_encoding(df, ["c"], "y", "p")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(c") >= 1 and "_stretch" in plan
    sizes = df.groupBy(F.substring("p", 1, 2)).count().agg(F.max("count")).first()[0]
    assert sizes == pytest.approx(4, abs=14)


def test_all_categories_share_one_exchange_of_the_rows(spark):
    """The wide rows are dealt once, by stretch, and joined with nothing."""
    df = spark.range(1000).select("id", F.hash("id").alias("wide"), (F.col("id") % 3).alias("c"), (F.col("id") % 5).alias("d"), (F.col("id") % 2).alias("y"))
    df = df.withColumn("p", permutation_place(["id"], 1))
    plan = ordered_target_encoding(df, ["c", "d"], "y", "p")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") == 1 and "Join" not in plan
