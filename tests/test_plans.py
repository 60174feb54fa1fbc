"""The plans: what is exchanged, read and broadcast."""

from __future__ import annotations

import re

import pytest
from helpers import SMALL
from pyspark.sql import functions as F

from tillroll.functions.timeparts import with_time_parts
from tillroll.operators import cohort, habits
from tillroll.operators.hotkeys import Limits
from tillroll.plans import queries as q


def plan_of(df, capsys) -> str:
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


@pytest.fixture()
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("stored") / "txn")
    q.train(spark, SMALL).write.parquet(path)
    return spark.read.parquet(path)


def test_all_windows_share_one_exchange(stored, capsys):
    rows = with_time_parts(stored)
    plan = plan_of(habits.with_stats(rows, habits.all_stats(), Limits(rows=10**5)), capsys)
    assert plan.count("Exchange hashpartitioning(client_id") == plan.count("Exchange") == 1
    assert plan.count("+- Sort [") == len(habits.all_stats())


def test_filter_and_columns_reach_the_scan(stored, capsys):
    frame = stored.select("gender", F.col("mcc_code").alias("MCC"), F.col("trans_type").alias("day"))
    plan = plan_of(cohort.code_counts(frame, ["gender", "day"], [5992]), capsys)
    assert re.search(r"PushedFilters: \[.*mcc_code.*5992", plan)
    schema = re.search(r"ReadSchema: struct<([^>]*)>", plan).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"gender", "mcc_code", "trans_type"}


def test_counts_combine_before_the_shuffle(stored, capsys):
    plan = plan_of(cohort.non_null_counts(stored, ["gender"]), capsys)
    assert "partial_count" in plan and plan.count("Exchange") == 1


def test_top_days_need_no_full_sort(spark, capsys):
    plan = plan_of(q.mcc_peak_days(spark, SMALL), capsys)
    assert "TakeOrderedAndProject" in plan and "Exchange rangepartitioning" not in plan


@pytest.mark.parametrize("name", [n for n in q.QUERIES if n not in ("model_auc", "submission", "validation_curve") and not n.endswith("_hot")])
def test_no_cross_join_and_no_python_in_the_plan(spark, capsys, name):
    plan = plan_of(q.QUERIES[name](spark, SMALL), capsys)
    for unwanted in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "ArrowEvalPython"):
        assert unwanted not in plan
