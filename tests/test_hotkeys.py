from __future__ import annotations

import pytest
from helpers import same_rows
from pyspark.sql import functions as F

from tillroll.functions.amounts import with_signed_amounts
from tillroll.functions.timeparts import with_time_parts
from tillroll.operators import clients, habits, hotkeys
from tillroll.operators.hotkeys import GroupStats, Limits, hot_keys, lookup, lookup_table
from tillroll.operators.lineage import written

# every client, only the larger ones, and none is hot
SIZES = [3, 60, 10_000]


def test_hot_keys_are_exactly_the_large_groups(skewed):
    hot = hot_keys(skewed, ["client_id"], Limits(group_rows=100))
    assert [r["client_id"] for r in hot.keys.collect()] == [0] and hot.limit == 100
    assert hot_keys(skewed, ["client_id"], Limits(group_rows=3000)).keys is None


def test_a_small_table_is_not_searched(skewed):
    hot = hot_keys(skewed, ["no_such_column"], Limits(group_rows=5000, rows=3000))
    assert hot.keys is None


def test_limit_bounds_the_number_of_hot_keys():
    rows = 10**13
    assert rows / Limits().of(rows) <= hotkeys.MAX_HOT_KEYS
    assert Limits(group_rows=10).of(100) == 10


@pytest.mark.parametrize("group_rows", SIZES[:2])
def test_window_and_lookup_forms_agree(skewed, group_rows):
    rows = with_time_parts(skewed)
    plain = habits.with_stats(rows, habits.all_stats(), Limits())
    split = habits.with_stats(rows, habits.all_stats(), Limits(group_rows=group_rows))
    assert split.count() == skewed.count()
    same_rows(plain, split)


def test_lookup_with_hot_missing_and_unknown_keys(spark, skewed):
    side = skewed.groupBy("client_id", "term_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    side = side.filter(F.col("client_id") != 5)
    got = lookup(skewed, side, ["client_id", "term_id"], "n", 40)
    want = skewed.join(side.drop("n"), ["client_id", "term_id"], "left")
    same_rows(got, want)
    assert got.filter(F.col("term_id").isNull() & F.col("total").isNotNull()).isEmpty()


def test_rows_outside_the_shuffle_join_are_scattered(spark, skewed):
    """Copies of one row with a hot key do not meet in one task."""
    side = skewed.groupBy("client_id", "term_id").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("total"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lookup(skewed.repartition(8), side, ["client_id", "term_id"], "n", 40)
        copies = got.filter((F.col("client_id") == 0) & (F.col("amount") == -12.5))
        tasks = copies.groupBy(F.spark_partition_id().alias("task")).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "64MB")
    assert len(tasks) > 1


def test_large_lookup_table_is_not_broadcast_whole(skewed, monkeypatch):
    side = skewed.dropna(subset=["mcc_code"]).groupBy("mcc_code").agg(
        F.count(F.lit(1)).alias("n"), F.avg("amount").alias("mean")
    )
    whole = lookup_table(skewed, side, ["mcc_code"], "n")
    monkeypatch.setattr(hotkeys, "MAX_HOT_KEYS", 5)
    same_rows(whole, lookup_table(skewed, side, ["mcc_code"], "n", Limits(group_rows=200)))


def test_keys_must_start_with_the_anchor(skewed):
    with pytest.raises(ValueError, match="start with"):
        hotkeys.attach(skewed, [GroupStats(("mcc_code",), {"n": F.count("amount")})], "client_id", limits=Limits(rows=1))


def test_code_count_drops_rows_without_code(skewed):
    for limits in (Limits(), Limits(group_rows=50)):
        got = habits.with_code_count(skewed, limits)
        assert got.count() == skewed.filter(F.col("mcc_code").isNotNull()).count()
        wrong = got.groupBy("client_id", "mcc_code").agg(
            F.count(F.lit(1)).alias("n"), F.min("mcc_code_count").alias("a"), F.max("mcc_code_count").alias("b")
        ).filter((F.col("n") != F.col("a")) | (F.col("n") != F.col("b")))
        assert wrong.isEmpty()


def test_written_tables_lie_in_the_checkpoint_folder(spark, skewed):
    back = written(skewed)
    folder = spark.sparkContext.getCheckpointDir()
    assert all(f.startswith(folder.replace("file:", "file://")) for f in back.inputFiles())
    assert back.dtypes == skewed.dtypes and back.count() == skewed.count()


@pytest.mark.parametrize("question", ["profile", "distinct", "joined", "codes"])
def test_rows_are_read_once_where_hot_clients_are_looked_for(spark, skewed, question):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def answer(df, limits):
        if question == "profile":
            return clients.money_profile(with_signed_amounts(df), limits)
        if question == "distinct":
            return clients.distinct_counts(df, limits)
        if question == "joined":
            features = skewed.groupBy("client_id").agg(F.count(F.lit(1)).alias("n_rows"), F.max("amount").alias("most"))
            return clients.joined_back(df, features, limits=limits)
        return habits.with_code_count(df.filter("mcc_code IS NOT NULL"), limits)

    got = written(answer(skewed.mapInArrow(counted, skewed.schema), Limits(group_rows=60)))
    assert seen.value == skewed.count()
    same_rows(got, answer(skewed, Limits(group_rows=60, rows=10)))


def test_tasks_grow_in_number_with_the_rows(spark, skewed, monkeypatch):
    """Memory of a task stays the same where the session's number of shuffle partitions does."""
    monkeypatch.setattr(hotkeys, "TASK_ROWS", 100)
    hot = hot_keys(skewed, ["client_id"], Limits(group_rows=3000))
    assert hot.rows == 3000
    out = habits.habits(skewed, Limits(group_rows=3000))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(client_id" in plan and ", 30), REPARTITION_BY_NUM" in plan
    same_rows(out, habits.habits(skewed, Limits(rows=10)))
