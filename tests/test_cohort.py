from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillroll.functions.timeparts import with_time_parts
from tillroll.operators import cohort, joins, profile
from tillroll.operators.hotkeys import Limits


@pytest.fixture(scope="module")
def frame(spark):
    rows = [
        (0, 10, 1, "01:00:00", 1), (0, 10, 1, "02:00:00", 2), (0, 10, 8, "02:30:00", 2), (0, 20, 3, "05:00:00", 5),
        (1, 10, 1, "01:00:00", 1), (1, 30, 2, "23:00:00", 23), (1, 30, 2, None, None), (1, None, 4, "03:00:00", 3),
    ]
    return spark.createDataFrame(rows, "gender int, MCC int, day int, time string, hour int")


def as_set(df):
    return {tuple(r) for r in df.collect()}


def test_joins(spark, edge):
    labels = spark.createDataFrame([(1, 0), (2, 1), (99, 1)], "client_id long, gender int")
    got = joins.labelled(edge, labels)
    assert {r["client_id"] for r in got.collect()} == {1, 2} and got.count() == 4
    twice = spark.createDataFrame([(3,), (3,), (98,)], "client_id long")
    assert joins.of_clients(edge, twice).count() == 2
    assert joins.day_time(with_time_parts(got)).columns == ["gender", "MCC", "day", "time", "hour"]


def test_counts(frame):
    got = {(r["gender"], r["day"]): (r["MCC"], r["time"]) for r in cohort.non_null_counts(frame, ["gender", "day"]).collect()}
    assert got[(1, 2)] == (2, 1) and got[(1, 4)] == (0, 1)
    assert as_set(cohort.code_counts(frame, ["gender", "day"], [10])) == {(10, 0, 1, 2), (10, 0, 8, 1), (10, 1, 1, 1)}
    assert [tuple(r) for r in cohort.peak_days(frame, 10, 2).collect()] == [(0, 1, 2), (1, 1, 1)]
    assert cohort.peak_days(frame, 10).count() == 3
    assert as_set(cohort.day_slice(frame, 2, 4).select("gender", "day")) == {(0, 3), (1, 2), (1, 4)}


def test_hour_axis_is_complete(frame):
    got = as_set(cohort.hour_profile(frame))
    assert len(got) == 48 and (0, 2, 2) in got and (1, 23, 1) in got and (1, 0, 0) in got


def test_day_mod7(frame):
    assert as_set(cohort.day_mod7_counts(frame)) == {(1, 4), (3, 1), (2, 2), (4, 0)}
    assert as_set(cohort.code_day_mod7_counts(frame, [10])) == {(10, 1, 4)}
    assert as_set(cohort.day_mod7_groups(frame, 10)) == {(1, 3)}


def test_exclusive_and_difference(frame):
    assert as_set(cohort.exclusive_codes(frame)) == {("gender=0", 20), ("gender=1", 30)}
    got = {r["MCC"]: (r["count_true"], r["count_false"], r["diff_true_false"]) for r in cohort.code_count_difference(frame).collect()}
    assert got == {10: (1, 3, -2), 20: (None, 1, None), 30: (2, None, None)}
    assert as_set(cohort.code_value_counts(frame)) == {(0, 10, 3), (0, 20, 1), (1, 10, 1), (1, 30, 2)}


def test_skew(spark):
    df = spark.createDataFrame(
        [(1, 0, 5, 1.0), (1, 0, 5, 2.0), (2, 1, 5, 3.0), (2, 1, 6, None), (2, 1, 7, 4.0), (2, 1, None, 4.0)],
        "client_id long, gender int, mcc_code int, amount double",
    )
    got = {r["mcc_code"]: (r["count_0"], r["count_1"], r["dif"], r["dif_abs"]) for r in cohort.gender_skew(df).collect()}
    assert set(got) == {5, 7} and got[7] == (0, 1, -1.0, 1.0)
    assert got[5][2] == pytest.approx(1 / 3)
    for limits in (Limits(), Limits(group_rows=1)):
        assert cohort.with_gender_skew(df, limits).count() == 4


def test_nuniques(frame):
    got = {r["column_name"]: (r["n_all"], r["n_gender_0"], r["n_gender_1"]) for r in
           cohort.nuniques_by_group(frame, "gender", [0, 1]).collect()}
    assert got == {"gender": (2, 1, 1), "MCC": (3, 2, 2), "day": (5, 3, 3), "time": (6, 4, 3), "hour": (5, 3, 3)}


def test_nuniques_of_any_number_of_groups(spark, frame):
    got = {(r["group_key"], r["column_name"]): r["n"] for r in cohort.nuniques_long(frame, "day").collect()}
    rows = frame.dropna(subset=["day"]).collect()
    want = {}
    for day in {r["day"] for r in rows}:
        for c in frame.columns:
            values = {r[c] for r in rows if r["day"] == day and r[c] is not None}
            if values:
                want[(day, c)] = len(values)
    assert got == want
    many = spark.range(30_000).select((F.col("id") % 12_000).alias("g"), F.col("id").alias("x"))
    assert cohort.nuniques_long(many, "g").filter("column_name = 'x'").agg(F.count("n"), F.min("n"), F.max("n")).first()[:] == (12_000, 2, 3)


def test_sketches_merge_within_their_error(spark):
    df = spark.range(200_000).select((F.col("id") % 16).alias("g"), (F.col("id") % 50_000).alias("x"), F.lit(None).cast("int").alias("none"))
    sketches = cohort.nunique_sketches(df, "g").cache()
    assert {r["column_name"] for r in sketches.collect()} == {"g", "x"}
    got = {r["column_name"]: r["n"] for r in cohort.merged_nuniques(sketches).collect()}
    assert got["g"] == 16 and abs(got["x"] / 50_000 - 1) < 4 * 1.04 / 2 ** (cohort.SKETCH_BITS / 2)
    each = cohort.merged_nuniques(sketches.filter("column_name = 'x'"), ["group_key"]).collect()
    errors = [abs(r["n"] / 3125 - 1) for r in each]
    assert len(each) == 16 and sum(errors) / 16 < 2 * 1.04 / 2 ** (cohort.SKETCH_BITS / 2)


@pytest.mark.parametrize("values", [[1, 2, 3, 4, 100], list(range(500)) * 3, [5] * 9 + [7], [3, 3, 3], [0, 10]])
def test_automatic_bins_are_those_of_numpy(spark, values):
    df = spark.createDataFrame([(i % 2, float(v)) for i, v in enumerate(values)], "gender int, MCC double")
    edges = np.histogram_bin_edges(np.array(values, float), "auto")
    plan = cohort.automatic_bins(df).first()
    assert plan["bins"] == len(edges) - 1
    counts = {}
    for r in cohort.automatic_histogram(df).collect():
        counts[r["bin"]] = counts.get(r["bin"], 0) + r["n"]
    if min(values) < max(values):
        want = np.histogram(np.array(values, float), edges)[0]
        assert counts == {i: n for i, n in enumerate(want.tolist()) if n}
    else:
        assert counts == {0: len(values)}


def test_automatic_bins_of_nothing(spark):
    empty = spark.createDataFrame([], "gender int, MCC int")
    assert cohort.automatic_bins(empty).collect() == [] and cohort.automatic_histogram(empty).collect() == []


def test_count_slice(frame):
    got = [(r["gender"], r["day"]) for r in cohort.count_slice(frame, 1, 4).collect()]
    assert got == [(0, 3), (0, 8), (1, 1)]
    by_day = [(r["day"], r["gender"]) for r in cohort.count_slice(frame, 0, 2, ("day", "gender")).collect()]
    assert by_day == [(1, 0), (1, 1)]


def test_described(frame):
    got = {r["gender"]: r for r in cohort.described(frame, "day", ["gender"]).collect()}
    assert (got[0]["n"], got[0]["min"], got[0]["p50"], got[0]["max"]) == (4, 1, 2.0, 8)
    hot = {r["gender"]: r for r in cohort.described(frame, "day", ["gender"], Limits(group_rows=1)).collect()}
    assert got == hot
    assert cohort.described(frame, "day").first()["p25"] == pytest.approx(1.0)


def test_histogram_includes_the_last_value(frame):
    got = as_set(cohort.code_histogram(frame, 2))
    assert got == {(0, 0, 3), (0, 1, 1), (1, 0, 1), (1, 1, 2)}


def test_profile(frame):
    got = {r["column_name"]: (r["data_type"], r["n_null"], r["n_non_null"]) for r in profile.null_profile(frame).collect()}
    assert got["MCC"] == ("int", 1, 7) and got["time"] == ("string", 1, 7) and len(got) == 5
    assert tuple(profile.table_shape(frame).first()) == (8, 5)


def test_ranges(frame):
    row = cohort.day_range(frame).first()
    assert (row["first_day"], row["last_day"], str(row["last_date"])) == (1, 8, "2019-08-10")
    assert tuple(cohort.class_balance(frame.filter(F.col("MCC").isNotNull())).first()) == (4, 3, 1)


def test_missing_keys_are_in_no_group(spark):
    rows = [(None, 5, 1, "01:00:00", 1), (0, 5, None, "01:00:00", 1), (0, 5, 8, "02:00:00", None), (0, None, 9, "02:00:00", 2)]
    df = spark.createDataFrame(rows, "gender int, MCC int, day int, time string, hour int")
    assert as_set(cohort.code_counts(df, ["gender", "day"], [5])) == {(5, 0, 8, 1)}
    profile_rows = cohort.hour_profile(df).collect()
    assert len(profile_rows) == 24 and {r["gender"] for r in profile_rows} == {0}
    assert as_set(cohort.day_mod7_counts(df)) == {(1, 2), (2, 0)}
    assert as_set(cohort.peak_days(df, 5)) == {(0, 8, 1)}


def test_slice_without_an_end(frame):
    whole = [tuple(r) for r in cohort.count_slice(frame, 0).collect()]
    assert [tuple(r) for r in cohort.count_slice(frame, 2).collect()] == whole[2:]
    assert [tuple(r) for r in cohort.count_slice(frame, 1, 3).collect()] == whole[1:3]
