from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from tillroll.functions.amounts import ratio, with_signed_amounts
from tillroll.functions.mcc import MCC_BANDS, mcc_group
from tillroll.functions.timeparts import EPOCH, with_time_parts


def test_epoch_is_a_friday():
    assert EPOCH == datetime.date(2019, 8, 2) and EPOCH.weekday() == 4


def test_time_parts(edge):
    got = {r["trans_time"]: r for r in with_time_parts(edge).collect()}
    first = got["0 00:00:00"]
    assert (first["day"], first["hour"], first["weekday"], first["day_mod7"]) == (0, 0, 4, 0)
    assert first["trans_ts"] == datetime.datetime(2019, 8, 2)
    rolled = got["219 23:59:60"]
    assert rolled["trans_ts"] == datetime.datetime(2020, 3, 9)
    assert rolled["weekday"] == 6, "8 March 2020 is a Sunday; the weekday is that of the day number"
    assert rolled["day_mod7"] == 2
    assert got["456 12:00:00"]["trans_ts"].date() == datetime.date(2020, 10, 31)


def test_malformed_time_is_missing(spark):
    df = spark.createDataFrame([("x 1:2:3",), ("5",), (None,)], "trans_time string")
    rows = {r["trans_time"]: r for r in with_time_parts(df).collect()}
    assert rows["x 1:2:3"]["day"] is None and rows["x 1:2:3"]["trans_ts"] is None
    assert rows["5"]["day"] == 5 and rows["5"]["hour"] is None
    assert rows[None]["weekday"] is None


def test_code_ranges_are_disjoint_and_without_gap():
    ranges = sorted(r for group in MCC_BANDS.values() for r in group)
    assert len(ranges) == 35 and ranges[0][0] == 724 and ranges[-1][1] == 9754
    assert all(left[1] == right[0] for left, right in zip(ranges, ranges[1:]))


def test_code_groups_at_the_borders(spark):
    want = {
        723: 723, 724: 1, 1798: 1, 1799: 2, 5713: 9, 5714: 2, 5715: 11, 5962: 12, 5963: 13, 9701: 21, 9702: 2,
        9752: 21, 9753: 21, 9754: 9754, None: None,
    }
    df = spark.createDataFrame([(c,) for c in want], "mcc_code int")
    got = {r["mcc_code"]: r["g"] for r in df.select("mcc_code", mcc_group(F.col("mcc_code")).alias("g")).collect()}
    assert got == want


def test_zero_counts_on_both_sides(spark):
    df = with_signed_amounts(spark.createDataFrame([(0.0,), (2.5,), (-2.5,), (None,)], "amount double"))
    got = {r["amount"]: (r["amount_up"], r["amount_down"]) for r in df.collect()}
    assert got == {0.0: (0.0, 0.0), 2.5: (2.5, None), -2.5: (None, 2.5), None: (None, None)}


def test_ratio_rules(spark):
    df = spark.createDataFrame([(0.0, 0.0), (3.0, 0.0), (-3.0, 2.0), (0.0, 2.0), (None, 2.0)], "a double, b double")
    got = [tuple(r) for r in df.select(ratio(F.col("a"), F.col("b")), ratio(F.col("a"), F.col("b"), F.lit(0.0))).collect()]
    assert got == [(None, 0.0), (1000.0, 1000.0), (1.5, 1.5), (0.0, 0.0), (None, None)]
