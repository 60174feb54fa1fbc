from __future__ import annotations

import pytest
from helpers import same_rows
from pyspark.sql import functions as F

from tillroll.functions.timeparts import with_time_parts
from tillroll.operators import habits, rollup
from tillroll.operators.hotkeys import Limits
from tillroll.plans import features

KEYS = ["client_id", "day", "term_id", "trans_type", "mcc_code"]


@pytest.mark.parametrize("keys", [["client_id"], ["client_id", "term_id"], ["mcc_code"], []])
def test_rolled_up_measures_equal_plain_aggregates(skewed, keys):
    rows = with_time_parts(skewed)
    measures = {f"{kind}_{c}": rollup.Measure(kind, c, F.col(c)) for kind in rollup.PLAIN for c in ("amount", "hour")}
    finest = rollup.cells(rows, KEYS, measures.values())
    middle = rollup.rolled(finest, ["client_id", "term_id", "mcc_code"])
    for source in (finest, middle):
        got = rollup.measured(rollup.rolled(source, keys), keys, measures)
        want = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("group_rows"), *[m.of_rows().alias(n) for n, m in measures.items()])
        same_rows(got.withColumns({c: F.round(c, 6) for c, t in got.dtypes if t == "double"}),
                  want.withColumns({c: F.round(c, 6) for c, t in want.dtypes if t == "double"}))


def test_one_value_has_no_deviation(spark):
    """Sums of 0.1 carry noise; the deviation of equal values is 0 all the same."""
    df = spark.range(1000).select((F.col("id") % 7).alias("cell"), F.lit(1).alias("g"), F.lit(0.1).alias("x"))
    std = {"std": rollup.Measure("std", "x", F.col("x"))}
    assert rollup.measured(rollup.rolled(rollup.cells(df, ["g", "cell"], std.values()), ["g"]), ["g"], std).first()["std"] == 0.0


def test_missing_values(spark):
    df = spark.createDataFrame([(1, None), (1, None), (2, 3.0), (2, None)], "g int, x double")
    measures = {kind: rollup.Measure(kind, "x", F.col("x")) for kind in rollup.PLAIN}
    got = {r["g"]: r.asDict() for r in rollup.measured(rollup.cells(df, ["g"], measures.values()), ["g"], measures).collect()}
    assert got[1] == {"g": 1, "group_rows": 2, "count": 0, "sum": None, "avg": None, "std": None}
    assert got[2] == {"g": 2, "group_rows": 2, "count": 1, "sum": 3.0, "avg": 3.0, "std": None}


def test_distinct_counts(skewed):
    columns = {"term_id": "a", "mcc_code": "b", "trans_type": "c"}
    got = rollup.distinct_counts(skewed, ["client_id"], columns)
    same_rows(got, skewed.groupBy("client_id").agg(*[F.count_distinct(c).alias(n) for c, n in columns.items()]))


def test_lookups_read_the_rows_twice(skewed, monkeypatch):
    """Once for the cells and once to be given the values, however many key lists there are."""
    from tillroll.operators import hotkeys

    seen = []
    monkeypatch.setattr(hotkeys, "written", lambda df: seen.append(df) or df.cache())
    out = hotkeys.with_lookups(with_time_parts(skewed), habits.all_stats(), "client_id", 50)
    assert len(seen) == 1 and seen[0].columns[:5] == ["client_id", "day", "term_id", "trans_type", "mcc_code"]
    assert out.count() == skewed.count()


@pytest.mark.parametrize("build", [features.scoring_features, features.training_features])
def test_one_scan_of_the_base(spark, skewed_labelled, tmp_path_factory, monkeypatch, build):
    path = str(tmp_path_factory.mktemp("base") / "txn")
    skewed_labelled.write.parquet(path)
    base, scans, real = spark.read.parquet(path), [], features.written

    def counted(df):
        scans.append(df._jdf.queryExecution().executedPlan().toString().count("FileScan"))
        return real(df)

    monkeypatch.setattr(features, "written", counted)
    out = build(base, limits=Limits(group_rows=80))
    assert scans == [1]
    assert path not in out._jdf.queryExecution().optimizedPlan().toString()
    assert not any(path in f for f in out.inputFiles())
    same_rows(build(base, limits=Limits(rows=10**4)), out)
