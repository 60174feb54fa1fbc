from __future__ import annotations

import os

from tillroll.operators import lineage


def test_discard_removes_what_was_written(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "_handed_out", [])
    first, second = lineage.written(spark.range(5)), lineage.written(spark.range(7))
    folders = {os.path.dirname(f.removeprefix("file://")) for df in (first, second) for f in df.inputFiles()}
    assert len(folders) == 2 and all(map(os.path.exists, folders))
    second.write.parquet(str(tmp_path / "kept"))
    assert lineage.discard(spark) == 2 and not any(map(os.path.exists, folders))
    assert spark.read.parquet(str(tmp_path / "kept")).count() == 7
    assert lineage.discard(spark) == 0


def test_rounding_leaves_large_and_endless_numbers(spark):
    from tillroll.plans.queries import four_digits

    df = spark.createDataFrame([(1.23456,), (1e25,), (float("inf"),), (None,)], "x double")
    assert [r["x"] for r in four_digits(df).collect()] == [1.2346, 1e25, float("inf"), None]
