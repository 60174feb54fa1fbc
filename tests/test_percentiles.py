from __future__ import annotations

import numpy as np
import pytest
from helpers import same_rows
from pyspark.sql import functions as F

from tillroll.operators import percentiles as P
from tillroll.operators.hotkeys import Limits
from tillroll.operators.scaling import minmax_scaled, winsorized

PROBABILITIES = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
HOT = Limits(group_rows=1)


@pytest.fixture(scope="module")
def values(spark):
    rng = np.random.default_rng(5)
    rows = [(0, float(v)) for v in rng.normal(0, 1e3, 400)]
    rows += [(1, float(v)) for v in rng.integers(0, 4, 300)]
    rows += [(2, 7.5)] * 50 + [(3, 1.0), (3, 2.0), (4, -1e-9), (4, 1e12), (4, 3.0), (5, None), (6, 4.0), (6, None)]
    return spark.createDataFrame(rows, "g int, v double").withColumn("w", F.pmod(F.hash("v"), F.lit(4)))


def as_lists(df, key="g"):
    return {r[key]: r["percentiles"] for r in df.collect()}


def test_counting_equals_sorting(values):
    plain = as_lists(P.percentiles_by(values, F.col("v"), PROBABILITIES, ["g"]))
    counted = as_lists(P.percentiles_by(values, F.col("v"), PROBABILITIES, ["g"], limits=HOT))
    assert set(plain) == set(counted) == {0, 1, 2, 3, 4, 6}
    for g, want in plain.items():
        assert counted[g] == pytest.approx(want, rel=1e-12), g


def test_against_numpy(values):
    got = as_lists(P.percentiles_by(values.filter("g = 0"), F.col("v"), PROBABILITIES, ["g"], limits=HOT))[0]
    data = [r["v"] for r in values.filter("g = 0").collect()]
    assert got == pytest.approx(list(np.quantile(data, PROBABILITIES)), rel=1e-9)


def test_weights_repeat_values(values):
    repeated = values.filter("g < 2").withColumn("i", F.explode(F.array_repeat(F.lit(1), F.col("w").cast("int"))))
    want = as_lists(P.percentiles_by(repeated, F.col("v"), PROBABILITIES, ["g"]))
    for limits in (Limits(), HOT):
        got = as_lists(P.percentiles_by(values.filter("g < 2"), F.col("v"), PROBABILITIES, ["g"], F.col("w"), limits))
        assert {g: pytest.approx(v, rel=1e-12) for g, v in want.items()} == got


def test_few_bins_need_more_passes(values, monkeypatch):
    monkeypatch.setattr(P, "MAX_BINS", 4)
    want = as_lists(P.percentiles_by(values, F.col("v"), [0.3], ["g"]))
    got = as_lists(P.percentiles_by(values, F.col("v"), [0.3], ["g"], limits=HOT))
    assert {g: pytest.approx(v, rel=1e-12) for g, v in want.items()} == got


def test_any_distribution_ends_in_four_passes(spark, monkeypatch):
    rng = np.random.default_rng(7)
    groups = {
        0: [*rng.normal(0, 1, 50), float("inf")],
        1: [*rng.normal(0, 1, 50), float("nan"), float("-inf")],
        2: [1.7e308, -1.7e308, 1.0, 2.0, -0.0, 0.0],
        3: [float(s * 10.0**e) for e in range(-307, 308, 3) for s in (-1, 1)],
        4: [3.25] * 40,
        5: [float("nan")] * 3,
        6: [5e-324, -5e-324, 1.0, float(np.nextafter(1.0, 2.0))],
    }
    rows = [(g, float(v), 1 + i % 3) for g, values in groups.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g int, v double, w int")
    passes = []
    monkeypatch.setattr(P, "pinned", lambda x, real=P.pinned: passes.append(1) or real(x))
    for weight in (None, F.col("w")):
        want = as_lists(P.percentiles_by(df, F.col("v"), PROBABILITIES, ["g"], weight))
        passes.clear()
        found = P._narrow(
            df.select("g", F.col("v").alias("value"), (F.lit(1) if weight is None else weight).cast("long").alias("weight")),
            ["g"], PROBABILITIES,
        )
        assert len(passes) <= 1 + 4
        got = as_lists(found)
        assert {g: pytest.approx(v, rel=1e-12, nan_ok=True) for g, v in want.items()} == got


def test_whole_table(values):
    plain = P.percentiles_by(values, F.col("v"), [0.5]).first()["percentiles"]
    counted = P.percentiles_by(values, F.col("v"), [0.5], limits=HOT).first()["percentiles"]
    assert plain == pytest.approx(counted)


def test_winsorized_stays_inside_and_keeps_missing(spark):
    df = spark.createDataFrame([(float(i), None if i % 3 else -float(i)) for i in range(100)], "a double, b double")
    want = np.quantile(np.arange(100.0), [0.05, 0.95])
    for limits in (Limits(), HOT):
        out = winsorized(df, ["a", "b"], limits=limits)
        ends = out.agg(F.min("a"), F.max("a"), F.count("b")).first()
        assert ends[0] == pytest.approx(want[0]) and ends[1] == pytest.approx(want[1]) and ends[2] == 34
    same_rows(winsorized(df, ["a", "b"]), winsorized(df, ["a", "b"], limits=HOT))


def test_minmax(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (None, None)], "a double, b double")
    got = sorted(map(tuple, minmax_scaled(df, ["a", "b"]).collect()), key=str)
    assert got == sorted([(0.0, 0.0), (1000.0, 0.0), (None, None)], key=str)


def test_large_groups_are_read_twice(spark):
    rows = spark.range(0, 30_000, 1, 4).select((F.col("id") % 2).alias("g"), (F.hash("id") / 7.0).alias("value"), F.lit(1).cast("long").alias("weight"))
    want = as_lists(P._in_one_task(rows, ["g"], PROBABILITIES))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    got = as_lists(P._by_sketch(rows.mapInArrow(counted, rows.schema), ["g"], PROBABILITIES))
    assert seen.value == 2 * 30_000
    assert {g: pytest.approx(v, rel=1e-12) for g, v in want.items()} == got


def test_a_sketch_that_is_off_is_noticed(spark, values, monkeypatch):
    """With ranges of no width the ranks lie beside them, and all rows are narrowed."""
    monkeypatch.setattr(P, "SKETCH_MARGIN", 0)
    monkeypatch.setattr(P, "SKETCH_ACCURACY", 3)
    narrowed = []
    real = P._narrow
    monkeypatch.setattr(P, "_narrow", lambda rows, *rest: narrowed.append(rows.columns) or real(rows, *rest))
    want = as_lists(P.percentiles_by(values, F.col("v"), PROBABILITIES, ["g"]))
    got = as_lists(P.percentiles_by(values, F.col("v"), PROBABILITIES, ["g"], limits=HOT))
    assert {g: pytest.approx(v, rel=1e-12) for g, v in want.items()} == got and len(narrowed) == 1


def test_values_are_read_once_where_large_groups_are_looked_for(spark):
    """What stands behind the rows (joins, for instance) runs once, not again for each search, sketch and count."""
    rows = spark.range(0, 6_000, 1, 4).select((F.col("id") % 2).alias("g"), (F.hash("id") / 7.0).alias("value"))
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    source = rows.mapInArrow(counted, rows.schema)
    got = as_lists(P.percentiles_by(source, F.col("value"), PROBABILITIES, ["g"], limits=Limits(group_rows=100)))
    assert seen.value == 6_000
    want = as_lists(P.percentiles_by(rows, F.col("value"), PROBABILITIES, ["g"]))
    assert {g: pytest.approx(v, rel=1e-12) for g, v in want.items()} == got


def test_many_large_groups_of_few_values_need_no_passes(spark, monkeypatch):
    """What the sketch leaves of such groups fits into a task each; passes would grow in number with the groups."""
    rows = spark.range(0, 4_000, 1, 4).select((F.col("id") % 40).alias("g"), (F.hash("id") / 7.0).alias("value"))
    want = as_lists(P.percentiles_by(rows, F.col("value"), PROBABILITIES, ["g"]))
    narrowed = []
    real = P._narrow
    monkeypatch.setattr(P, "_narrow", lambda rows, *rest: narrowed.append(rows.columns) or real(rows, *rest))
    got = as_lists(P.percentiles_by(rows, F.col("value"), PROBABILITIES, ["g"], limits=Limits(group_rows=60)))
    assert {g: pytest.approx(v, rel=1e-12) for g, v in want.items()} == got and not narrowed
