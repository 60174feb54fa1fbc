from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from tillroll.plans.queries import four_digits


def test_four_digits(spark):
    """Ties and their neighbours, large and special values; and the expression is written once, however many columns there are."""
    rng = random.Random(3)
    values = [None, math.nan, math.inf, -math.inf, 0.0, -0.0, -0.00004, 0.00005, -0.00005, 1.00005, 1e8, -99999999.99995, 1e30, 5e-324]
    for _ in range(2000):
        tie = (rng.randrange(-(10**9), 10**9) + 0.5) / 10 ** rng.randrange(4, 9)
        values += [tie, math.nextafter(tie, math.inf), math.nextafter(tie, -math.inf), tie + 1e-10, rng.uniform(-1, 1) * 10.0 ** rng.randrange(-6, 12)]
    value = F.col("value")
    rows = spark.createDataFrame([(v,) for v in values], "value double")
    want = F.coalesce(F.round(value.try_cast("decimal(28,9)"), 4).cast("double"), value)
    got = four_digits(rows.select(want.cast("string").alias("want"), *[value.alias(c) for c in ("a b", "b", "_rounded")]))
    assert got.columns == ["want", "a b", "b", "_rounded"]
    for c in got.columns[1:]:
        assert got.filter(~F.col("want").eqNullSafe(F.col(f"`{c}`").cast("string"))).count() == 0
    wide = four_digits(rows.select(*[value.alias(f"v{i}") for i in range(6)]))
    assert wide._jdf.queryExecution().optimizedPlan().toString().lower().count("decimal(28,9)") == 1
    assert four_digits(rows.select(F.lit("x").alias("x"))).columns == ["x"]
