"""Exact percentiles (linear interpolation) that hold at any size."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.hotkeys import DEFAULT, Limits, hot_keys, read_once
from tillroll.operators.lineage import pinned, written

MAX_BINS = 1 << 16
MAX_CELLS = 1 << 24
#: Accuracy of the sketch, and how many of its errors a range reaches to both sides of the wanted rank.
SKETCH_ACCURACY, SKETCH_MARGIN = 10_000, 2


def percentiles_by(
    df: DataFrame,
    value: Column,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    weight: Column | None = None,
    limits: Limits = DEFAULT,
) -> DataFrame:
    """One row per group of ``by`` with the array ``percentiles`` of the non-null values.

    ``weight`` counts how often a value occurs. The values are written once
    before large groups are looked for. Groups of ordinary size use
    Spark's ``percentile``, which keeps a group's distinct values in one task;
    larger groups are read twice, see ``_by_sketch``, or with weights narrowed
    down by counting, see ``_narrow``.
    """
    keys = list(by) or ["whole_table"]
    source = df if by else df.withColumn("whole_table", F.lit(0))
    rows = source.select(
        *keys, value.cast("double").alias("value"), (F.lit(1) if weight is None else weight).cast("long").alias("weight")
    ).filter(F.col("value").isNotNull() & (F.col("weight") > 0))
    rows = read_once(rows, limits)
    out = hot_keys(rows, keys, limits).apply(
        rows,
        lambda part: _in_one_task(part, keys, probabilities),
        lambda part: _by_sketch(part, keys, probabilities, limits) if weight is None else _narrow(part, keys, probabilities),
    )
    return out if by else out.drop("whole_table")


def _in_one_task(rows: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    return rows.groupBy(*keys).agg(F.percentile("value", wanted, F.col("weight")).alias("percentiles"))


def _image(value: Column) -> Column:
    """A long in the order of the doubles: -Infinity first, the two zeros alike, NaN last."""
    plain = F.when(value == 0, F.lit(0.0)).otherwise(value)
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("long")
    return F.when(bits < 0, bits.bitwiseXOR(F.lit((1 << 63) - 1))).otherwise(bits)


def _by_sketch(rows: DataFrame, keys: Sequence[str], probabilities: Sequence[float], limits: Limits = DEFAULT) -> DataFrame:
    """Percentiles of few but large groups from two scans of the rows.

    The first scan's mergeable sketch gives for each wanted rank a range of values that holds it, a few ten-thousandths of the
    group wide. The second counts every value inside a range by itself and all rows between two ranges as one, at the border
    below them, which keeps the order. What is left is a small table of values and counts with the same percentiles as the rows.
    A group that has few enough values left is one of ordinary size by now; ``_narrow`` finds the others' percentiles, as its
    passes grow with the number of groups. Counts tell whether every rank does lie in its range; where a sketch was off, all rows
    are narrowed instead, so the answer is exact in any case.
    """
    margin = SKETCH_MARGIN / SKETCH_ACCURACY
    shares = [min(max(p + d, 0.0), 1.0) for p in probabilities for d in (-margin, margin)]
    wanted = F.array(*[F.lit(x) for x in shares])
    found = pinned(
        rows.groupBy(*keys).agg(
            F.sum("weight").alias("rows"), F.min("value").alias("least"), F.percentile_approx("value", wanted, F.lit(SKETCH_ACCURACY)).alias("borders")
        )
    )
    value, border = F.col("value"), lambda i: F.get("borders", F.lit(i))
    inside = reduce(or_, [value.between(border(2 * i), border(2 * i + 1)) for i in range(len(probabilities))])
    below = F.coalesce(F.array_max(F.filter("borders", lambda b: b <= value)), F.col("least"))
    met = rows.join(F.broadcast(found), list(keys)).withColumn("inside", inside)
    counted = met.groupBy(*keys, "inside", F.when(F.col("inside"), value).otherwise(below).alias("at")).agg(F.sum("weight").alias("weight"))
    small = written(counted)
    checks = []
    for i, p in enumerate(probabilities):
        rank = F.lit(float(p)) * (F.col("rows") - 1)
        low, high, at = border(2 * i), border(2 * i + 1), F.col("at")
        lower = F.sum(F.when(at < low, F.col("weight")).otherwise(0))
        upto = F.sum(F.when(F.when(F.col("inside"), at <= high).otherwise(at < high), F.col("weight")).otherwise(0))
        checks.append((lower <= F.floor(F.first(rank))) & (upto > F.ceil(F.first(rank))))
    held = small.join(F.broadcast(found), list(keys)).groupBy(*keys).agg(reduce(and_, checks).alias("held"))
    if not held.filter("NOT held").isEmpty():
        return _narrow(rows, keys, probabilities)
    values = small.select(*keys, F.col("at").alias("value"), "weight")
    return hot_keys(values, keys, limits).apply(
        values,
        lambda part: _in_one_task(part, keys, probabilities),
        lambda part: _narrow(part, keys, probabilities),
    )


def _narrow(rows: DataFrame, keys: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Percentiles of few but large groups.

    Each wanted rank keeps a range of values known to hold it. A pass counts the
    rows of every range in bins (with map-side combine, no sort, no group in one
    task), and the bin that holds the rank becomes the next range, cut to the
    values present. A range of one value is the answer. Bins are the leading bits
    of the values' images in which a range still differs, up to 16 of 64 a pass, so
    four passes end whatever the distribution; more only where MAX_CELLS leaves
    fewer bits to each of very many ranges (64 passes at one bit).
    """
    rows = written(rows.withColumn("image", _image(F.col("value"))))
    position = F.col("probability") * (F.col("n") - 1)
    targets = (
        rows.groupBy(*keys)
        .agg(
            F.sum("weight").alias("n"), F.min("image").alias("low"), F.max("image").alias("high"), F.min("value").alias("at")
        )
        .select(
            "*",
            F.posexplode(F.array(*[F.lit(float(p)) for p in probabilities])).alias("index", "probability"),
        )
        .select(
            *keys,
            F.explode(
                F.array(
                    F.struct((2 * F.col("index")).alias("target"), F.floor(position).alias("rank")),
                    F.struct((2 * F.col("index") + 1).alias("target"), F.ceil(position).alias("rank")),
                )
            ).alias("t"),
            (position - F.floor(position)).alias("fraction"),
            "low",
            "high",
            "at",
            F.lit(0).cast("long").alias("below"),
        )
        .select(*keys, "t.target", "t.rank", "fraction", "low", "high", "at", "below")
    )
    targets = pinned(targets)
    found = []
    while True:
        found.append(targets.filter(F.col("low") == F.col("high")))
        targets = targets.filter(F.col("low") < F.col("high"))
        differing = F.length(F.bin(F.col("low").bitwiseXOR(F.col("high"))))
        left = targets.agg(F.count(F.lit(1)).alias("targets"), F.max(differing).alias("bits")).first()
        if not left["targets"]:
            break
        # ranges that several targets share are counted once; the bins of all ranges stay within MAX_CELLS
        shared = [*keys, "low", "high"]
        number = max(2, min(MAX_BINS, MAX_CELLS // left["targets"]))
        shift = max(0, left["bits"] - (number.bit_length() - 1))
        bins = (
            rows.join(F.broadcast(targets.select(*shared).distinct()), list(keys))
            .filter(F.col("image").between(F.col("low"), F.col("high")))
            .groupBy(*shared, F.shiftright("image", shift).alias("bin"))
            .agg(
                F.sum("weight").alias("n"), F.min("image").alias("bin_low"), F.max("image").alias("bin_high"),
                F.min("value").alias("bin_at"),
            )
        )
        # at most MAX_BINS rows per range
        upto = Window.partitionBy(*shared).orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
        counted = bins.withColumn("through", F.sum("n").over(upto)).join(F.broadcast(targets), shared)
        through = F.col("below") + F.col("through")
        targets = pinned(
            counted.filter((F.col("rank") < through) & (F.col("rank") >= through - F.col("n"))).select(
                *keys,
                "target",
                "rank",
                "fraction",
                F.col("bin_low").alias("low"),
                F.col("bin_high").alias("high"),
                F.col("bin_at").alias("at"),
                (through - F.col("n")).alias("below"),
            )
        )
    answers = found[0]
    for part in found[1:]:
        answers = answers.unionByName(part)

    def at(target: int, column: str) -> Column:
        return F.max(F.when(F.col("target") == target, F.col(column)))

    def interpolated(index: int) -> Column:
        lower, upper, fraction = at(2 * index, "at"), at(2 * index + 1, "at"), at(2 * index, "fraction")
        return F.when(lower == upper, lower).otherwise((1 - fraction) * lower + fraction * upper)

    return answers.groupBy(*keys).agg(F.array(*[interpolated(i) for i in range(len(probabilities))]).alias("percentiles"))


def column_percentiles(
    df: DataFrame,
    columns: Sequence[str],
    probabilities: Sequence[float],
    weight: Column | None = None,
    limits: Limits = DEFAULT,
) -> dict[str, list[Column]]:
    """Percentiles of whole columns, as scalar subqueries to be used in expressions over ``df``."""
    stacked = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("double").alias("value")) for c in columns])
        ).alias("cell"),
        (F.lit(1) if weight is None else weight).alias("weight"),
    ).select("cell.*", "weight")
    found = percentiles_by(stacked, F.col("value"), probabilities, ["column_name"], None if weight is None else F.col("weight"), limits)
    wide = found.agg(*[F.max(F.when(F.col("column_name") == c, F.col("percentiles"))).alias(c) for c in columns])
    return {c: [wide.select(F.get(F.col(c), F.lit(i))).scalar() for i in range(len(probabilities))] for c in columns}
