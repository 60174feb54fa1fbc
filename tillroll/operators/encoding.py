"""Ordered target statistics: a category's value on a row comes from earlier rows of a seeded permutation alone."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Weight and value of the prior that every category starts with.
STRENGTH, PRIOR = 1.0, 0.5
#: Leading hexadecimal digits of the place that name a stretch: 256 stretches.
STRETCH_DIGITS = 2


def permutation_place(columns: Sequence[str], seed: int) -> Column:
    """Place of a row in the permutation of a seed: the MD5 of its values. Equal rows share a place."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]))


def content_place(columns: Sequence[str], seed: int) -> Column:
    """The same from a 64-bit hash, which costs less where the columns are many."""
    return F.lpad(F.hex(F.xxhash64(F.lit(seed), *columns)), 16, "0")


def ordered_target_encoding(
    df: DataFrame,
    categories: Sequence[str],
    label: str,
    place: str,
    prior: float = PRIOR,
    strength: float = STRENGTH,
    suffix: str = "_target",
) -> DataFrame:
    """For each category column the share of positive labels over the rows of the same category at earlier places.

    ``(positives + strength * prior) / (rows + strength)``, so the first row of a category gets the prior. Rows at one place don't
    see each other. A missing category is a category; a row without a label sees others and is not seen.

    A category may hold any share of the rows: it is cut into stretches of the permutation, which is uniform whatever the data.
    Stretches are summed on the map side; their running totals (a row for each stretch of a category) stand before the rows of a
    stretch, which are sorted by themselves. All category columns share one exchange of the rows, by stretch.
    """
    seen, stretch = F.col(label).cast("double"), F.substring(place, 1, STRETCH_DIGITS)
    rows = df.select(
        "*", F.coalesce(seen, F.lit(0.0)).alias("_positives"), F.col(label).isNotNull().cast("long").alias("_rows"),
        F.col(place).alias("_place"), stretch.alias("_stretch"), F.lit(None).cast("int").alias("_carried"),
    )
    dealt = rows
    for k, c in enumerate(categories):
        sums = rows.groupBy(c, "_stretch").agg(*[F.sum(x).alias(x) for x in ("_positives", "_rows")])
        before = Window.partitionBy(c).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        carried = sums.select(
            c, *[F.coalesce(F.sum(x).over(before), F.lit(0)).alias(x) for x in ("_positives", "_rows")],
            F.lit("").alias("_place"), "_stretch", F.lit(k).alias("_carried"),
        )
        dealt = dealt.unionByName(carried, allowMissingColumns=True)
    out = dealt.repartition("_stretch")
    for k, c in enumerate(categories):
        upto = Window.partitionBy("_stretch", c).orderBy("_place").rangeBetween(Window.unboundedPreceding, Window.currentRow)
        here = Window.partitionBy("_stretch", c, "_place")
        own = F.col("_carried").isNull() | (F.col("_carried") == k)  # what is carried for another column counts as nothing
        positives, n = (
            F.sum(F.when(own, F.col(x)).otherwise(0)).over(upto) - F.sum(F.when(own, F.col(x)).otherwise(0)).over(here)
            for x in ("_positives", "_rows")
        )
        out = out.withColumn(f"{c}{suffix}", (positives + F.lit(strength * prior)) / (n + F.lit(float(strength))))
    return out.filter(F.col("_carried").isNull()).select(*df.columns, *[f"{c}{suffix}" for c in categories])
