"""Rank statistics of whole columns, by prefix sums over distinct values that no single task holds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillroll.operators.lineage import written

#: Stretches of the order into which distinct values are dealt; a stretch is sorted in one task and may spill.
STRETCHES = 256


def score_counts(df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """Weight of the positive and negative rows for each distinct score; a missing (or NaN) score, label or weight leaves the row out."""
    each = F.lit(1) if weight is None else weight
    rows = df.select(
        *by, F.col(score).cast("double").alias("score"), F.col(label).cast("double").alias("label"), each.alias("weight")
    ).dropna(subset=["score", "label", "weight"])
    # both zeros are one score
    plain = F.when(F.col("score") == 0, F.lit(0.0)).otherwise(F.col("score"))
    return rows.groupBy(*by, plain.alias("score")).agg(
        F.sum(F.when(F.col("label") > 0, F.col("weight")).otherwise(0)).alias("positive"),
        F.sum(F.when(F.col("label") > 0, 0).otherwise(F.col("weight"))).alias("negative"),
    )


def with_stretch(counts: DataFrame, by: Sequence[str], stretches: int = STRETCHES) -> DataFrame:
    """``stretch``: a number that rises with the score and parts the distinct scores of a group about evenly.

    The borders come from a mergeable sketch, so any distribution is parted well; their error only makes stretches uneven.
    """
    shares = F.array(*[F.lit(k / stretches) for k in range(1, stretches)])
    borders = counts.groupBy(*by).agg(F.percentile_approx("score", shares, F.lit(10 * stretches)).alias("borders"))
    # a join, since a subquery below a lambda is sent to the tasks with its whole plan
    if by:
        joined = counts.join(borders, list(by))
    else:  # one row, joined by a number that is 0 everywhere but no literal, so that it stays a hash join
        one = borders.select(F.col("borders"), F.coalesce(F.size("borders") * 0, F.lit(0)).cast("long").alias("_one"))
        joined = counts.join(F.broadcast(one), F.pmod(F.xxhash64("score"), F.lit(1)) == one["_one"]).drop("_one")
    number = F.size(F.filter("borders", lambda b: b < F.col("score")))
    return joined.withColumn("stretch", number).drop("borders")


def area_of_stretches(parts: DataFrame, by: Sequence[str] = (), whole: bool = True) -> DataFrame:
    """``n``, ``n_positive`` and ``auc`` per group of ``by`` from a row for each stretch of its order: the weights ``positive`` and
    ``negative``, and ``twice``, twice the rank sum of its positives among its own negatives."""
    keys = list(by)
    number, exact = ("decimal(19,0)", "decimal(38,0)") if whole else ("double", "double")
    before = Window.partitionBy(*keys).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)  # at most ``stretches`` rows
    lower = F.coalesce(F.sum("negative").over(before), F.lit(0))
    moved = parts.withColumn("twice", (F.col("twice").cast(exact) + 2 * F.col("positive").cast(number) * lower.cast(number)).cast(exact))
    sums = moved.groupBy(*keys).agg(
        F.sum("twice").alias("twice"), F.sum("positive").alias("n_positive"), F.sum("negative").alias("n_negative")
    )
    pairs = 2 * F.col("n_positive").cast("double") * F.col("n_negative").cast("double")
    return sums.select(
        *keys,
        (F.col("n_positive") + F.col("n_negative")).alias("n"),
        "n_positive",
        F.when(pairs > 0, F.col("twice").cast("double") / F.nullif(pairs, F.lit(0.0))).alias("auc"),
    )


def rank_auc(counts: DataFrame, by: Sequence[str] = (), stretches: int = STRETCHES) -> DataFrame:
    """Area under the ROC curve from ``score_counts``, per group of ``by``: ``n``, ``n_positive`` (weights) and ``auc``.

    A positive row counts the negative rows below its score, and half of those at its score. Inside a stretch these come from a
    running sum; a stretch then adds its own positives times the negatives of all stretches before it, so the global order is never
    sorted in one place. Sums are exact for whole weights: twice the rank sum stays a whole number. NULL where a class is missing.
    """
    keys = list(by)
    whole = all(t in ("int", "bigint") for n, t in counts.dtypes if n in ("positive", "negative"))
    exact = "decimal(38,0)" if whole else "double"
    dealt = with_stretch(written(counts), keys, stretches)
    inside = Window.partitionBy(*keys, "stretch").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("negative").over(inside), F.lit(0))
    positive = F.col("positive").cast("decimal(19,0)" if whole else "double")
    placed = dealt.withColumn("twice", positive * (2 * below + F.col("negative")).cast("decimal(19,0)" if whole else "double"))
    parts = placed.groupBy(*keys, "stretch").agg(
        F.sum("twice").cast(exact).alias("twice"), F.sum("positive").alias("positive"), F.sum("negative").alias("negative")
    )
    out = area_of_stretches(parts, keys, whole)
    # without groups an empty table still has its row
    return out if keys else out.select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_positive", F.lit(0)).alias("n_positive"), "auc")


def auc_of(df: DataFrame, score: str, label: str, by: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """``rank_auc`` of a score column."""
    return rank_auc(score_counts(df, score, label, by, weight), by)
