"""Winsorising and min-max scaling of whole columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.operators.hotkeys import DEFAULT, Limits
from tillroll.operators.percentiles import column_percentiles

# The tails that are cut off, and the scale of the min-max form.
LOW, HIGH = 0.05, 0.95
SCALE = 1000.0


def winsorized(
    df: DataFrame,
    columns: Sequence[str],
    low: float = LOW,
    high: float = HIGH,
    weight: Column | None = None,
    limits: Limits = DEFAULT,
) -> DataFrame:
    """Values beyond the ``low`` and ``high`` percentile of their column become that percentile; NULL stays."""
    bounds = column_percentiles(df, columns, [low, high], weight, limits)
    return df.withColumns(
        {
            c: F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), floor), ceiling))
            for c, (floor, ceiling) in bounds.items()
        }
    )


def minmax_scaled(df: DataFrame, columns: Sequence[str], scale: float = SCALE) -> DataFrame:
    """Columns mapped linearly from [min, max] to [0, scale]; a constant column becomes 0."""
    ends = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])
    out = {}
    for c in columns:
        low, high = ends.select(f"min_{c}").scalar(), ends.select(f"max_{c}").scalar()
        out[c] = F.when(F.col(c).isNotNull() & (high == low), F.lit(0.0)).otherwise(
            (F.col(c) - low) / F.nullif(high - low, F.lit(0.0)) * F.lit(scale)
        )
    return df.withColumns(out)
