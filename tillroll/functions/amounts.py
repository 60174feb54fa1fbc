"""Signed amounts and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: what an infinite ratio is replaced by.
INFINITE_RATIO = 1000.0


def income(amount: Column) -> Column:
    """Amounts of at least zero; zero counts on both sides."""
    return F.when(amount >= 0, amount)


def spend(amount: Column) -> Column:
    """Size of amounts of at most zero; zero counts on both sides."""
    return F.when(amount <= 0, F.abs(amount))


def with_signed_amounts(df: DataFrame) -> DataFrame:
    return df.withColumns({"amount_up": income(F.col("amount")), "amount_down": spend(F.col("amount"))})


def strictly_spent(amount: Column) -> Column:
    return F.when(amount < 0, amount)


def strictly_earned(amount: Column) -> Column:
    return F.when(amount > 0, amount)


def ratio(part: Column, whole: Column, both_zero: Column | None = None) -> Column:
    """|part| / |whole|; x/0 is 1000 and 0/0 is ``both_zero`` (NULL by default)."""
    empty = F.lit(None).cast("double") if both_zero is None else both_zero
    return F.when(whole == 0, F.when(part == 0, empty).otherwise(F.lit(INFINITE_RATIO))).otherwise(
        F.abs(part) / F.abs(whole)
    )
