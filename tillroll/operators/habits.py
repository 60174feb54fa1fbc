"""Group aggregates on every transaction: money, frequency and habits of the client."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.amounts import ratio, strictly_earned, strictly_spent
from tillroll.operators.hotkeys import DEFAULT, GroupStats, Limits, attach
from tillroll.operators.rollup import Measure

CLIENT = ("client_id",)


def _zero_filled(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns})


def _amounts() -> dict[str, Column]:
    amount = F.col("amount")
    return {"amount": amount, "spent": strictly_spent(amount), "earned": strictly_earned(amount)}


def _money(kind: str, name: str) -> Measure:
    return Measure(kind, name, _amounts()[name])


def _count(column: str) -> Measure:
    return Measure("count", column, F.col(column))


def money_per_transaction_stats() -> list[GroupStats]:
    return [
        GroupStats(
            CLIENT,
            {
                "Mean_net_money_per_transaction": _money("avg", "amount"),
                "Std_net_money_per_transaction": _money("std", "amount"),
                "Mean_spend_money_per_transaction": _money("avg", "spent"),
                "Mean_earn_money_per_transaction": _money("avg", "earned"),
                "Money_spend_std_per_transaction": _money("std", "spent"),
                "Mean_earn_std_per_transaction": _money("std", "earned"),
            },
        )
    ]


def money_all_stats() -> list[GroupStats]:
    return [
        GroupStats(
            CLIENT,
            {
                "ALL_money_net": _money("sum", "amount"),
                "ALL_money_spend": _money("sum", "spent"),
                "ALL_money_earn": _money("sum", "earned"),
            },
        )
    ]


def frequency_stats() -> list[GroupStats]:
    return [
        GroupStats(CLIENT, {"Frequency_of_spending_all": _count("day")}),
        GroupStats(
            ("client_id", "day"),
            {
                "Frequency_of_spending_per_day": _count("day"),
                "Hours_std_transaction_per_day": Measure("std", "hour", F.col("hour")),
            },
        ),
    ]


def habit_stats() -> list[GroupStats]:
    return [
        GroupStats(
            ("client_id", "term_id"),
            {
                "Terminal_habit": _count("term_id"),
                "Terminal_habit_sum_money": _money("sum", "amount"),
                "Terminal_habit_money": _money("avg", "amount"),
            },
        ),
        GroupStats(("client_id", "trans_type"), {"Service_habit": _count("trans_type")}),
        GroupStats(
            ("client_id", "mcc_code"),
            {
                "Product_habit_frequency": _count("mcc_code"),
                "Product_habit_sum_money": _money("sum", "amount"),
                "Product_habit_mean_money": _money("avg", "amount"),
            },
        ),
    ]


# Columns whose missing values become 0; the mean of all amounts stays missing.
KEEPS_NULL = {"Mean_net_money_per_transaction", "Frequency_of_spending_per_day"}


def earn_spend_ratio() -> Column:
    """Mean earning over the *deviation* of spending (as the feature is defined); 0/0 is 0."""
    return ratio(
        F.col("Mean_earn_money_per_transaction"), F.col("Money_spend_std_per_transaction"), both_zero=F.lit(0.0)
    )


def spend_earn_ratio() -> Column:
    """All spending over all earning; 0/0 stays missing."""
    return ratio(F.col("ALL_money_spend"), F.col("ALL_money_earn"))


def all_stats() -> list[GroupStats]:
    return merged([money_per_transaction_stats(), money_all_stats(), frequency_stats(), habit_stats()])


def merged(families: list[list[GroupStats]]) -> list[GroupStats]:
    """One entry per key list, so that each group is formed once."""
    by_keys: dict[tuple[str, ...], dict[str, Column | Measure]] = {}
    for stats in families:
        for s in stats:
            by_keys.setdefault(s.keys, {}).update(s.aggregates)
    return [GroupStats(keys, aggregates) for keys, aggregates in by_keys.items()]


def finished(df: DataFrame, stats: list[GroupStats]) -> DataFrame:
    """The rules on top of the attached aggregates: missing becomes 0, and the two ratios."""
    names = [name for s in stats for name in s.aggregates]
    out = _zero_filled(df, [n for n in names if n not in KEEPS_NULL])
    if "Frequency_of_spending_all" in names:
        # all rows by seven, not by the weeks the client was active
        out = out.withColumn("Frequency_of_spending_per_week", F.col("Frequency_of_spending_all") / F.lit(7.0))
    if "Mean_earn_money_per_transaction" in names:
        out = out.withColumn("Money_earn_spend_ratio_per_transaction", earn_spend_ratio())
    if "ALL_money_spend" in names:
        out = out.withColumn("ALL_money_spend_earn_ratio", spend_earn_ratio())
    return out


def with_stats(df: DataFrame, stats: list[GroupStats], limits: Limits = DEFAULT) -> DataFrame:
    return finished(attach(df, stats, "client_id", limits=limits), stats)


def money_per_transaction(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    return with_stats(df, money_per_transaction_stats(), limits)


def money_all(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    return with_stats(df, money_all_stats(), limits)


def frequency(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    return with_stats(df, frequency_stats(), limits)


def habits(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    return with_stats(df, habit_stats(), limits)


def with_code_count(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """How often the client used the code of the row; rows without a code match nothing and drop out."""
    return attach(
        df.filter(F.col("client_id").isNotNull() & F.col("mcc_code").isNotNull()),
        [GroupStats(("client_id", "mcc_code"), {"mcc_code_count": _count("mcc_code")})],
        "client_id",
        limits=limits,
    )
