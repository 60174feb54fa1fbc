"""The two feature sets: of the scoring script and of the validated training."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillroll.functions.amounts import with_signed_amounts
from tillroll.functions.mcc import mcc_group
from tillroll.functions.timeparts import with_time_parts
from tillroll.operators import clients
from tillroll.operators.habits import all_stats, finished
from tillroll.operators.hotkeys import DEFAULT, GroupStats, Hot, Limits, hot_keys, with_lookups, with_windows
from tillroll.operators.lineage import written
from tillroll.operators.scaling import winsorized

HELPERS = ["amount_up", "amount_down", "weekday", "trans_time", "trans_ts", "day_mod7", "n_rows"]


def _assembled(df: DataFrame, features: DataFrame, stats: list[GroupStats], hot: Hot) -> DataFrame:
    """Group aggregates and client features on every row; the rows are exchanged once, on ``client_id``.

    The wide client features come last, so that the sorts of the windows do not carry them.
    """
    if hot.keys is None:
        return with_windows(df, stats, "client_id", hot.rows).join(features, "client_id")
    cold_features, hot_features = hot.split(features)
    return hot.apply(
        df,
        lambda rows: with_windows(rows, stats, "client_id", hot.rows).join(cold_features, "client_id"),
        lambda rows: with_lookups(rows, stats, "client_id", hot.limit).join(F.broadcast(hot_features), "client_id"),
    )


def scoring_features(df: DataFrame, winsorize: bool = True, limits: Limits = DEFAULT) -> DataFrame:
    """Features of the scoring script, one row per transaction.

    ``winsorize`` cuts the amounts behind the client profile and the income
    minus spend difference at the 5 % and 95 % percentile of the given rows.
    """
    df = df if limits.none_hot() else written(df)
    hot = hot_keys(df, ["client_id"], limits)
    rows = with_time_parts(df)
    signed = with_signed_amounts(rows)
    if winsorize:
        signed = winsorized(signed, list(clients.SIDES), limits=limits)
    further: dict[str, Column] = {**clients.weekday_means(), "all_time_freq": clients.days_per_transaction()}
    features = clients.client_features(signed, further, winsorize, hot, limits).drop("n_rows")
    stats = all_stats()
    out = finished(_assembled(rows, features, stats, hot), stats)
    return (
        out.withColumn("mcc_describe", mcc_group(F.col("mcc_code")))
        .withColumn("time", F.col("hour"))
        .drop("hour", *HELPERS)
    )


def training_features(df: DataFrame, limits: Limits = DEFAULT) -> DataFrame:
    """Features of the validated training: raw amounts, weekday columns, transactions per day."""
    df = df if limits.none_hot() else written(df)
    hot = hot_keys(df, ["client_id"], limits)
    rows = with_time_parts(df)
    signed = clients.with_weekday(with_signed_amounts(rows), "second")
    further = {**clients.weekday_aggregates(), "all_time_freq": clients.transactions_per_day()}
    features = (
        clients.client_features(signed, further, False, hot, limits)
        .drop("n_rows")
        .withColumnsRenamed(clients.NUNIQUE_ALIASES)
    )
    out = clients.joined_back(rows, features, hot)
    return out.withColumn("mcc_describe", mcc_group(F.col("mcc_code"))).drop(
        "amount", "term_id", "day", "time", "hour", *HELPERS
    )


def with_original_names(df: DataFrame) -> DataFrame:
    """The difference column under its original name, which needs back-quotes in Spark."""
    return df.withColumnRenamed("delta_up_down", "delta+-")
