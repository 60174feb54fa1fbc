"""Attaching labels and restricting to clients."""

from __future__ import annotations

from pyspark.sql import DataFrame


def labelled(transactions: DataFrame, labels: DataFrame) -> DataFrame:
    """Transactions of labelled clients, with ``gender``.

    Spark picks the join by size: labels under the session's broadcast threshold
    are broadcast, larger ones merge on ``client_id`` with the adaptive split of
    clients that hold many rows.
    """
    return transactions.join(labels, "client_id", "inner")


def of_clients(transactions: DataFrame, clients: DataFrame) -> DataFrame:
    """Transactions of the given clients; a client listed twice does not repeat rows."""
    return transactions.join(clients, "client_id", "left_semi")


def day_time(transactions_labelled: DataFrame) -> DataFrame:
    """The frame of the cohort questions: gender, MCC, day, time, hour."""
    return transactions_labelled.selectExpr("gender", "mcc_code AS MCC", "day", "time", "hour")
