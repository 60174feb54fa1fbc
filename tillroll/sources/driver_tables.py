"""Transactions, labels and unlabelled clients as views over the driver's order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One card transaction per line item, with the columns of ``schema.TRANSACTIONS``.

    Both joins are left to Spark: it broadcasts a side only under the session's
    size threshold and otherwise merges, with the adaptive split of hot keys.
    """
    line = table(spark, sf_dir, "lineitem")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    joined = line.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        customer, F.col("o_custkey") == F.col("c_custkey")
    )
    day = F.datediff("l_shipdate", F.lit("1995-01-01").cast("date")) % 457
    clock = [
        F.lpad(part.cast("string"), 2, "0")
        for part in (
            (F.col("l_orderkey") * 7 + F.col("l_linenumber") * 13) % 24,
            (F.col("l_partkey") * 11) % 60,
            F.col("l_orderkey") % 61,
        )
    ]
    part = F.col("l_partkey") % 20
    parity = F.col("o_custkey") % 2
    mcc = (
        F.when(part == 0, 5992)
        .when(part == 1, 5813)
        .when(part == 2, 5611)
        .when(part == 3, 5532)
        .when(part == 4, 5621)
        .when(part == 5, 742 + parity * 21)
        .otherwise(700 + ((F.col("l_partkey") * 37 + parity * (F.col("l_linenumber") % 2) * 50) % 300) * 31)
    )
    price = F.col("l_extendedprice")
    amount = (
        F.when(F.col("l_quantity") == 50, F.lit(0.0))
        .when(F.col("o_custkey") % 50 == 7, price)
        .when(F.col("o_custkey") % 50 == 8, -price)
        .when(F.col("l_returnflag") == "R", price)
        .otherwise(-price)
    )
    return joined.select(
        F.col("o_custkey").alias("client_id"),
        F.concat(day.cast("string"), F.lit(" "), F.concat_ws(":", *clock)).alias("trans_time"),
        mcc.cast("int").alias("mcc_code"),
        (1000 + F.col("l_linenumber") * 10).cast("int").alias("trans_type"),
        F.concat(F.lit("city_"), F.col("c_nationkey").cast("string")).alias("trans_city"),
        F.when(F.col("l_suppkey") % 10 != 0, F.col("l_suppkey").cast("string")).alias("term_id"),
        amount.alias("amount"),
    )


def row_bound(spark: SparkSession, sf_dir: str) -> int:
    """Most transactions there can be: orders and customers are looked up by key. Read from the file footers."""
    return table(spark, sf_dir, "lineitem").count()


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients whose gender is known."""
    key = F.col("c_custkey")
    return (
        table(spark, sf_dir, "customer")
        .filter((key % 11 != 0) & (key % 5 != 0))
        .select(key.alias("client_id"), (key % 2).cast("int").alias("gender"))
    )


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients whose gender is to be predicted."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").filter((key % 11 != 0) & (key % 5 == 0)).select(key.alias("client_id"))
