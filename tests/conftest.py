from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tillroll.session import session  # noqa: E402
from tillroll.sources.schema import TRANSACTIONS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    out = session(
        "tests",
        "local[8]",
        {"spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


@pytest.fixture(scope="session")
def edge(spark):
    """Hand-made transactions: every rule about missing, zero and single values has a client."""
    rows = [
        # 1: a single transaction
        (1, "0 00:00:00", 5992, 1010, "a", "t1", 10.0),
        # 2: only positive amounts, one terminal missing
        (2, "3 10:00:00", 724, 1010, "a", None, 5.0),
        (2, "3 12:00:00", 724, 1010, "a", "t1", 7.0),
        (2, "10 12:00:00", None, 1020, "a", "t2", 9.0),
        # 3: only negative amounts
        (3, "4 09:00:00", 5813, 1010, "b", "t3", -4.0),
        (3, "5 09:00:00", 5813, 1010, "b", "t3", -6.0),
        # 4: only zeros
        (4, "6 01:00:00", 5611, 1010, "b", "t4", 0.0),
        (4, "6 02:00:00", 5611, 1010, "b", "t4", 0.0),
        # 5: one negative among positives, amounts missing, second 60
        (5, "219 23:59:60", 9753, 1010, "c", "t5", 3.0),
        (5, "220 08:00:00", 9754, 1010, "c", "t5", -8.0),
        (5, "456 12:00:00", 723, 1030, "c", "t6", 4.0),
        (5, "456 13:00:00", 723, 1030, "c", "t6", None),
        # 6: spend only on one weekday, income on another
        (6, "0 10:00:00", 5992, 1010, "d", "t1", -1.0),
        (6, "1 10:00:00", 5992, 1010, "d", "t1", 2.0),
        (6, "8 10:00:00", 5992, 1010, "d", "t1", 2.0),
    ]
    return spark.createDataFrame(rows, TRANSACTIONS)


@pytest.fixture(scope="session")
def skewed(spark):
    """Client 0 holds a third of all rows, one terminal of theirs most of these, and copies of one row are common."""
    from pyspark.sql import functions as F

    i = F.col("id")
    client = F.when(i % 3 == 0, F.lit(0)).otherwise(F.pmod(F.hash(i), F.lit(40)) + 1)
    copied = (client == 0) & (i % 4 == 0)
    out = spark.range(0, 3000, 1, 6).select(
        client.cast("long").alias("client_id"),
        F.when(copied, "7 10:11:12")
        .otherwise(F.concat_ws(" ", (F.pmod(F.hash(i, F.lit(1)), F.lit(30))).cast("string"),
                               F.concat(F.lpad((i % 24).cast("string"), 2, "0"), F.lit(":05:09"))))
        .alias("trans_time"),
        F.when(copied, 5992).when(i % 11 == 0, None).otherwise(700 + F.pmod(F.hash(i, F.lit(2)), F.lit(20)) * 400)
        .cast("int").alias("mcc_code"),
        F.when(copied, 1010).otherwise(1010 + (i % 5) * 10).cast("int").alias("trans_type"),
        F.concat(F.lit("city_"), (client % 7).cast("string")).alias("trans_city"),
        F.when(copied, "t0").when(i % 7 == 0, None)
        .otherwise(F.concat(F.lit("t"), F.pmod(F.hash(i, F.lit(3)), F.lit(9)).cast("string"))).alias("term_id"),
        F.when(copied, -12.5).when(i % 13 == 0, 0.0)
        .otherwise((F.pmod(F.hash(i, F.lit(4)), F.lit(20001)) - 10000) / 100.0).alias("amount"),
    )
    return out.cache()


@pytest.fixture(scope="session")
def skewed_labelled(skewed):
    from pyspark.sql import functions as F

    return skewed.withColumn("gender", (F.col("client_id") % 2).cast("int"))
