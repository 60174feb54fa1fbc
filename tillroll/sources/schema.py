"""Column types of the three input tables and of the predictions."""

from __future__ import annotations

from pyspark.sql import types as T

TRANSACTIONS = T.StructType(
    [
        T.StructField("client_id", T.LongType()),
        T.StructField("trans_time", T.StringType()),
        T.StructField("mcc_code", T.IntegerType()),
        T.StructField("trans_type", T.IntegerType()),
        T.StructField("trans_city", T.StringType()),
        T.StructField("term_id", T.StringType()),
        T.StructField("amount", T.DoubleType()),
    ]
)

LABELS = T.StructType([T.StructField("client_id", T.LongType()), T.StructField("gender", T.IntegerType())])

CLIENTS = T.StructType([T.StructField("client_id", T.LongType())])

# The texts pandas reads as missing by default.
MISSING_TEXTS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Names an unnamed first column gets from Spark and from pandas.
INDEX_COLUMNS = ["_c0", "Unnamed: 0"]
