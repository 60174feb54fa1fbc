"""Quality of columns and shape of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_profile(df: DataFrame) -> DataFrame:
    """Type, missing and present values of every column, from one aggregation."""
    total = F.count(F.lit(1))
    lines = [
        F.struct(
            F.lit(name).alias("column_name"),
            F.lit(dtype).alias("data_type"),
            (total - F.count(name)).alias("n_null"),
            F.count(name).alias("n_non_null"),
        )
        for name, dtype in df.dtypes
    ]
    return df.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


def table_shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))
