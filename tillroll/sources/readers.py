"""Readers for transactions, labels and unlabelled clients (CSV or Parquet)."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillroll.sources.schema import CLIENTS, INDEX_COLUMNS, LABELS, MISSING_TEXTS, TRANSACTIONS


def _typed(field: T.StructField, source: T.DataType) -> Column:
    """One column cast to its type; texts that stand for "missing" and NaN become NULL."""
    value = F.col(f"`{field.name}`")
    if isinstance(source, T.StringType):
        value = F.when(~value.isin(MISSING_TEXTS), value)
    if isinstance(field.dataType, T.StringType):
        typed = value.cast("string")
    elif isinstance(field.dataType, T.DoubleType):
        typed = F.nanvl(value.try_cast("double"), F.lit(None).cast("double"))
    elif isinstance(source, T.StringType):
        # through decimal, so that "5992.0" (a code column that once held a gap) stays readable
        typed = value.try_cast("decimal(38,6)").try_cast(field.dataType)
    else:
        typed = value.try_cast(field.dataType)
    return typed.alias(field.name)


def _given(field: T.StructField, source: T.DataType) -> Column:
    """Whether a column holds something, that is not one of the texts that stand for "missing" and not NaN."""
    value = F.col(f"`{field.name}`")
    if isinstance(source, T.StringType):
        return value.isNotNull() & ~value.isin(MISSING_TEXTS)
    return value.isNotNull() & ~F.isnan(value) if isinstance(source, T.DoubleType | T.FloatType) else value.isNotNull()


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    raw, types = _raw(spark, path, schema, fmt)
    return raw.select(*[_typed(f, types[f.name]) for f in schema])


def checked(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv") -> tuple[DataFrame, Observation]:
    """The typed rows with ``rejects``: the columns whose text could not be read as their type, with that text.

    The observation counts ``rows``, ``rejected`` rows and, as ``bad_<column>``, the cells of each column, in the same scan as whatever
    action is run on the rows; ``accepted`` and ``rejected`` part them.
    """
    raw, types = _raw(spark, path, schema, fmt)
    bad = {f.name: _given(f, types[f.name]) & _typed(f, types[f.name]).isNull() for f in schema}
    found = [F.when(b, F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value"))) for c, b in bad.items()]
    rows = raw.select(*[_typed(f, types[f.name]) for f in schema], F.filter(F.array(*found), lambda x: x.isNotNull()).alias("rejects"))
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("rows"), F.count_if(F.size("rejects") > 0).alias("rejected")]
    return rows.observe(seen, *counts, *[F.count_if(_holds(c)).alias(f"bad_{c}") for c in bad]), seen


def _holds(column: str) -> Column:
    return F.exists("rejects", lambda x: x["column_name"] == column)


def accepted(rows: DataFrame) -> DataFrame:
    """Rows of ``checked`` in which every cell was read."""
    return rows.filter(F.size("rejects") == 0).drop("rejects")


def rejected(rows: DataFrame) -> DataFrame:
    """Rows of ``checked`` with the cells that were not read."""
    return rows.filter(F.size("rejects") > 0)


def _raw(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> tuple[DataFrame, dict[str, T.DataType]]:
    if fmt == "csv":
        raw = spark.read.option("header", True).csv(path)
    elif fmt == "parquet":
        raw = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown format {fmt!r}: csv or parquet")
    raw = raw.drop(*INDEX_COLUMNS)
    missing = [f.name for f in schema if f.name not in raw.columns]
    if missing:
        raise ValueError(f"{path} lacks the columns {missing}")
    return raw, {f.name: f.dataType for f in raw.schema}


def read_transactions(spark: SparkSession, base: str, name: str = "transactions.csv", fmt: str = "csv") -> DataFrame:
    return _read(spark, os.path.join(base, name), TRANSACTIONS, fmt)


def read_labels(spark: SparkSession, base: str, name: str = "train.csv", fmt: str = "csv") -> DataFrame:
    return _read(spark, os.path.join(base, name), LABELS, fmt)


def read_clients(spark: SparkSession, base: str, name: str = "test.csv", fmt: str = "csv") -> DataFrame:
    return _read(spark, os.path.join(base, name), CLIENTS, fmt)
