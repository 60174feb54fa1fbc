"""Writers for predictions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "_manifest"


def write_predictions(scored: DataFrame, path: str) -> None:
    """Client and probability of every transaction as a folder of CSV parts with a header."""
    scored.select("client_id", "probability").write.mode("overwrite").option("header", True).csv(path)


def commit_predictions(scored: DataFrame, path: str, parts: int | None = None) -> str:
    """The same in two phases, so that readers see a whole result or the one before it, and a job may be run again at any time.

    Parts are written to a folder of their own first. They are read back and counted, and only then the manifest, one small file which
    is written last, names that folder. A run that fails leaves the manifest as it was; ``read_predictions`` follows the manifest
    alone. Rows are dealt by content, so the parts of a repeated run are the same. Returns the folder of the parts.
    """
    spark = scored.sparkSession
    rows = scored.select(F.col("client_id").cast("long").alias("client_id"), F.col("probability").cast("double").alias("probability"))
    number = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    folder = f"parts-{uuid.uuid4()}"
    rows.repartition(number, "client_id", "probability").sortWithinPartitions("client_id", "probability").write.option(
        "header", True
    ).csv(f"{path}/{folder}")
    sums = _sums(_parts(spark, f"{path}/{folder}")).withColumn("folder", F.lit(folder))
    sums.select("folder", "rows", "clients", "lowest", "highest").coalesce(1).write.json(f"{path}/{MANIFEST}/{folder}")
    return folder


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row for each committed run: its folder, rows, clients, least and largest probability, and when it was committed."""
    schema = "folder string, rows long, clients long, lowest double, highest double"
    read = spark.read.schema(schema).option("recursiveFileLookup", "true").json(f"{path}/{MANIFEST}")
    return read.select("*", F.col("_metadata.file_modification_time").alias("committed"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The predictions of the last committed run; fails where its parts no longer add up to its manifest."""
    last = manifests(spark, path).orderBy(F.desc("committed"), F.desc("folder")).first()
    if last is None:
        raise FileNotFoundError(f"{path} has no committed predictions")
    out = _parts(spark, f"{path}/{last['folder']}")
    found = _sums(out).first()
    if found["rows"] != last["rows"] or found["clients"] != last["clients"]:
        raise ValueError(f"{path}/{last['folder']} has {found['rows']} rows, its manifest {last['rows']}")
    return out


def _parts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("client_id long, probability double").option("header", True).csv(path)


def _sums(rows: DataFrame) -> DataFrame:
    clients = rows.groupBy("client_id").agg(F.count(F.lit(1)).alias("n"), F.min("probability").alias("low"), F.max("probability").alias("high"))
    return clients.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("client_id").alias("clients"),
        F.min("low").alias("lowest"), F.max("high").alias("highest"),
    )
