"""Intermediate tables, written to the shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """The cluster names the shared folder in ``spark.checkpoint.dir``; only a local session gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local"):
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="tillroll-"))
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")


def pinned(df: DataFrame) -> DataFrame:
    """A small ``df`` computed once and written to the checkpoint folder, so losing an executor loses nothing."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Paths handed out in this process and not discarded yet.
_handed_out: list[str] = []


def new_path(spark: SparkSession, kind: str = "table") -> str:
    """An unused path in the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{kind}-{uuid.uuid4()}"
    _handed_out.append(path)
    return path


def discard(spark: SparkSession) -> int:
    """Deletes the tables that this process has written with ``written`` and ``new_path``, and returns their number.

    To be called when the results that were built on them are stored: what is still to be computed from them fails afterwards.
    """
    number = len(_handed_out)
    for path in [*_handed_out]:
        drop(spark, path)
    return number


def drop(spark: SparkSession, path: str) -> None:
    """Deletes one path that ``new_path`` has handed out, when nothing reads it any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
    _handed_out.remove(path)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """The same for a table of any size that is read several times: Parquet, of which each reader takes its columns."""
    path = path or new_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
