"""Session settings the library is designed for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "tillroll", master: str | None = None, conf: dict[str, str] | None = None) -> SparkSession:
    """A session with the settings the plans rely on; ``conf`` entries win.

    ``spark.shuffle.accurateBlockSkewedFactor`` keeps the true size of skewed
    shuffle blocks in large map statuses, without which the adaptive skew split
    cannot see a hot key once a stage has more than 2000 reducers.
    ``forceOptimizeSkewedJoin`` splits it even where an aggregation after the
    join then needs an exchange of its own.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.shuffle.accurateBlockSkewedFactor": "5.0",
        "spark.sql.autoBroadcastJoinThreshold": "64MB",
    }
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
