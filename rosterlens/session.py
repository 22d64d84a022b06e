"""A Spark session with the settings the models are meant to run under."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Split skewed partitions even where that costs another shuffle later.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Recording where each column was made costs more than making it.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def session(app: str = "rosterlens", **settings: str) -> SparkSession:
    """Master, memory, shuffle partitions and the checkpoint folder come from the submit command."""
    builder = SparkSession.builder.appName(app)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
