"""The Spark settings that the query semantics rest on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

# Division by zero and bad casts give NULL, names ignore case, instants are UTC.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "false",
    "spark.sql.caseSensitive": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Set SETTINGS on a session that is already there."""
    for key, value in SETTINGS.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return share_code(spark)


def local(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and small runs."""
    builder = SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", partitions)
    return configure(builder.config(map=SETTINGS).getOrCreate())


#: Bytes of rows that a Python worker gets at once; one row can be more.
BATCH_BYTES = 16 << 20


def share_code(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package from where the driver has it, whatever folder the driver was started in, and get rows in batches of bounded size."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])
    return spark
