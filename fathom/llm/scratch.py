"""Tables an operator writes to cut lineage, in the folder that the whole cluster shares, and joins that split hot keys."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


def base(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where that setting is unset and all runs in one machine (as in tests)."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        place = "file://" + tempfile.mkdtemp(prefix="fathom-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def keep(df: DataFrame, partition_by: str | None = None) -> tuple[DataFrame, str]:
    """Write df as a table of the scratch folder; the frame that reads it, and its path for drop()."""
    spark = df.sparkSession
    path = f"{base(spark)}/fathom-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete scratch tables that nothing reads any more."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a scratch table on disk."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(place).getLength()


def small(df: DataFrame, path: str, most: int) -> DataFrame:
    """A scratch table, marked for broadcast if it has at most so many bytes on disk."""
    return F.broadcast(df) if table_bytes(df.sparkSession, path) <= most else df


def fresh(df: DataFrame, name: str) -> str:
    """A column name like `name` that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key is hot if more than one row in so many has it, so there are at most as many hot keys; parts that one is dealt to.
HOT_PART, SALTS = 2000, 64


def join_split(rows: DataFrame, table: DataFrame, keys: list[str], count: str, total: int, by: str, how: str = "inner") -> DataFrame:
    """rows joined to a written table that has each key once and, in `count`, how many of the `total` rows have it.

    Rows of a hot key are dealt to several tasks by the column `by`, and the key's row goes to each of them. What the
    driver gets is at most HOT_PART hashes. The column `count` stays.
    """
    hashed = F.xxhash64(*keys)
    hot = [r[0] for r in table.where(F.col(count) * HOT_PART > total).select(hashed).limit(HOT_PART).collect()]
    if not hot:
        return rows.join(table, keys, how)
    salt = fresh(rows.join(table.limit(0), keys, how), "_salt")
    ours = rows.withColumn(salt, F.when(hashed.isin(hot), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(F.lit(0)).cast("int"))
    theirs = table.withColumn(salt, F.explode(F.when(hashed.isin(hot), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return ours.join(theirs, [*keys, salt], how).drop(salt)
