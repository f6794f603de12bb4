"""Tables that requests run over: Parquet files, lists of rows, raw SQL."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import EntityType, Registry
from ..session import share_code

#: The test tables and their keys.
KEYS = {
    "region": "r_regionkey", "nation": "n_nationkey", "supplier": "s_suppkey", "customer": "c_custkey", "part": "p_partkey", "orders": "o_orderkey",
    "lineitem": "l_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "labels": "doc_id", "pages": "page_id", "benchmark": "item_id", "conversations": "conv_id",
}


#: Tables of which several rows can have one key.
REPEATED = {"lineitem", "conversations"}


def parquet(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return share_code(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, names: Iterable[str], **types: EntityType) -> tuple[Registry, dict[str, DataFrame]]:
    """Types and frames of the named tables; types gives declarations that are more than a table's columns."""
    registry, frames = Registry(), {}
    for name in names:
        df = parquet(spark, sf_dir, name)
        frames[name] = df
        registry.register(types.get(name) or EntityType.of_frame(name, KEYS[name], df, unique=name not in REPEATED))
    return registry, frames


def sql(spark: SparkSession, text: str, **parameters) -> DataFrame:
    """Raw SQL with named parameters, for operators of this library and not for requests."""
    return spark.sql(text, args=parameters) if parameters else spark.sql(text)


def kafka_source(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", group: str = "fathom") -> DataFrame:
    """A changelog topic as a stream of (key, value, headers, partition, offset, timestamp); commits are the query's checkpoint."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    return reader.option("includeHeaders", "true").option("groupIdPrefix", group).load()


#: What a changelog's messages hold; key, offset and time are the broker's.
MESSAGE = "op string, type string, key string, payload string, targets int, occurred_at timestamp"
TRACE = "traceparent"


def decode_events(messages: DataFrame) -> DataFrame:
    """Messages of a changelog topic as events.

    The broker's offset is the event's: an entity's events share a partition, so it orders them. A message that is not
    an event has no type; it is kept as it is and goes to the dead letters.
    """
    body = F.from_json(F.col("value").cast("string"), MESSAGE)
    read = messages.withColumn("_body", body)
    return read.select(
        F.coalesce("_body.op", F.lit("unreadable")).alias("op"), F.col("_body.type").alias("type"), F.coalesce(F.col("key").cast("string"), F.col("_body.key")).alias("key"), F.when(F.col("_body.type").isNotNull(), F.col("_body.payload")).otherwise(F.col("value").cast("string")).alias("payload"),
        F.coalesce("_body.targets", F.lit(-1)).alias("targets"), F.col("offset").cast("long").alias("offset"), F.coalesce("_body.occurred_at", "timestamp").alias("occurred_at"),
    )


def encode_events(events: DataFrame, trace: str | None = None) -> DataFrame:
    """(key, value, headers) of events, as messages of a topic; the key keeps an entity's events in order."""
    names = [f.split()[0] for f in MESSAGE.split(", ")]
    header = F.array(F.struct(F.lit(TRACE).alias("key"), F.lit((trace or "").encode()).alias("value")))
    none = F.lit(None).cast("array<struct<key:string,value:binary>>")
    return events.select(F.col("key").cast("string").alias("key"), F.to_json(F.struct(*names)).alias("value"), (header if trace else none).alias("headers"))


def kafka_events(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    """A changelog topic as a stream of events, which a projection can follow."""
    return decode_events(kafka_source(spark, servers, topic))


def kafka_sink(events: DataFrame, servers: str, topic: str, checkpoint: str, trace: str | None = None):
    """Start writing a stream of events to a topic."""
    return encode_events(events, trace).writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).option("checkpointLocation", checkpoint).start()


def kafka_produce(servers: str, topic: str, trace: str | None = None):
    """What an outbox publishes by and dead letters are sent again by: a function that writes a batch of events to a topic."""
    return lambda events: encode_events(events, trace).write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def folder_stream(spark: SparkSession, path: str, schema: str, per_batch: int = 1, format: str = "json") -> DataFrame:
    """Event files of a folder as a stream, some files a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).format(format).load(path)
