"""Sharding by weighted rendezvous hashing, in DataFrame functions only.

Each record key draws one number u in (0, 1) for each shard from a hash of (key, shard); the shard with the least
-ln(u) / weight takes the record. A further shard draws numbers of its own and leaves the others' as they are, so a
record either stays where it is or goes to the new shard; shares follow the weights.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, Window

#: Hexadecimal digits of the ranges into which the rows of a shard are cut for numbering, and the ranges: no task holds more than one range of one shard.
DIGITS = 3
RANGES = 16**DIGITS
#: Rows of the table of ranges up to which it is broadcast; a row has three numbers.
BROADCAST_ROWS = 1 << 20


def draw(key: Column, shard: int, seed: str = "") -> Column:
    """A number in (0, 1) that depends on key and shard alone: 52 bits of an MD5."""
    word = F.concat_ws(":", F.lit(f"{seed}{shard}"), F.coalesce(key.cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.md5(word), 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 52))


def shard_of(key: Column, weights: Sequence[float], seed: str = "") -> Column:
    """The shard (0 ..) of a key. Shards of weight 0 take nothing; ties go to the lower number."""
    if not any(w > 0 for w in weights):
        raise ValueError("one shard at least needs a positive weight")
    costs = [F.struct((-F.ln(draw(key, i, seed)) / F.lit(float(w))).alias("cost"), F.lit(i).alias("shard")) for i, w in enumerate(weights) if w > 0]
    return (F.array_min(F.array(*costs))["shard"]).cast("int")


def assign(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (1.0,) * 8, added: float = 1.0, seed: str = "") -> DataFrame:
    """One row for each row of df: its shard, its gapless slot in the shard, and the shard with one more shard.

    Size is the text's UTF-8 bytes plus 1 (null text: 1). A null id is a key of its own. Rows that repeat an id share
    its shard and get slots of their own, equal rows in any order. An empty table gives an empty result; other columns
    are ignored, so their names cannot clash. Texts are never shuffled, only their sizes and checksums. Slots are numbered
    in ranges of a key hash: counts of (shard, range) are summed in a table of at most shards x RANGES rows.
    """
    key = F.col(id_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(
        key.alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        shard_of(key, weights, seed).alias("shard"), shard_of(key, [*weights, added], seed).alias("grown_shard"),
    )
    digest = F.md5(F.concat_ws(":", F.lit("slot"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col("text_crc32")))
    rows = rows.withColumn("_range", F.conv(F.substring(digest, 1, DIGITS), 16, 10).cast("int"))
    counts = rows.groupBy("shard", "_range").agg(F.count("*").alias("_count"))
    before = Window.partitionBy("shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "_range", F.coalesce(F.sum("_count").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("shard", "_range").orderBy("doc_id", "text_crc32", "size")
    placed = rows.withColumn("_at", F.row_number().over(inside) - 1).join(F.broadcast(starts) if len(weights) * RANGES <= BROADCAST_ROWS else starts, ["shard", "_range"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("_start") + F.col("_at")).cast("long").alias("slot"), "grown_shard")
