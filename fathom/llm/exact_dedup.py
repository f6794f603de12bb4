"""Exact dedup by distributed MSD radix partitioning.

Documents are split by successive blocks of their UTF-8 bytes. A group whose members agree on all bytes so far
is split again by the next block; a document leaves as soon as its group has one member (it is unique) or its
bytes have ended (all members of its group are equal). Equality is decided by the bytes alone, never by a digest.
Blocks grow by a factor, so a text of n bytes takes about log(n) rounds, and only rows whose prefix is shared are
carried on, without the bytes that are already compared.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from . import scratch

#: Bytes of the first block, the factor by which blocks grow, and the largest block.
FIRST_BLOCK, GROWTH, LARGEST_BLOCK = 64, 16, 1 << 20
#: Shared prefixes of the first round are broadcast up to so many bytes on disk; beyond, both sides are shuffled.
BROADCAST_BYTES = 24 << 20


def _shared(rows: DataFrame, keys: list[str], name: str) -> tuple[DataFrame, str]:
    """One row for each key that at least two rows have: its size, largest id and a number that is its own."""
    found = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.max("_id").alias("_keep"), F.min(name).alias("_next"))
    return scratch.keep(found.where("_n > 1"))


def dedup_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", first_block: int = FIRST_BLOCK, growth: int = GROWTH) -> DataFrame:
    """One row for each row of df: id, keep_id (largest id of the equal texts), group_size, kept, text_sha256.

    Null text counts as empty text. Rows that repeat both id and text are one document seen several times: each
    counts in group_size and all have the same `kept`. A null id stays only if its group has no other. There are no
    ties but such rows. An empty table gives an empty result; other columns are ignored, so their names cannot clash.
    """
    spark = df.sparkSession
    own = df.select(F.col(id_col).alias("_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("_rest"))
    id_type = own.schema["_id"].dataType.simpleString()
    own = own.withColumn("_sha", F.sha2("_rest", 256))
    block, grow = first_block, max(2, growth)

    def cut(rows: DataFrame) -> DataFrame:
        return rows.withColumn("_digit", F.substring("_rest", 1, block))

    def split(rows: DataFrame) -> DataFrame:
        """Rows that leave have no bytes left to carry; the others keep what follows this block."""
        ended = F.length("_digit") < block
        state = F.when(F.col("_n").isNull(), "alone").when(ended, "ended").otherwise("open")
        return rows.select("_id", "_sha", "_n", "_keep", F.coalesce("_next", F.lit(0)).cast("long").alias("_g"), F.when(state == "open", F.expr(f"substring(_rest, {block + 1})")).alias("_rest"), state.alias("_state"))

    done = []
    rows = cut(own)
    total = rows.count()
    shared, at = _shared(rows.withColumn("_r", F.monotonically_increasing_id()), ["_digit"], "_r")
    if scratch.table_bytes(spark, at) <= BROADCAST_BYTES:
        joined = rows.join(F.broadcast(shared), ["_digit"], "left")
    else:
        joined = scratch.join_split(rows, shared, ["_digit"], "_n", total, "_id", "left")
    before = None
    while True:
        table, place = scratch.keep(split(joined), "_state")
        # what was carried on is read, and what it met is not needed any more
        scratch.drop(spark, at, *([f"{before}/_state=open"] if before else []))
        done.append(table.where("_state <> 'open'").select("_id", "_sha", "_n", "_keep"))
        open_rows = table.where("_state = 'open'").select("_id", "_sha", "_g", "_rest")
        total, before = open_rows.count(), place
        if not total:
            break
        block = min(block * grow, LARGEST_BLOCK)
        rows = cut(open_rows)
        shared, at = _shared(rows.withColumn("_r", F.monotonically_increasing_id()), ["_g", "_digit"], "_r")
        joined = scratch.join_split(rows, shared, ["_g", "_digit"], "_n", total, "_id", "left")
    out = reduce(DataFrame.unionAll, done)
    keep = F.when(F.col("_n").isNull(), F.col("_id")).otherwise(F.col("_keep")).cast(id_type)
    return out.select(
        F.col("_id").alias("doc_id"), keep.alias("keep_id"), F.coalesce("_n", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"), F.col("_sha").alias("text_sha256"),
    )


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that stay, with all their columns; rows that repeat an id and text stay together. Empty for an empty table.

    df is written once with numbers of its rows, which say which of them go.
    """
    key = scratch.fresh(df, "_row")
    rows, _ = scratch.keep(df.withColumn(key, F.monotonically_increasing_id()))
    wide = F.struct(rows[id_col].alias("id"), rows[key].alias("row"))
    found = dedup_groups(rows.select(wide.alias("_wide"), rows[text_col].alias("_text")), "_wide", "_text")
    # the largest (id, row) of a group stays, and with it all rows of its id
    gone = found.where(~F.col("doc_id.id").eqNullSafe(F.col("keep_id.id"))).select(F.col("doc_id.row").alias(key))
    return rows.join(gone, key, "left_anti").drop(key)
