"""Changelogs to projections: of each key the event with the highest offset holds, deletes are tombstones.

A projection is a folder of a base and deltas. Each micro-batch writes one delta: its last event of each key, with its
offset, a deleted key as a tombstone. Reading takes the highest offset of each key over all of them, so batches may come
late, twice or in any order and a late event never brings back what a later one has replaced or deleted. Deltas are
folded into a new base now and then.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..operators.writes import latest
from ..schema import EntityType
from ..sources import files
from .letters import DeadLetters

EVENT_SCHEMA = "op string, type string, key string, payload string, targets int, offset long, occurred_at timestamp"
# Bits of the stores that an event is meant for.
COLUMNAR, VECTOR, ENRICHMENT = 1, 2, 4
#: The bit of the rows that the log itself comes to, whatever stores they go to.
RECORDS = 8
MAX_ATTEMPTS = 3
#: Deltas that are folded into a new base.
FOLD_AFTER = 16


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each (type, key) by offset."""
    return latest(events, ["type", "key"], [F.desc("offset")])


def loose(t: EntityType) -> T.StructType:
    """A type's columns, all of which may be null."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in t.spark_schema()])


def split_events(events: DataFrame, t: EntityType, target: int = COLUMNAR) -> tuple[DataFrame, DataFrame]:
    """(good, bad): the events of a type that are meant for a store, parsed to `row`; those that cannot be parsed."""
    # a message that could not be read is of no type, and everyone's
    own = events.where((F.col("type").isNull() | (F.lower("type") == t.name.lower())) & (F.col("targets").bitwiseAND(target) != 0))
    own = own.withColumn("row", F.from_json("payload", loose(t))).withColumn("op", F.lower("op"))
    deleted = F.col("op") == "deleted"
    fine = F.col("key").isNotNull() & (deleted | (F.col("op").isin("created", "updated") & F.col(f"row.`{t.key}`").isNotNull()))
    fine = F.coalesce(fine & F.col("type").isNotNull(), F.lit(False))
    return own.where(fine), own.where(~fine).drop("row")


def rederived(good: DataFrame, t: EntityType, records: DataFrame) -> DataFrame:
    """Parsed events whose rows have the tenant and owner of the stored record, whatever the payload says; none without a record."""
    roles = [c for c in (t.tenant_field, t.owner_field) if c]
    if not roles:
        return good
    stored = records.select(F.col(f"`{t.key}`").cast("string").alias("_key"), *[F.col(f"`{c}`").alias(f"_{c}") for c in roles])
    joined = good.join(stored, good["key"] == F.col("_key"), "left")
    fields = [(F.col(f"`_{f.name}`").cast(f.dataType) if f.name in roles else F.col(f"row.`{f.name}`")).alias(f.name) for f in loose(t)]
    row = F.when(F.col("row").isNotNull(), F.struct(*fields))
    return joined.select(*[row.alias("row") if c == "row" else F.col(f"`{c}`") for c in good.columns])


def delta(events: DataFrame, t: EntityType, target: int = COLUMNAR, records: DataFrame | None = None) -> DataFrame:
    """(the type's columns, _key, _offset, _deleted): the last event of each key. A row without a tenant belongs to nobody and is passed over."""
    good, _ = split_events(events, t, target)
    if records is not None:
        good = rederived(good, t, records)
    if t.tenant_field:
        good = good.where((F.col("op") == "deleted") | F.col(f"row.`{t.tenant_field}`").isNotNull())
    deleted = F.col("op") == "deleted"
    own = [F.when(~deleted, F.col(f"row.`{f.name}`")).alias(f.name) for f in loose(t)]
    return last_events(good).select(*own, F.col("key").alias("_key"), F.col("offset").alias("_offset"), deleted.alias("_deleted"))


def folded(deltas: DataFrame) -> DataFrame:
    """Of each key what the highest offset says, tombstones too."""
    own = [c for c in deltas.columns if c != "_key"]
    return deltas.groupBy("_key").agg(F.max_by(F.struct(*own), "_offset").alias("_last")).select(*[F.col(f"_last.`{c}`") if c != "_key" else F.col("_key") for c in deltas.columns])


def living(deltas: DataFrame, t: EntityType) -> DataFrame:
    """The rows that deltas in any order come to."""
    return folded(deltas).where(~F.col("_deleted")).select(*[F.col(f"`{n}`") for n in t.names])


def merge(stored: DataFrame, events: DataFrame, t: EntityType, target: int = COLUMNAR, records: DataFrame | None = None) -> DataFrame:
    """stored after events that are all later than it: rows are replaced in full or deleted."""
    last = delta(events, t, target, records)
    key = F.col(f"`{t.key}`").cast("string")
    kept = stored.withColumn("_key", key).join(last.select("_key"), "_key", "left_anti").drop("_key")
    return kept.unionByName(last.where(~F.col("_deleted")).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in stored.schema]))


@dataclass
class Projection:
    """A type's rows in a folder, kept in step with a changelog. records: stored rows that tenants and owners are read from."""

    spark: SparkSession
    type: EntityType
    path: str
    target: int = COLUMNAR
    records: Callable[[], DataFrame] | None = None
    fold_after: int = FOLD_AFTER

    def parts(self) -> tuple[int, list[str]]:
        """(number of the newest base or -1, the folders that the projection is read from)."""
        done = files.complete(self.spark, self.path)
        base = max((int(n[1:]) for n in done if n.startswith("b")), default=-1)
        deltas = sorted(int(n[1:]) for n in done if n.startswith("d") and int(n[1:]) > base)
        return base, [f"{self.path}/b{base}"] * (base >= 0) + [f"{self.path}/d{n}" for n in deltas]

    def _all(self, folders: list[str]) -> DataFrame:
        schema = T.StructType([*loose(self.type), T.StructField("_key", T.StringType()), T.StructField("_offset", T.LongType()), T.StructField("_deleted", T.BooleanType())])
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        return living(self._all(self.parts()[1]), self.type)

    def top_offset(self) -> int:
        """The highest offset applied; -1 before the first."""
        return self._all(self.parts()[1]).agg(F.coalesce(F.max("_offset"), F.lit(-1))).first()[0]

    def apply(self, events: DataFrame) -> None:
        """Merge one micro-batch as a new delta. A batch that comes again changes nothing, as its offsets are the same."""
        records = self.records() if self.records else None
        number = max((int(n[1:]) for n in files.names(self.spark, self.path) if n[1:].isdigit()), default=-1) + 1
        delta(events, self.type, self.target, records).write.mode("overwrite").parquet(f"{self.path}/d{number}")
        if len(self.parts()[1]) > self.fold_after:
            self.fold()

    def fold(self) -> None:
        """Write base and deltas as a new base. What it replaces stays until the next one, for those who read it.

        Tombstones stay, too, for events that come late.
        """
        base, folders = self.parts()
        numbers = [int(f.rpartition("/")[2][1:]) for f in folders]
        if not folders or max(numbers) == base:
            return
        folded(self._all(folders)).write.mode("overwrite").parquet(f"{self.path}/b{max(numbers)}")
        old = [n for n in files.names(self.spark, self.path) if n[1:].isdigit() and (int(n[1:]) < base or n == f"d{base}")]
        files.delete(self.spark, *[f"{self.path}/{n}" for n in old])

    def follow(self, events: DataFrame, checkpoint: str, dead: str | None = None, once: bool = True, attempts: int = MAX_ATTEMPTS, wait: float = 1.0):
        """Start keeping the projection in step with a stream.

        Events that cannot be read go to the dead letters in the folder `dead` at once, a batch that fails `attempts` times as a
        whole; then the stream goes on. Without dead letters, or if they cannot be written, it halts.
        """
        letters = DeadLetters(self.spark, dead) if dead else None

        def handle(batch: DataFrame, number: int) -> None:
            good, bad = split_events(batch, self.type, self.target)
            try:
                with_retries(lambda: self.apply(batch), attempts, wait)
            except Exception as e:
                if letters is None:
                    raise
                letters.add(good.drop("row").unionByName(bad), f"a{number}", f"{type(e).__name__}: {e}"[:500], attempts)
                return
            if letters is not None:
                letters.add(bad, f"p{number}", "payload cannot be read", 1)

        writer = events.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer).start()


def with_retries(action: Callable[[], None], attempts: int = MAX_ATTEMPTS, wait: float = 1.0) -> None:
    """Run action; after failures again, waiting 1, 2, 4 ... times `wait` seconds."""
    import time

    for k in range(attempts):
        try:
            return action()
        except Exception:
            if k == attempts - 1:
                raise
            time.sleep(wait * 2**k)


def reconcile(rows: DataFrame, t: EntityType, targets: int = COLUMNAR | VECTOR | ENRICHMENT, above: int = 0) -> DataFrame:
    """Every row as an `updated` event, to project a type anew.

    Their offset is `above`, the highest one in use (Projection.top_offset): older events lose to them, later ones win.
    """
    return rows.select(
        F.lit("updated").alias("op"), F.lit(t.name).alias("type"), F.col(f"`{t.key}`").cast("string").alias("key"), F.to_json(F.struct("*")).alias("payload"),
        F.lit(targets).alias("targets"), F.lit(above).cast("long").alias("offset"), F.current_timestamp().alias("occurred_at"),
    )


def enrichment_hash(t: EntityType) -> Column:
    """SHA-256 of an entity's source texts and of what is asked for: equal hashes need no new enrichment."""
    spec = ";".join(f"{c.name}={c.enrichment}:{c.hint}" for c in t.columns if c.enrichment)
    sources = [F.coalesce(F.col(f"`{c.name}`"), F.lit("")) for c in t.columns if c.kind == "string" and not c.array and not c.enrichment and c.name not in (t.key, t.tenant_field, t.owner_field)]
    return F.sha2(F.concat_ws("\x1f", *sources, F.lit(spec)), 256)


def to_enrich(rows: DataFrame, t: EntityType, state: DataFrame) -> DataFrame:
    """Rows whose hash is not the stored one of (key, hash); so an enrichment's own write-back changes nothing."""
    hashed = rows.withColumn("_hash", enrichment_hash(t))
    return hashed.join(state.select(F.col("key").alias("_key"), F.col("hash").alias("_old")), F.col(f"`{t.key}`").cast("string") == F.col("_key"), "left").where(~F.col("_hash").eqNullSafe(F.col("_old"))).drop("_key", "_old")


def keep_running(start: Callable[[], object], wait: float = 10.0, restarts: int | None = None) -> int:
    """Start a streaming query and wait for it; start it again, from its checkpoint, whenever it fails. Gives the restarts."""
    import time

    done = 0
    while True:
        try:
            start().awaitTermination()
            return done
        except Exception:
            if restarts is not None and done >= restarts:
                raise
            done += 1
            time.sleep(wait)
