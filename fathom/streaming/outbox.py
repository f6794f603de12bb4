"""The log of writes, which is the outbox as well: what was written is there until it is published.

A write is one append of its event, so a row and its outbox entry are stored together or not at all. What became of
each publishing is appended beside the log; entries without a success and with attempts left are pending.
"""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources import files
from .letters import EVENT, EVENT_COLUMNS

MARK = "offset long, ok boolean, error string, tried_at timestamp"
#: Entries that are published at once, tries of each, and seconds between two looks for pending ones.
BATCH, ATTEMPTS, EVERY = 100, 10, 30.0


def states(entries: DataFrame, marks: DataFrame) -> DataFrame:
    """entries with their attempts and whether one succeeded."""
    tried = marks.groupBy("offset").agg(F.count("*").alias("attempts"), F.bool_or("ok").alias("published"))
    return entries.join(tried, "offset", "left").withColumns({"attempts": F.coalesce("attempts", F.lit(0)), "published": F.coalesce("published", F.lit(False))})


def pending(entries: DataFrame, marks: DataFrame, size: int = BATCH, attempts: int = ATTEMPTS) -> DataFrame:
    """The oldest entries that are not published and have attempts left."""
    return states(entries, marks).where(~F.col("published") & (F.col("attempts") < attempts)).orderBy("offset").limit(size)


def counts(entries: DataFrame, marks: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """(pending, exhausted, published)."""
    open_ = ~F.col("published")
    return states(entries, marks).agg(
        F.count_if(open_ & (F.col("attempts") < attempts)).alias("pending"), F.count_if(open_ & (F.col("attempts") >= attempts)).alias("exhausted"), F.count_if("published").alias("published")
    )


@dataclass
class Log:
    """Events in the order of their offsets, in a folder; without one, in the driver's memory, for tests and trials."""

    spark: SparkSession
    path: str | None = None
    held: list[tuple] = field(default_factory=list)
    held_marks: list[tuple] = field(default_factory=list)

    def __post_init__(self) -> None:
        self._lock = threading.Lock()
        self._next = self.events().agg(F.coalesce(F.max("offset"), F.lit(-1))).first()[0] + 1 if self.path else 0

    def _table(self, name: str, schema: str, held: list[tuple]) -> DataFrame:
        if self.path is None:
            return self.spark.createDataFrame(held, schema)
        done = files.complete(self.spark, f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{n}" for n in done]) if done else self.spark.createDataFrame([], schema)

    def events(self) -> DataFrame:
        return self._table("events", EVENT, self.held)

    def marks(self) -> DataFrame:
        return self._table("marks", MARK, self.held_marks)

    def append(self, op: str, type_name: str, rows: list[tuple[str, str]], targets: int, when) -> int:
        """Store (key, payload) pairs as one write; the offset of the first."""
        with self._lock:
            first, self._next = self._next, self._next + len(rows)
            events = [(op, type_name, key, payload, targets, first + i, when) for i, (key, payload) in enumerate(rows)]
            if self.path is None:
                self.held += events
            else:
                self.spark.createDataFrame(events, EVENT).coalesce(1).write.parquet(f"{self.path}/events/e{first:020}")
            return first

    def pending(self, size: int = BATCH, attempts: int = ATTEMPTS) -> DataFrame:
        return pending(self.events(), self.marks(), size, attempts)

    def counts(self) -> DataFrame:
        return counts(self.events(), self.marks())

    def publish(self, produce: Callable[[DataFrame], None], size: int = BATCH, attempts: int = ATTEMPTS) -> tuple[int, int]:
        """Send one batch of pending entries and note what became of them: (published, failed)."""
        rows = self.pending(size, attempts).select(*EVENT_COLUMNS).collect()  # at most `size` rows
        if not rows:
            return 0, 0
        error = None
        try:
            produce(self.spark.createDataFrame([tuple(r) for r in rows], EVENT))
        except Exception as e:
            error = f"{type(e).__name__}: {e}"[:500]
        import datetime as dt

        marks = [(r.offset, error is None, error, dt.datetime.now(dt.timezone.utc)) for r in rows]
        with self._lock:
            if self.path is None:
                self.held_marks += marks
            else:
                name = len(files.names(self.spark, f"{self.path}/marks"))
                self.spark.createDataFrame(marks, MARK).coalesce(1).write.parquet(f"{self.path}/marks/m{name:020}")
        return (len(rows), 0) if error is None else (0, len(rows))

    def poll(self, produce: Callable[[DataFrame], None], every: float = EVERY, rounds: int | None = None) -> int:
        """Publish what is pending again and again; how many entries went out. rounds None: without end."""
        import time

        sent, done = 0, 0
        while rounds is None or done < rounds:
            n, failed = self.publish(produce)
            sent, done = sent + n, done + 1
            if not n and (rounds is None or done < rounds):
                time.sleep(every)
        return sent
