"""Dead letters: events that could not be applied, with why, and which of them were sent again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..errors import UnavailableError
from ..sources import files

EVENT = "op string, type string, key string, payload string, targets int, offset long, occurred_at timestamp"
LETTER = f"{EVENT}, id string, error string, attempts int, failed_at timestamp"
EVENT_COLUMNS = ("op", "type", "key", "payload", "targets", "offset", "occurred_at")
#: Letters that are listed at once.
LISTED = 200


def unreplayed(letters: DataFrame, marks: DataFrame) -> DataFrame:
    """Letters without a mark that they were sent again."""
    return letters.join(marks.select("id").distinct(), "id", "left_anti").select(*letters.columns)


def counts(letters: DataFrame, marks: DataFrame) -> DataFrame:
    """(unreplayed, replayed)."""
    sent = marks.select("id", F.lit(True).alias("_sent")).distinct()
    return letters.join(sent, "id", "left").agg(F.count_if(F.col("_sent").isNull()).alias("unreplayed"), F.count_if("_sent").alias("replayed"))


@dataclass
class DeadLetters:
    """A folder of letters, one table for each failed batch, and of marks, one for each replay."""

    spark: SparkSession
    path: str

    def add(self, events: DataFrame, name: str, error: str, attempts: int) -> None:
        """Set events aside; idempotent by name. Nothing is written for no events."""
        rows = events.select(*EVENT_COLUMNS).withColumns({
            "id": F.concat_ws(":", F.lit(name), "type", "key", "offset"), "error": F.lit(error), "attempts": F.lit(attempts), "failed_at": F.current_timestamp(),
        })
        if not rows.isEmpty():
            rows.write.mode("overwrite").parquet(f"{self.path}/letters/{name}")

    def _table(self, name: str, schema: str) -> DataFrame:
        done = files.complete(self.spark, f"{self.path}/{name}")
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{name}/{n}" for n in done]) if done else self.spark.createDataFrame([], schema)

    def letters(self) -> DataFrame:
        return self._table("letters", LETTER)

    def marks(self) -> DataFrame:
        return self._table("marks", "id string, replayed_at timestamp")

    def list(self, limit: int = LISTED) -> DataFrame:
        """Letters that were not sent again, newest first."""
        return unreplayed(self.letters(), self.marks()).orderBy(F.desc("failed_at"), F.desc("offset")).limit(limit)

    def counts(self) -> DataFrame:
        return counts(self.letters(), self.marks())

    def replay(self, produce: Callable[[DataFrame], None], ids: list[str] | None = None) -> int:
        """Send letters (those of the ids, or all that are left) as events again and mark them; how many. A failure to send marks none."""
        rows = unreplayed(self.letters(), self.marks())
        rows = rows if ids is None else rows.where(F.col("id").isin(ids))
        # the number of the marks is fixed before anything is sent, so what arrives meanwhile stays
        name = f"m{len(files.names(self.spark, f'{self.path}/marks'))}"
        marks = rows.select("id", F.current_timestamp().alias("replayed_at"))
        n = marks.count()
        if n:
            try:
                produce(rows.select(*EVENT_COLUMNS))
            except Exception as e:
                raise UnavailableError("dead letters cannot be sent") from e
            marks.write.mode("errorifexists").parquet(f"{self.path}/marks/{name}")
        return n
