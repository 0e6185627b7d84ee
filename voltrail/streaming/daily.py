"""The rolling job driven by a file stream: each run works the windows that newly landed files touch."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from voltrail.plans.rolling import run_marked_day

KINDS = (68, 79)
NEXT = timedelta(days=1)


def follow(spark: SparkSession, landing: str, schema: StructType, read_days: Callable[[date, date], DataFrame],
           output: str, state: str, checkpoint: str, time: str = "ts", kinds: Sequence[int] = KINDS) -> StreamingQuery:
    """Process newly landed files under ``landing/kind=K/day=D`` once and stop (``availableNow``).

    The window of a day needs that day and the next, of every kind; it waits until all four have landed.
    A batch works again every window that its files touch, also old ones for messages that come late, and of the windows
    after them those whose predecessor has emitted something else than when they were worked last: ``state`` keeps, beside a row per
    landed kind and day, a mark of what each window emitted and of what it was worked against. Windows are replaced
    as a whole and marked afterwards, so a batch that is retried after a failure goes on where results and marks differ.
    """
    landed = spark.readStream.schema(schema).parquet(landing)

    def windows(batch: DataFrame, batch_id: int) -> None:
        fresh = batch.filter(F.col("kind").isin(*kinds)).select("kind", F.to_date(time).alias("day")).dropna().distinct()
        new = {(row["kind"], row["day"]) for row in fresh.collect()}  # one per kind and day
        if not new:
            return
        have = _landed(spark, state) | new
        complete = {day for _, day in have if all((kind, day) in have for kind in kinds)}
        ready = {day for day in complete if day + NEXT in complete}
        due = ready & {day - back for _, day in new for back in (NEXT, timedelta(0))}
        marks = _marks(spark, state)
        for day in sorted(day for day in ready if due and day >= min(due)):
            follows = day - NEXT in ready
            against = marks[day - NEXT][0] if follows else NOTHING
            if day in due or marks.get(day, ("", ""))[1] != against:
                _, emitted = run_marked_day(spark, read_days(day, day + NEXT), day, output, follows=follows)
                marks[day] = (emitted, against)
                spark.createDataFrame([marks[day]], MARKS).write.mode("overwrite").parquet(f"{_marks_path(state)}/day={day}")
        spark.createDataFrame(sorted(new), "kind int, day date").write.mode("append").parquet(state)

    return (landed.writeStream.foreachBatch(windows).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def _landed(spark: SparkSession, state: str) -> set[tuple[int, date]]:
    """Landed kinds and days; a few rows per day of operation."""
    schema = "kind int, day date"
    spark.createDataFrame([], schema).write.mode("append").parquet(state)
    return {(row["kind"], row["day"]) for row in spark.read.schema(schema).parquet(state).distinct().collect()}


MARKS = "emitted string, against string"
NOTHING = "nothing"


def _marks_path(state: str) -> str:
    return f"{state.rstrip('/')}-marks"


def _marks(spark: SparkSession, state: str) -> dict[date, tuple[str, str]]:
    """What each window emitted and what it was worked against; one row per day of operation."""
    spark.createDataFrame([], f"{MARKS}, day date").write.mode("append").partitionBy("day").parquet(_marks_path(state))
    rows = spark.read.schema(f"{MARKS}, day date").parquet(_marks_path(state)).collect()
    return {row["day"]: (row["emitted"], row["against"]) for row in rows}
