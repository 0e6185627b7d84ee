"""Compare two runs over the same vehicles, and correct clocks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from voltrail.functions.clock import corrected_time, seconds_between
from voltrail.operators.dedup import first_per_key
from voltrail.operators.event_series import numbered

EVENT_KEY = ("vehicle", "session", "msg", "event")
DRIFT_LIMIT_SECONDS = 86400


def run_difference(first: DataFrame, second: DataFrame, key: Sequence[str] = EVENT_KEY, time: str = "time") -> DataFrame:
    """Rows of the first run with the time of the same row in the second run, and the seconds between."""
    a = first.withColumnRenamed(time, "time_first")
    b = second.select(*key, F.col(time).alias("time_second"))
    return a.join(b, list(key), "left").withColumn("diff", F.unix_seconds("time_first") - F.unix_seconds("time_second"))


def difference_summary(diffs: DataFrame) -> DataFrame:
    return diffs.agg(F.min("diff").alias("least"), F.max("diff").alias("greatest"),
                     F.count(F.when(F.col("diff").isNull(), 1)).alias("missing"), F.count("*").alias("n"))


def run_drift(first: DataFrame, second: DataFrame) -> DataFrame:
    """Mean seconds between the n-th events of both runs per vehicle; flagged beyond a day."""
    order = ("time", "msg", "event")
    a = numbered(first, order).select("vehicle", "row_no", F.col("time").alias("time_first"))
    b = numbered(second, order).select("vehicle", "row_no", F.col("time").alias("time_second"))
    paired = a.join(b, ["vehicle", "row_no"])
    gap = F.unix_seconds("time_first") - F.unix_seconds("time_second")
    drift = paired.groupBy("vehicle").agg(F.avg(gap).alias("mean_diff"), F.count("*").alias("pairs"))
    return drift.withColumn("drifts", F.abs("mean_diff") > DRIFT_LIMIT_SECONDS)


def clock_differences(first: DataFrame, second: DataFrame, clocks: Sequence[str], limit_seconds: int = 3600) -> DataFrame:
    """Messages for which any clock of the first run is less than ``limit_seconds`` ahead of the second's."""
    key = ["vehicle", "session", "msg"]
    other = second.select(*key, *[F.col(c).alias(f"_{c}") for c in clocks])
    joined = first.select(*key, *clocks).join(other, key, "left")
    joined = joined.select(*key, *[seconds_between(F.col(f"_{c}"), F.col(c)).alias(f"diff_{c}") for c in clocks])
    near = F.lit(False)
    for clock in clocks:
        near = near | (F.col(f"diff_{clock}") < limit_seconds)
    return joined.filter(near)


def correct_clock(events: DataFrame, closes: DataFrame) -> DataFrame:
    """Event times by their distance to the session's close, where the close is known."""
    one = first_per_key(closes, ["vehicle", "session"], [F.col("close_ts").desc(), F.col("close_rts").desc()])
    joined = events.join(one.select("vehicle", "session", "close_ts", "close_rts"), ["vehicle", "session"], "left")
    fixed = corrected_time(F.col("ts"), F.col("rts"), F.col("close_ts"), F.col("close_rts"))
    return joined.withColumn("ts", fixed).drop("close_ts", "close_rts")
