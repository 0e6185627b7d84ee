"""Method S over rolling two-day windows.

Day by day (:func:`run_days`) is the production job: it reads two days, drops the
charges the window before has already emitted, and writes the rest. For a backfill
:func:`all_windows` computes every window in one parallel plan, keyed by (window, vehicle), and
then settles which charges are new.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltrail.plans import status_method
from voltrail.session import stage
from voltrail.sources.sinks import window_path, write_marked_window

WINDOW_KEYS = ("window", "vehicle")
EMITTED = ("vehicle", "msg_start", "msg_stop")
CHARGE_KEY = ["vehicle", "window", "msg_start", "msg_stop"]


def _repeats(start: str, stop: str, earlier_start: str, earlier_stop: str):
    """A charge that starts within an earlier one, or stops with it, was emitted before."""
    return F.col(start).between(F.col(earlier_start), F.col(earlier_stop)) | (F.col(stop) == F.col(earlier_stop))


def without_emitted(charges: DataFrame, emitted: DataFrame) -> DataFrame:
    """Charges that the previous window has not emitted."""
    old = emitted.select(F.col("vehicle").alias("_vehicle"), F.col("msg_start").alias("_start"), F.col("msg_stop").alias("_stop"))
    same = (F.col("vehicle") == F.col("_vehicle")) & _repeats("msg_start", "msg_stop", "_start", "_stop")
    return charges.join(old, same, "left_anti")


def run_days(spark: SparkSession, read_days: Callable[[date, date], DataFrame], first: date, end: date,
             output: str) -> dict[date, int]:
    """Write the new charges of each day in [first, end) to ``output``; returns rows per day.

    ``read_days(a, b)`` gives the unified battery table of the days a to b. What the window before has
    emitted is read from its folder in the output.
    """
    counts = {}
    day = first
    while day < end:
        counts[day] = run_day(spark, read_days(day, day + timedelta(days=1)), day, output, follows=day > first)
        day += timedelta(days=1)
    return counts


def run_day(spark: SparkSession, battery: DataFrame, day: date, output: str, follows: bool) -> int:
    """One window, after the one of the day before if it ``follows`` it; returns the number of new charges."""
    return run_marked_day(spark, battery, day, output, follows)[0]


def run_marked_day(spark: SparkSession, battery: DataFrame, day: date, output: str, follows: bool) -> tuple[int, str]:
    """:func:`run_day`, with a mark of what the next window reads of this one: equal marks, equal effect."""
    charges = status_method.charges(battery, F.lit(day))
    if follows:
        emitted = spark.read.schema(charges.schema).parquet(window_path(output, day - timedelta(days=1)))
        charges = without_emitted(charges, emitted)
    return write_marked_window(charges, output, day, EMITTED)


def in_windows(battery: DataFrame, first: date, end: date) -> DataFrame:
    """Each row once per window it belongs to: the one that starts on its day and the one before."""
    day = F.to_date("ts")
    both = F.array(F.struct(day.alias("window"), F.lit(1).alias("part")),
                   F.struct(F.date_sub(day, 1).alias("window"), F.lit(2).alias("part")))
    spread = battery.select("*", F.inline(both))
    return spread.filter((F.col("window") >= F.lit(first)) & (F.col("window") < F.lit(end)))


def all_windows(battery: DataFrame, first: date, end: date) -> DataFrame:
    """New charges of every window in [first, end), as :func:`run_days` would emit them."""
    windows = in_windows(battery, first, end).drop("part")
    charges = stage(status_method.charges(windows, F.col("window"), WINDOW_KEYS))
    new = _new_charges(charges.select(*CHARGE_KEY))
    return charges.join(new, CHARGE_KEY, "left_semi")


def _new_charges(keys: DataFrame) -> DataFrame:
    """Decide which charges are new when each window only knows the one before.

    A charge is new when no *new* charge of the window before repeats it. Charges without such a
    neighbour are new at once; the others follow in rounds, one per link of a chain. A round reads
    and writes only what is still open: the charges it decides are set aside. Within a window
    a vehicle's charges are disjoint and last over five minutes, so there are few candidates per key.
    """
    earlier = keys.select("vehicle", F.date_add("window", 1).alias("window"), F.col("window").alias("_window"),
                          F.col("msg_start").alias("_start"), F.col("msg_stop").alias("_stop"))
    links = keys.join(earlier, ["vehicle", "window"]).filter(_repeats("msg_start", "msg_stop", "_start", "_stop"))
    links = stage(links)
    linked = links.select(*CHARGE_KEY).distinct()
    decided = stage(keys.join(linked, CHARGE_KEY, "left_anti").select(*CHARGE_KEY, F.lit(True).alias("new")))
    new = [decided]
    while not links.isEmpty():
        known = decided.select("vehicle", F.col("window").alias("_window"), F.col("msg_start").alias("_start"),
                               F.col("msg_stop").alias("_stop"), F.col("new").alias("_new"))
        judged = links.join(known, ["vehicle", "_window", "_start", "_stop"], "left")
        verdict = judged.groupBy(*CHARGE_KEY).agg(
            F.max(F.coalesce(F.col("_new"), F.lit(False))).alias("_repeated"), F.count("_new").alias("_known"), F.count("*").alias("_n"))
        settled = F.when(F.col("_repeated"), False).when(F.col("_known") == F.col("_n"), True)
        decided = stage(verdict.select(*CHARGE_KEY, settled.alias("new")).filter("new is not null"))
        new.append(decided.filter("new"))
        open_ = judged.join(decided.select(*CHARGE_KEY), CHARGE_KEY, "left_anti")
        links = stage(open_.filter(F.col("_new").isNull()).select(links.columns))  # links to old charges repeat nothing
    return reduce(DataFrame.unionByName, new).select(*CHARGE_KEY)
