"""Refine method-L charges with the status of message 79."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.functions.clock import hours_between
from voltrail.operators.dedup import first_per_key, number_globally
from voltrail.operators.intervals import points_inside
from voltrail.operators.series import Carried, LongSeries, as_series, carry
from voltrail.session import stage_buckets

# Charge status codes.
STATUS_NAMES = {0: "no_charging", 1: "ongoing", 2: "failure", 3: "remote", 4: "finished"}
NO_CHARGING, ONGOING, FINISHED = 0, 1, 4
TIME_BIN = 4 * 3600  # seconds per bin
BIN, NO_BIN = "_time_bin", -(2 ** 62)
LATE_HOURS = 2


def status_messages(summary: DataFrame) -> DataFrame:
    """One status row per (vehicle, message id)."""
    return first_per_key(summary.select("vehicle", "session", "msg", "ts", "status"), ["vehicle", "msg"],
                         [F.col("session"), F.col("ts"), F.col("status")]).drop("session")


def binned(messages: DataFrame) -> DataFrame:
    """Messages with the time bin that they lie in; those without a time share one."""
    return messages.withColumn(BIN, F.coalesce(F.floor(F.unix_seconds("ts") / TIME_BIN), F.lit(NO_BIN)))


def in_buckets(messages: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """A written table of messages by vehicle and time bin. Steps that meet it on both, or look from bin to bin, read it without a
    shuffle; a vehicle with many messages lies in many buckets."""
    return stage_buckets(binned(messages), ("vehicle", BIN), order, name)


def first_charges(charges: DataFrame) -> DataFrame:
    return first_per_key(charges, ["vehicle", "charge_start"], [F.col("charge_stop"), F.col("charge_no")])


def status_spans(charges: DataFrame, statuses: DataFrame) -> DataFrame:
    """First and last message of each status inside each charge, and their times.

    One pass over the messages inside charges serves the five statuses.
    """
    spans = charges.select("vehicle", "charge_start", "charge_stop")
    inside = points_inside(statuses, spans, ["vehicle"], F.unix_seconds("ts"), F.unix_seconds("charge_start"),
                           F.unix_seconds("charge_stop"), TIME_BIN,
                           F.col("ts").between(F.col("charge_start"), F.col("charge_stop")), BIN if BIN in statuses.columns else None)
    found = []
    for code, name in STATUS_NAMES.items():
        msg = F.when(F.col("status") == code, F.col("msg"))
        found += [F.min(msg).alias(f"{name}_first"), F.min_by("ts", msg).alias(f"{name}_first_ts"),
                  F.max(msg).alias(f"{name}_last"), F.max_by("ts", msg).alias(f"{name}_last_ts")]
    key = ["vehicle", "charge_start", "charge_stop"]
    joined = charges.join(inside.groupBy(*key).agg(*found), key, "left")
    return joined.withColumns({"start": F.coalesce("ongoing_first_ts", "charge_start"),
                               "stop": F.coalesce("finished_first_ts", "charge_stop")})


def charge_ids(charges: DataFrame) -> DataFrame:
    """Number the charges over all vehicles by (vehicle, start)."""
    return number_globally(charges, ["vehicle", "start", "charge_start"], "charge_id")


def status_asof(charges: DataFrame, statuses: DataFrame, long: LongSeries | None = None) -> DataFrame:
    """Each status message with the last charge of its vehicle that started at or before it."""
    marker = charges.select("vehicle", F.col("start").alias("ts"), F.lit(0).alias("_kind"),
                            F.lit(None).cast("long").alias("msg"), F.lit(None).cast("int").alias("status"),
                            F.struct("charge_start", "start", "stop").alias("_charge"))
    rows = statuses.select("vehicle", "ts", F.lit(1).alias("_kind"), "msg", F.col("status").cast("int").alias("status"))
    merged = rows.unionByName(marker, allowMissingColumns=True).withColumn("_begun", F.col("_charge.charge_start"))
    series = as_series(merged, ("vehicle",), ("ts", "_kind", "_begun", "msg"), long, after=1)
    series = carry(series, {"_open": Carried(F.col("_charge"))})
    by = series.window()
    following = F.when(F.lead("_kind").over(by) == 1, F.lead("status").over(by))
    merged = series.with_columns({"next_status": following}).own_rows().filter("_kind = 1")
    return merged.select("vehicle", "ts", "msg", "status", "next_status", F.col("_open.charge_start").alias("charge_start"),
                         F.col("_open.start").alias("start"), F.col("_open.stop").alias("stop"))


def status_asof_in_bins(charges: DataFrame, statuses: DataFrame) -> DataFrame:
    """:func:`status_asof` over a table of :func:`in_buckets`, whose messages stay where they are.

    One row per vehicle and bin tells its messages which charges begin in the bin, which one was begun before, and what the first message after the
    bin is. A message shows the next one's status if no charge begins between them, which is so if both have the same charge.
    """
    charge = F.struct("start", "charge_start", "stop")
    begun = binned(charges.withColumn("ts", F.col("start"))).groupBy("vehicle", BIN).agg(F.array_sort(F.collect_list(charge)).alias("_begun"))
    first = F.min_by(F.struct("ts", "status"), F.struct("ts", "msg"))
    cells = statuses.groupBy("vehicle", BIN).agg(first.alias("_first")).join(begun, ["vehicle", BIN], "full_outer")
    bins = Window.partitionBy("vehicle").orderBy(BIN)
    before = F.last(F.element_at("_begun", -1), ignorenulls=True).over(bins.rowsBetween(Window.unboundedPreceding, -1))

    def open_at(ts: Column) -> Column:
        return F.coalesce(F.try_element_at(F.filter("_begun", lambda c: c["start"] <= ts), F.lit(-1)), F.col("_before"))

    cells = cells.withColumn("_before", before).filter(F.col("_first").isNotNull())
    shown = F.struct(F.col("_first.status").alias("status"), open_at(F.col("_first.ts")).alias("charge"))
    cells = cells.withColumn("_after", F.lead(shown).over(bins)).drop("_first")
    rows = statuses.join(cells, ["vehicle", BIN], "left").withColumn("_open", open_at(F.col("ts")))
    here = Window.partitionBy("vehicle", BIN).orderBy("ts", "msg")
    following = F.coalesce(F.lead(F.struct("status", F.col("_open").alias("charge"))).over(here), F.col("_after"))
    rows = rows.withColumn("_next", following)
    return rows.select("vehicle", "ts", "msg", F.col("status").cast("int").alias("status"),
                       F.when(F.col("_next.charge").eqNullSafe(F.col("_open")), F.col("_next.status")).cast("int").alias("next_status"),
                       F.col("_open.charge_start").alias("charge_start"), F.col("_open.start").alias("start"), F.col("_open.stop").alias("stop"))


def late_status(asof: DataFrame) -> DataFrame:
    """First message after a charge's stop that shows it going on (then ended), or finished."""
    after = F.col("ts") > F.col("stop")

    def first(condition: Column, name: str) -> list[Column]:
        msg = F.when(condition & after, F.col("msg"))
        return [F.min(msg).alias(name), F.min_by("ts", msg).alias(f"{name}_ts")]

    ongoing = (F.col("status") == ONGOING) & (F.col("next_status") == NO_CHARGING)
    finished = F.col("status") == FINISHED
    late = asof.filter(after & (ongoing | finished))
    return late.groupBy("vehicle", "charge_start").agg(*first(ongoing, "late_ongoing"), *first(finished, "late_finished"))


def late_stop(charges: DataFrame, late: DataFrame) -> DataFrame:
    """Move the stop to the late message when none finished inside and it is under two hours away."""
    joined = charges.join(late, ["vehicle", "charge_start"], "left")
    joined = joined.withColumn("late_stop", F.least("late_finished_ts", "late_ongoing_ts")).withColumns({
        "late_finished_hours": hours_between(F.col("stop"), F.col("late_finished_ts")),
        "late_ongoing_hours": hours_between(F.col("stop"), F.col("late_ongoing_ts")),
        "late_stop_hours": hours_between(F.col("stop"), F.col("late_stop"))})
    moved = F.col("finished_first_ts").isNull() & F.col("late_stop").isNotNull() & (F.col("late_stop_hours") < LATE_HOURS)
    return joined.withColumn("stop", F.when(moved, F.col("late_stop")).otherwise(F.col("stop")))
