"""Charges from a rising state of charge, trips set aside (method L)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from voltrail.operators.intervals import points_inside
from voltrail.operators.series import Carried, LongSeries, Series, as_series, carry, maximum_before, running_total, series_minimum, together
from voltrail.session import stage

KEYS = ("vehicle",)
ORDER = ("ts", "msg", "session")
TRIP_MARGIN = "INTERVAL 10 SECONDS"
MOVING_KM = (0.01, 50)
FILL_ROWS = 10
FILL_SECONDS = 600
REACH = FILL_ROWS + 4  # rows a flag can depend on, over all steps
TRIP_BIN = 4096  # message ids per bin
TOGETHER = 64  # overlapping trips that are carried in one row
MIN_GAIN = 1


def attach_trips(messages: DataFrame, trips: DataFrame, long: LongSeries | None = None, rows: int = 0) -> DataFrame:
    """Each status message with the trips its id falls in; trip times moved inwards by ten seconds.

    Trips that overlap one another are put together, so that what is left follows one after the other, and the last
    of it is carried along the message ids: in the partitioning by vehicle that the later steps use, and for a message as often as
    it was sent. A message keeps one row per trip that holds it, or one without a trip. Only trips among more than
    ``TOGETHER`` overlapping ones are looked up by bins of message ids. With ``long`` both tables are of long vehicles;
    ``rows`` is the number of messages where it is known.
    """
    spans = trips.filter("msg_first <= msg_last").select("vehicle", "msg_first", "msg_last", "trip_start", "trip_stop").withColumns({
        "trip_start_inner": F.col("trip_start") + F.expr(TRIP_MARGIN),
        "trip_stop_inner": F.col("trip_stop") - F.expr(TRIP_MARGIN)})
    groups, crowded = _trip_groups(spans, long)
    asking = messages.withColumns({"_at": F.col("msg"), "_kind": F.lit(1)})
    markers = groups.select("vehicle", F.col("first").alias("_at"), F.lit(0).alias("_kind"), "_trips")
    merged = together(asking.unionByName(markers, allowMissingColumns=True), KEYS, long, rows)
    series = carry(as_series(merged, KEYS, ("_at", "_kind", "ts", "session"), long), {"_last": Carried(F.col("_trips"))})
    holding = F.filter("_last", lambda t: F.col("msg").between(t["msg_first"], t["msg_last"]))
    names = ("trip_start", "trip_stop", "trip_start_inner", "trip_stop_inner")
    joined = series.own_rows().filter("_kind = 1").select(*messages.columns, F.explode_outer(holding).alias("_trip"))
    joined = joined.select(*messages.columns, *[F.col(f"_trip.{c}").alias(c) for c in names])
    if crowded is not None:
        key = ["vehicle", "msg"]
        inside = points_inside(messages.select(*key).distinct(), crowded, ["vehicle"], F.col("msg"), F.col("msg_first"),
                               F.col("msg_last"), TRIP_BIN, F.col("msg").between(F.col("msg_first"), F.col("msg_last")))
        found = inside.select(*key, *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_in"))
        joined = joined.join(found, key, "left").select(*messages.columns, *[F.when(F.col("_in"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in names])
    in_trip = F.col("ts").between(F.col("trip_start_inner"), F.col("trip_stop_inner"))
    return joined.withColumn("in_trip", F.when(in_trip, 1).otherwise(0))


def _trip_groups(spans: DataFrame, long: LongSeries | None) -> tuple[DataFrame, DataFrame | None]:
    """(vehicle, first, _trips): trips that overlap one another as one row each, and the trips of groups too large for a row, if there are any."""
    order = ("msg_first", "msg_last", "trip_start", "trip_stop")
    series = maximum_before(as_series(together(spans, KEYS, long), KEYS, order, long), "_reached", F.col("msg_last"))
    begins = F.when(F.col("msg_first") <= F.col("_reached"), 0).otherwise(1)
    numbered = stage(running_total(series, "_group", begins).own_rows(), "trips")
    key = ["vehicle", "_group"]
    crowded = stage(numbered.groupBy(*key).agg(F.count("*").alias("n")).filter(F.col("n") > TOGETHER).select(*key), "crowded")
    few = numbered
    if crowded.isEmpty():
        crowded = None
    else:
        few, crowded = numbered.join(crowded, key, "left_anti"), numbered.join(crowded, key, "left_semi").drop("_reached", "_group")
    trip = F.struct("msg_first", "msg_last", "trip_start", "trip_stop", "trip_start_inner", "trip_stop_inner")
    groups = few.groupBy(*key).agg(F.min("msg_first").alias("first"), F.collect_list(trip).alias("_trips"))
    return groups.drop("_group"), crowded


def _flag(condition):
    return F.when(condition, 1).otherwise(0)


def _flagged(messages: DataFrame, long: LongSeries | None) -> Series:
    series = as_series(messages, KEYS, ORDER, long, before=REACH, after=REACH)
    by = series.window()
    series = series.with_columns({
        "soc_drop": F.col("soc") - F.lead("soc").over(by),
        "km_run": F.col("km") - F.lag("km").over(by)})
    series = series.with_columns({"rising": _flag(F.col("soc_drop") < 0),
                                  "moving": _flag(F.col("km_run").between(*MOVING_KM))})
    series = series.with_columns({"rising_pair": _flag((F.lag("rising").over(by) == 1) | (F.col("rising") == 1)),
                                  "driving": _flag((F.col("in_trip") == 1) & (F.col("moving") == 1))})
    return series.with_columns({"charging": _flag((F.col("rising_pair") == 1) & (F.col("driving") == 0))})


def _filled(series: Series) -> Series:
    """Flat steps between charging rows close on both sides, then points that stand alone."""
    by = series.window()
    seconds = F.unix_seconds("ts")
    flagged_at = F.when(F.col("charging") == 1, seconds)
    last = F.last(flagged_at, ignorenulls=True).over(by.rowsBetween(-FILL_ROWS, -1))
    following = F.first(flagged_at, ignorenulls=True).over(by.rowsBetween(1, FILL_ROWS))
    series = series.with_columns({"_last": last, "_following": following})
    between = (seconds - F.col("_last") < FILL_SECONDS) & (F.col("_following") - seconds < FILL_SECONDS)
    series = series.with_columns({"filled": _flag((F.col("charging") == 1) | between)})
    alone = (F.lead("filled").over(by) == 0) & (F.lag("filled").over(by) == 0)
    series = series.with_columns({"kept": F.when(alone, 0).otherwise(F.col("filled"))})
    return series.with_columns({"_rise": F.col("kept") - F.lag("kept").over(by)})


def slope_flags(messages: DataFrame, long: LongSeries | None = None) -> DataFrame:
    """Per message: rising SOC, moving, in a trip, and the resulting charging flag."""
    return _flagged(messages, long).own_rows()


def slope_filled(messages: DataFrame, long: LongSeries | None = None) -> DataFrame:
    return _filled(_flagged(messages, long)).own_rows().drop("_last", "_following", "_rise")


def slope_numbered(messages: DataFrame, long: LongSeries | None = None) -> DataFrame:
    """Per message its charge number within the vehicle, 0 outside charges.

    A charge begins where the flag rises; a flag already up at the vehicle's first time
    begins none, so such rows get number 0.
    """
    series = series_minimum(_filled(_flagged(messages, long)), "_first", "ts")
    begins = F.when(F.col("ts") != F.col("_first"), F.when(F.col("_rise") == 1, 1)).otherwise(0)
    series = running_total(series, "_number", F.coalesce(begins, F.lit(0)))
    rows = series.own_rows().withColumn("charge_no", F.when(F.col("kept") == 0, 0).otherwise(F.col("_number")))
    return rows.drop("_last", "_following", "_rise", "_first", "_number")


def slope_sessions(numbered: DataFrame) -> DataFrame:
    """First and last time of each charge, with the SOC there, in one aggregation."""
    place = F.struct("ts", "msg", "session")
    sessions = numbered.filter(F.col("charge_no") > 0).groupBy("vehicle", "charge_no").agg(
        F.min("ts").alias("charge_start"), F.max("ts").alias("charge_stop"),
        F.min_by("soc", place).alias("soc_start"), F.max_by("soc", place).alias("soc_stop"))
    return sessions.withColumn("soc_gain", F.col("soc_stop") - F.col("soc_start")).withColumn("charging", F.lit(1))


def real_gain(sessions: DataFrame) -> DataFrame:
    return sessions.filter(F.col("soc_gain") > MIN_GAIN)
