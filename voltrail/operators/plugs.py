"""Plug and unplug events, and charges between them (method S)."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, functions as F

from voltrail.functions import battery as B
from voltrail.functions.clock import seconds_between
from voltrail.operators.battery_log import ORDER
from voltrail.operators.series import Carried, LongSeries, Series, as_series, carry, neighbours
from voltrail.schemas import CHARGE_STATUS_COLUMNS

IN_PROGRESS = 1
SIDE_COLUMNS = ("session", "msg_type", "msg", "ts", "rts", "load_level", "summary_soc", "soc", "charge_mode", "status")
CHARGE_ORDER = ("msg_start", "msg_stop")
MERGE_SECONDS = 60
MIN_SECONDS = 300
MAX_SECONDS = 2 * 24 * 3600


def plug_edges(df: DataFrame, keys: Sequence[str] = ("vehicle",), long: LongSeries | None = None) -> DataFrame:
    """Rows where charging begins (plug) or ends (unplug), by the status of the row before."""
    return edges(as_series(df, keys, ORDER, long, before=1)).own_rows()


def edges(series: Series) -> Series:
    """:func:`plug_edges` within a series that is cut with a row before each piece. From here on rows are events, without copies."""
    series = series.with_columns({"_previous": F.lag("status").over(series.window())})
    charging, was = F.col("status").eqNullSafe(IN_PROGRESS), F.col("_previous")
    event = F.when((was != IN_PROGRESS) & charging, "plug").when((was == IN_PROGRESS) & ~charging, "unplug")
    return series.with_columns({"event": event}).without("_previous").where(F.col("event").isNotNull()).owned("events")


def alternate(events: DataFrame, keys: Sequence[str] = ("vehicle",), long: LongSeries | None = None) -> DataFrame:
    """Keep plugs not followed by a plug and unplugs not preceded by an unplug, in one pass."""
    return alternating(as_series(events.filter(F.col("event").isNotNull()), keys, ORDER, long)).own_rows()


def alternating(series: Series) -> Series:
    series = neighbours(series, {"_before": "event"}, {"_after": "event"})
    plug = (F.col("event") == "plug") & F.coalesce(F.col("_after") == "unplug", F.lit(True))
    unplug = (F.col("event") == "unplug") & F.coalesce(F.col("_before") == "plug", F.lit(True))
    return series.where(plug | unplug).without("_before", "_after")


def _side(source: str, suffix: str) -> list[Column]:
    return [F.col(f"{source}.{c}").alias(f"{c}_{suffix}") for c in SIDE_COLUMNS]


def pair_events(events: DataFrame, keys: Sequence[str] = ("vehicle",), long: LongSeries | None = None) -> DataFrame:
    """Charges as plug and unplug side by side; events without a partner keep an empty other side.

    An unplug belongs to the last plug before it, so the plug is carried along the event
    series; no pair of events is ever compared.
    """
    return paired(as_series(events, keys, ORDER, long)).own_rows()


def paired(series: Series) -> Series:
    """:func:`pair_events` within a series of events; a charge stands where its unplug stood."""
    side = F.struct(*[c for c in SIDE_COLUMNS], "vtype")
    is_plug = F.col("event") == "plug"
    series = carry(series, {
        "_start": Carried(F.when(is_plug, side)),
        "_next_plug": Carried(F.when(is_plug, F.col("msg")), backward=True, include_self=False),
        "_next_event": Carried(F.col("event"), backward=True, include_self=False)})
    lonely = is_plug & ~F.col("_next_event").eqNullSafe("unplug")
    series = series.where(~is_plug | lonely).with_columns({"_stop": F.when(~is_plug, side)})
    return series.select([F.col("_start.vtype").alias("vtype"), *series.keys, *_side("_start", "start"),
                          F.when(F.col("_start").isNotNull(), F.col("_next_plug")).alias("next_msg_start"),
                          *_side("_stop", "stop")], CHARGE_ORDER)


def within_days(day: Column | date) -> Column:
    """Start and stop lie between 30 days before and 2 days after ``day``."""
    base = day if isinstance(day, Column) else F.lit(day)
    earliest, latest = F.date_sub(base, 30).cast("timestamp"), F.date_add(base, 2).cast("timestamp")
    return F.col("ts_start").between(earliest, latest) & F.col("ts_stop").between(earliest, latest)


def sane_times(charges: DataFrame, day: Column | date) -> DataFrame:
    """Charges whose start and stop lie between 30 days before and 2 days after ``day``."""
    return charges.filter(within_days(day))


def charge_gaps(charges: DataFrame, keys: Sequence[str] = ("vehicle",), long: LongSeries | None = None) -> DataFrame:
    """Neighbouring charges and the seconds to them."""
    return spaced(as_series(charges, keys, CHARGE_ORDER, long)).own_rows()


def spaced(series: Series) -> Series:
    """:func:`charge_gaps` within a series of charges."""
    series = neighbours(series, {"previous_msg_stop": "msg_stop", "previous_ts_stop": "ts_stop"},
                        {"following_msg_start": "msg_start", "following_ts_start": "ts_start"})
    return series.with_columns({
        "gap_before": seconds_between(F.col("previous_ts_stop"), F.col("ts_start")),
        "gap_after": seconds_between(F.col("ts_stop"), F.col("following_ts_start"))})


def group_charges(charges: DataFrame, keys: Sequence[str] = ("vehicle",), long: LongSeries | None = None,
                  stop_gap: str = "previous", merge_seconds: int = MERGE_SECONDS) -> DataFrame:
    """Rebuild charges from the starts and stops that are not next to a short break.

    Starts count when the gap before them is longer than ``merge_seconds``. With
    ``stop_gap="previous"`` stops are judged by that same gap, so a charge after a short break
    is left out; with ``"next"`` they are judged by the gap after them, which merges the two.
    Charges of one vehicle follow one another, as :func:`pair_events` makes them.
    """
    return regrouped(as_series(charges, keys, CHARGE_ORDER, long), stop_gap, merge_seconds).own_rows()


def regrouped(series: Series, stop_gap: str = "previous", merge_seconds: int = MERGE_SECONDS) -> Series:
    """:func:`group_charges` within a series of charges with their gaps.

    The last counting start is carried along the charges to each counting stop. A stop on the very message of the next counting
    start has that start as its last one, and no charge ends there.
    """
    gap = {"previous": "gap_before", "next": "gap_after"}.get(stop_gap)
    if gap is None:
        raise ValueError(f"unknown stop_gap {stop_gap!r}")

    def apart(column: str) -> Column:
        return F.coalesce(F.col(column) > merge_seconds, F.lit(True))

    start = [f"{c}_start" for c in SIDE_COLUMNS]
    stop = [f"{c}_stop" for c in SIDE_COLUMNS]
    series = carry(series, {"_open": Carried(F.when(apart("gap_before"), F.struct("vtype", *start))),
                            "_next": Carried(F.when(apart("gap_before"), F.col("msg_start")), backward=True, include_self=False)})
    ends = apart(gap) & (F.col("_open.msg_start") < F.col("msg_stop")) & ~F.col("_next").eqNullSafe(F.col("msg_stop"))
    series = series.where(ends).select([F.col("_open.vtype").alias("vtype"), *series.keys, *[F.col(f"_open.{c}").alias(c) for c in start],
                                        F.col("_next").alias("next_msg_start"), *stop], CHARGE_ORDER)
    series = series.with_columns({"soc_gain": F.col("soc_stop") - F.col("soc_start")})
    return series.where((F.col("soc_gain") >= 0) & F.col("vtype").isin(B.BEV, B.PHEV))


def charge_indicators(charges: DataFrame) -> DataFrame:
    """Duration, speed, power and power class."""
    charges = charges.withColumn("duration", seconds_between(F.col("ts_start"), F.col("ts_stop")))
    charges = charges.withColumn("speed", B.charge_speed(F.col("soc_gain"), F.col("duration")))
    charges = charges.withColumn("power", B.charge_kw(F.col("vtype"), F.col("speed")))
    return charges.withColumn("power_class", B.power_class(F.col("power")))


def plausible_duration(charges: DataFrame) -> DataFrame:
    return charges.filter((F.col("duration") > MIN_SECONDS) & (F.col("duration") < MAX_SECONDS))


def charge_columns(charges: DataFrame, keys: Sequence[str] = ("vehicle",)) -> DataFrame:
    extra = [k for k in keys if k not in CHARGE_STATUS_COLUMNS]
    return charges.select(*extra, *CHARGE_STATUS_COLUMNS)
