"""Charges as time series of events, and the SOC trace, ready to be charted elsewhere."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voltrail.operators.series import as_series, by_length, find_long

MAX_SOC_JUMP = 10


def to_events(charges: DataFrame, start: Sequence[str], stop: Sequence[str], names: Sequence[str],
              shared: Sequence[str] = ()) -> DataFrame:
    """One plug and one unplug row per charge, in a single pass, without repeated rows.

    ``start`` and ``stop`` are the columns of either end, called ``names`` in the result.
    """
    def row(columns: Sequence[str], event: str) -> Column:
        return F.struct(*[F.col(c).alias(n) for c, n in zip(columns, names)], F.lit(event).alias("event"))

    ends = F.array(row(start, "plug"), row(stop, "unplug"))
    return charges.select("vehicle", *shared, F.inline(ends)).distinct()


def ordered(events: DataFrame, *order: str) -> DataFrame:
    """For the output edge only: a global sort by vehicle and time."""
    return events.orderBy("vehicle", *order)


def numbered(events: DataFrame, order: Sequence[str], name: str = "row_no") -> DataFrame:
    """Place of each event in its vehicle's series."""
    def step(rows, long):
        return as_series(rows, ("vehicle",), order, long).number(name).own_rows()
    return by_length(events, find_long(events, ("vehicle",)), step)


def without_repeats(events: DataFrame, value: str, order: Sequence[str]) -> DataFrame:
    """Set ``value`` to 0 where it equals the value of the vehicle's row before."""
    def step(rows, long):
        series = as_series(rows, ("vehicle",), order, long, before=1)
        previous = F.lag(value).over(series.window())
        series = series.with_columns({"_previous": previous})
        same = F.col(value) == F.col("_previous")
        return series.with_columns({value: F.when(same, 0).otherwise(F.col(value))}).own_rows().drop("_previous")
    return by_length(events, find_long(events, ("vehicle",)), step)


def without_soc_jumps(messages: DataFrame, soc: str = "soc", max_jump: float = MAX_SOC_JUMP) -> DataFrame:
    """Rows whose SOC is less than ``max_jump`` away from the next row's; a vehicle's last row drops."""
    def step(rows, long):
        series = as_series(rows, ("vehicle",), ("ts", "msg", "session"), long, after=1)
        series = series.with_columns({"soc_drop": F.col(soc) - F.lead(soc).over(series.window())})
        return series.own_rows().filter(F.abs("soc_drop") < max_jump)
    return by_length(messages, find_long(messages, ("vehicle",)), step)


def in_period(df: DataFrame, time: str, first: Column, last: Column, vehicles: DataFrame | None = None) -> DataFrame:
    """Distinct rows of a period (end excluded), for the given vehicles."""
    df = df.filter((F.col(time) >= first) & (F.col(time) < last))
    if vehicles is not None:
        df = df.join(vehicles, "vehicle", "left_semi")
    return df.distinct()
