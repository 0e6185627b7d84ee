"""Method S: charges between plug and unplug events.

A vehicle's messages are put in order once. Its steps hand one series on: rows of a vehicle that is too long for one task are
cut into pieces by one parallel sort, with enough rows copied over the cuts for the steps that look at messages; from the events on,
which are written once, what a step needs from another piece comes with one row per piece.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame

from voltrail.operators import plugs
from voltrail.operators.battery_log import ORDER, RECOVER_ROWS, recovered, settle_soc
from voltrail.operators.dedup import dedup_messages
from voltrail.operators.series import LongSeries, Series, as_series, by_length, measure, together

KEYS = ("vehicle",)


def _deduplicated(battery: DataFrame, keys: Sequence[str], long: LongSeries | None, ordinary: int) -> DataFrame:
    key = list(dict.fromkeys([*keys, "vehicle", "session", "msg_type", "msg"]))
    return dedup_messages(together(battery, keys, long, ordinary), key)


def _run(battery: DataFrame, keys: Sequence[str], step: Callable[[Series], Series], null_mode: str = "compact") -> DataFrame:
    """Run a step over repaired series: ordinary vehicles whole, long ones in pieces."""
    longest, ordinary = measure(battery, keys)

    def repair(rows: DataFrame, long: LongSeries | None) -> DataFrame:
        settled = settle_soc(_deduplicated(rows, keys, long, ordinary), keys, null_mode=null_mode)
        return step(recovered(as_series(settled, keys, ORDER, long, before=1, after=RECOVER_ROWS), null_mode=null_mode)).own_rows()
    return by_length(battery, longest, repair)


def repaired(battery: DataFrame, keys: Sequence[str] = KEYS, null_mode: str = "compact") -> DataFrame:
    """Unified messages, one per key, with the state of charge settled and recovered."""
    return _run(battery, keys, lambda series: series, null_mode)


def edge_events(battery: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Plug and unplug edges before the alternation filter."""
    return _run(battery, keys, plugs.edges)


def _events(series: Series) -> Series:
    return plugs.alternating(plugs.edges(series))


def events(battery: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Alternating plug and unplug events."""
    return _run(battery, keys, _events)


def raw_charges(battery: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return _run(battery, keys, lambda series: plugs.paired(_events(series)))


def _spaced(series: Series, day: Column | date) -> Series:
    return plugs.spaced(plugs.paired(_events(series)).where(plugs.within_days(day)))


def gaps(battery: DataFrame, day: Column | date, keys: Sequence[str] = KEYS) -> DataFrame:
    return _run(battery, keys, lambda series: _spaced(series, day))


def grouped(battery: DataFrame, day: Column | date, keys: Sequence[str] = KEYS, stop_gap: str = "previous") -> DataFrame:
    return _run(battery, keys, lambda series: plugs.regrouped(_spaced(series, day), stop_gap))


def charges(battery: DataFrame, day: Column | date, keys: Sequence[str] = KEYS, stop_gap: str = "previous") -> DataFrame:
    """Final charges of one window that starts at ``day``, 28 columns."""
    measured = plugs.charge_indicators(grouped(battery, day, keys, stop_gap))
    return plugs.charge_columns(plugs.plausible_duration(measured), keys)
