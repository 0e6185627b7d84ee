"""Method L: charges from a rising state of charge, refined and enriched.

The stages read their input more than once, so :func:`run` writes each stage as a table before
the next begins; charges are few beside the messages they come from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from voltrail.operators import enrich as E, refine as R, slope as S
from voltrail.operators.dedup import dedup_messages
from voltrail.operators.series import LongSeries, by_length, find_long, measure, split
from voltrail.session import stage

KEYS = ("vehicle",)


def with_trips(messages: DataFrame, trips: DataFrame) -> DataFrame:
    return S.attach_trips(messages, trips, rows=measure(messages, KEYS)[1])


def _run(messages: DataFrame, trips: DataFrame, step) -> DataFrame:
    long, ordinary = measure(messages, KEYS)
    if long is None:
        return step(S.attach_trips(messages, trips, rows=ordinary), None)
    few, many = split(trips, long)
    return by_length(messages, long, lambda rows, long: step(S.attach_trips(rows, many if long else few, long, ordinary), long))


def flags(messages: DataFrame, trips: DataFrame) -> DataFrame:
    return _run(messages, trips, S.slope_flags)


def filled(messages: DataFrame, trips: DataFrame) -> DataFrame:
    return _run(messages, trips, S.slope_filled)


def sessions(messages: DataFrame, trips: DataFrame) -> DataFrame:
    """All charges by slope, before the gain filter."""
    return S.slope_sessions(_run(messages, trips, S.slope_numbered))


def charges(messages: DataFrame, trips: DataFrame) -> DataFrame:
    """Stage one: charges that gain more than one percent."""
    return S.real_gain(sessions(messages, trips))


def statuses(summary: DataFrame) -> DataFrame:
    """Messages 79, one per vehicle and message id, as a table by vehicle and time that the later steps read without a shuffle."""
    if R.BIN in summary.columns:
        return summary
    return R.in_buckets(R.status_messages(summary), ("ts", "msg"), "statuses")


def readings(messages: DataFrame) -> DataFrame:
    """Messages 74 likewise."""
    if R.BIN in messages.columns:
        return messages
    return R.in_buckets(dedup_messages(messages).select("vehicle", "session", "msg", "ts", *E.READINGS.values()), ("ts", "msg"), "readings")


def spans(first: DataFrame, summary: DataFrame) -> DataFrame:
    """Stage two, first half: status spans inside each charge, start and stop taken from them.

    ``summary`` are messages 79 or what :func:`statuses` has made of them, here and below.
    """
    return R.status_spans(R.first_charges(first), statuses(summary))


def asof(spanned: DataFrame, summary: DataFrame) -> DataFrame:
    """Each status message with the charge begun last; vehicles with very many messages in one time bin are cut into pieces."""
    table = statuses(summary)
    crowded = find_long(table, ("vehicle", R.BIN))
    if crowded is None:
        return R.status_asof_in_bins(spanned, table)
    long = LongSeries(stage(crowded.frame.select("vehicle").distinct(), "long-keys"), KEYS, crowded.size)
    (few, many), (few_statuses, many_statuses) = split(spanned, long), split(table, long)
    return R.status_asof_in_bins(few, few_statuses).unionByName(R.status_asof(many, many_statuses.drop(R.BIN), long))


def refined(spanned: DataFrame, summary: DataFrame) -> DataFrame:
    """Stage two, second half: stops moved to a late message 79."""
    return R.late_stop(spanned, R.late_status(asof(spanned, summary)))


def enriched(second: DataFrame, messages: DataFrame) -> DataFrame:
    """Stage three: readings at both ends, 15 columns. ``messages`` are messages 74 or what :func:`readings` has made of them."""
    return E.enrich(second, E.charge_endpoints(second, readings(messages)))


def run(messages: DataFrame, trips: DataFrame, summary: DataFrame) -> dict[str, DataFrame]:
    """All stages as written tables: ``charges``, ``spans``, ``refined`` and ``enriched``."""
    first = stage(charges(messages, trips), "slope-charges")
    table = statuses(summary)
    spanned = stage(spans(first, table), "slope-spans")
    second = stage(refined(spanned, table), "slope-refined")
    return {"charges": first, "spans": spanned, "refined": second,
            "enriched": stage(enriched(second, messages), "slope-enriched")}
