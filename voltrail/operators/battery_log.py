"""The unified battery table of messages 68 and 79, and the repair of its state of charge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.functions import battery as B
from voltrail.functions.clock import duration_seconds
from voltrail.operators.series import LongSeries, Series, as_series

ORDER = ("msg", "session", "msg_type")
SETTLE_SECONDS = 60
RECOVER_SECONDS = 300
RECOVER_ROWS = 10


def unify(remote: DataFrame, summary: DataFrame) -> DataFrame:
    """Messages 68 and 79 in twelve common columns, sentinels cleaned and SOC made comparable."""
    vtype = F.col("vtype")
    remote_soc = B.clean_sentinel(vtype, F.col("load_level"), B.REMOTE_INVALID, phev=B.REMOTE_INVALID_PHEV)
    cleaned = B.clean_sentinel(vtype, F.col("summary_soc"), B.SUMMARY_INVALID, bev=B.SUMMARY_INVALID_BEV)

    def columns(kind, level, summary_soc, soc):
        return ["vtype", "vehicle", "session", F.lit(kind).alias("msg_type"), "msg", "ts",
                duration_seconds(F.col("session_clock")).alias("rts"), level.cast("long").alias("load_level"),
                summary_soc.cast("double").alias("summary_soc"), soc.cast("long").alias("soc"),
                "charge_mode", "status"]

    none = F.lit(None)
    return (remote.select(*columns(68, F.col("load_level"), none, remote_soc))
            .unionByName(summary.select(*columns(79, none, F.col("summary_soc"), B.displayed_soc(vtype, cleaned)))))


def settle_soc(df: DataFrame, keys: Sequence[str] = ("vehicle",), seconds: int = SETTLE_SECONDS,
               null_mode: str = "compact") -> DataFrame:
    """In the first minute of a session, take the SOC reached at the end of that minute.

    Each row in that minute looks at the rows up to ``seconds`` ahead and takes the last one
    that is still inside the minute. ``compact`` counts rows over the list of known SOCs only, as
    if nulls were absent; ``aligned`` takes the row itself, null or not. Rows past two minutes
    never matter; they get partitions of their own so that a long session is not one group.

    The entries of a session are numbered in order. Running counts from either end say which number a row
    asks for; entries and questions are then put in one order and the last entry is carried to the question. All of this is
    linear in the rows, also where they all have one clock value, and stays in the partitioning by ``keys``.
    """
    if null_mode not in ("compact", "aligned"):
        raise ValueError(f"unknown null_mode {null_mode!r}")
    rts = F.col("rts")
    near = rts <= 2 * seconds
    slot = F.when(near, F.lit(0)).otherwise(1 + F.floor(rts / (2 * seconds)))
    wanted = near & F.col("soc").isNotNull() if null_mode == "compact" else near
    group = Window.partitionBy(*keys, "session", "_slot")
    in_order = group.orderBy("rts", "msg", "msg_type").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    to_end = group.orderBy("rts").rangeBetween(Window.unboundedPreceding, seconds)
    from_here = group.orderBy(F.col("rts").desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)

    def ahead(counted: Column) -> tuple[Column, Column]:
        """Of the counted rows those before this clock value, and those from it to ``seconds`` ahead."""
        one = F.when(counted, F.lit(1))
        before = F.count(one).over(group) - F.count(one).over(from_here)
        return before, F.count(one).over(to_end) - before

    before, known = ahead(wanted)
    _, inside = ahead(rts <= seconds)
    df = df.withColumn("_slot", slot).withColumns({"_number": F.count(F.when(wanted, F.lit(1))).over(in_order), "_before": before, "_known": known, "_inside": inside})
    own = ~near | (rts > seconds) | rts.isNull() | (F.col("_known") <= 1)
    asked = F.when(~own, F.struct((F.col("_before") + F.least("_inside", "_known")).alias("_at"), F.lit(1).alias("_asks")))
    entry = F.when(wanted, F.struct(F.col("_number").alias("_at"), F.lit(0).alias("_asks")))
    still = F.when(own, F.struct(F.lit(None).cast("long").alias("_at"), F.lit(2).alias("_asks")))
    df = df.select("*", F.inline(F.array_compact(F.array(entry, asked, still))))
    upto = group.orderBy("_at", "_asks").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = F.last(F.when(F.col("_asks") == 0, F.struct("soc")), ignorenulls=True).over(upto)["soc"]
    df = df.withColumn("_picked", picked).filter("_asks > 0")
    return df.withColumn("soc", F.when(F.col("_asks") == 1, F.col("_picked")).otherwise(F.col("soc"))).drop(
        "_slot", "_number", "_before", "_known", "_inside", "_at", "_asks", "_picked")


def recover_soc(df: DataFrame, keys: Sequence[str] = ("vehicle",), long: LongSeries | None = None,
                seconds: int = RECOVER_SECONDS, null_mode: str = "compact") -> DataFrame:
    """Replace an invalid SOC by the next valid one, at most ten rows and ``seconds`` ahead.

    The search stops at the first row too far ahead. What stays invalid becomes null; a null
    SOC is left alone. For ``null_mode`` see :func:`settle_soc`.
    """
    return recovered(as_series(df, keys, ORDER, long, after=RECOVER_ROWS), seconds, null_mode).own_rows()


def recovered(series: Series, seconds: int = RECOVER_SECONDS, null_mode: str = "compact") -> Series:
    """:func:`recover_soc` within a series that is cut with ``RECOVER_ROWS`` rows after each piece; the copies are not repaired."""
    ahead = series.window().rowsBetween(0, RECOVER_ROWS)
    soc, at = F.col("soc"), F.unix_micros("ts")
    listed = soc if null_mode == "compact" else F.coalesce(soc, F.lit(B.INVALID_SOC))
    series = series.with_columns({"_socs": F.collect_list(listed).over(ahead),
                                  "_times": F.collect_list(at).over(ahead)})
    valid = F.array_position(F.transform("_socs", lambda x: x != B.INVALID_SOC), True)
    far = F.array_position(F.transform("_times", lambda t: t - at > seconds * 1_000_000), True)
    found = F.when((valid > 0) & ((far == 0) | (valid < far)), F.get("_socs", (valid - 1).cast("int")))
    series = series.with_columns({"soc": F.when(soc == B.INVALID_SOC, found).otherwise(soc)})
    return series.without("_socs", "_times")
