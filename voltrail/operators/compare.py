"""Compare the charge tables of two methods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.functions.clock import hours_between
from voltrail.operators.dedup import first_per_key
from voltrail.operators.dominance import enclosing
from voltrail.operators.intervals import overlap_pairs
from voltrail.schemas import COMMON_COLUMNS

OVERLAP_BIN = 60  # seconds of the finest bins
MAX_HOURS = 50
DIFFERENCE_HOURS = 40


def _measured(df: DataFrame) -> DataFrame:
    df = df.withColumns({"hours": hours_between(F.col("start"), F.col("stop")),
                         "soc_gain": F.col("soc_stop") - F.col("soc_start")})
    return df.select(*COMMON_COLUMNS)


def common_status(charges: DataFrame) -> DataFrame:
    """Method-S charges in the shared eleven columns."""
    renamed = charges.select("vehicle", "session_start", "session_stop", "msg_start", "msg_stop",
                             F.col("ts_start").alias("start"), F.col("ts_stop").alias("stop"),
                             F.col("soc_start").cast("double").alias("soc_start"),
                             F.col("soc_stop").cast("double").alias("soc_stop"))
    return _measured(renamed)


def common_slope(charges: DataFrame) -> DataFrame:
    """Enriched method-L charges in the shared columns; absent ids become 0."""
    ids = {"session_start": "session_first", "session_stop": "session_last",
           "msg_start": "msg_first", "msg_stop": "msg_last"}
    filled = [F.coalesce(F.col(old).cast("long"), F.lit(0)).alias(new) for new, old in ids.items()]
    return _measured(charges.select("vehicle", *filled, "start", "stop", "soc_start", "soc_stop"))


def suffixed(df: DataFrame, suffix: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select([F.col(c).alias(c if c in keep else f"{c}{suffix}") for c in df.columns])


def _within(value: str, low: str, high: str) -> Column:
    return F.coalesce(F.col(value).between(F.col(low), F.col(high)), F.lit(False))


def _touching() -> Column:
    """Some end of one charge lies in the other; also holds for charges that stop before they start."""
    return (_within("start_s", "start_l", "stop_l") | _within("stop_s", "start_l", "stop_l")
            | _within("start_l", "start_s", "stop_s") | _within("stop_l", "start_s", "stop_s"))


def _hull(suffix: str) -> tuple[Column, Column]:
    start, stop = F.unix_seconds(f"start{suffix}"), F.unix_seconds(f"stop{suffix}")
    return F.least(start, stop), F.greatest(start, stop)


def overlapping(status: DataFrame, slope: DataFrame) -> DataFrame:
    """Charges of one vehicle that both methods saw at the same time, and their difference in hours."""
    s, l = suffixed(status, "_s", ("vehicle",)), suffixed(slope, "_l", ("vehicle",))
    pairs = overlap_pairs(s, l, ["vehicle"], _hull("_s"), _hull("_l"), OVERLAP_BIN, _touching())
    return pairs.withColumn("abs_diff", F.abs(F.col("hours_s") - F.col("hours_l")))


def best_overlap(status: DataFrame, slope: DataFrame, max_hours: float = MAX_HOURS) -> DataFrame:
    """One partner per method-S charge, the earliest, among method-L charges up to ``max_hours``."""
    pairs = overlapping(status, shorter_than(slope, max_hours))
    order = [F.col(c) for c in ("start_l", "stop_l", "msg_start_l")]
    return first_per_key(pairs, ["vehicle", "start_s", "stop_s"], order)


def mean_difference(pairs: DataFrame) -> DataFrame:
    return pairs.agg(F.count("*").alias("pairs"), F.avg("abs_diff").alias("mean_abs_diff"))


def shorter_than(charges: DataFrame, hours: float) -> DataFrame:
    """Charges that last at most ``hours``; negative durations stay."""
    return charges.filter(F.col("hours") <= hours)


def differing(pairs: DataFrame, hours: float = DIFFERENCE_HOURS) -> DataFrame:
    """Pairs whose durations differ by at least ``hours``."""
    return pairs.filter(F.col("abs_diff") >= hours)


def _cumulative(marks: DataFrame) -> DataFrame:
    """Running sums over time of ``begun`` and ``ended``, one row per second.

    Seconds are summed first, then cut into days: a day holds at most 86,400 rows, and the
    days are joined by one row each.
    """
    each = marks.groupBy("at").agg(F.sum("begun").alias("begun"), F.sum("ended").alias("ended"))
    each = each.withColumn("_day", F.floor(F.col("at") / 86400))
    earlier = Window.orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)  # one row per day
    days = each.groupBy("_day").agg(F.sum("begun").alias("_b"), F.sum("ended").alias("_e"))
    days = days.select("_day", F.coalesce(F.sum("_b").over(earlier), F.lit(0)).alias("_b"),
                       F.coalesce(F.sum("_e").over(earlier), F.lit(0)).alias("_e"))
    in_day = Window.partitionBy("_day").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = each.withColumns({"_in_b": F.sum("begun").over(in_day), "_in_e": F.sum("ended").over(in_day)}).join(days, "_day")
    return sums.select("at", (F.col("_b") + F.col("_in_b")).alias("begun_by"),
                       (F.col("_e") + F.col("_in_e") - F.col("ended")).alias("ended_before"))


def overlaps_any_vehicle(status: DataFrame, slope: DataFrame) -> DataFrame:
    """Per method-S charge the number of method-L charges, of any vehicle, of which an end lies in the other.

    The pairs grow with the square of the fleet, so they are counted without being built: all
    that began by the charge's stop, less those that ended before its start. That counts charges by the time between their
    ends. Of a method-L charge that stops before it starts no time lies inside, so where its ends enclose the
    method-S charge neither end of one lies in the other: those are counted apart and taken off. Method-S charges
    are taken to stop after they start, as :mod:`voltrail.operators.plugs` makes them.
    """
    low, high = _hull("")
    s_low, s_high = F.unix_seconds("start"), F.unix_seconds("stop")

    def marks(df: DataFrame, at: Column, begun: int, ended: int) -> DataFrame:
        return df.select(at.alias("at"), F.lit(begun).alias("begun"), F.lit(ended).alias("ended"))

    ends = slope.select(low.alias("low"), high.alias("high")).filter(F.col("low").isNotNull())
    ends = ends.select(F.inline(F.array(
        F.struct(F.col("low").alias("at"), F.lit(1).alias("begun"), F.lit(0).alias("ended")),
        F.struct(F.col("high").alias("at"), F.lit(0).alias("begun"), F.lit(1).alias("ended")))))
    sums = _cumulative(ends.unionAll(marks(status, s_low, 0, 0)).unionAll(marks(status, s_high, 0, 0)))
    timed = status.select("vehicle", "start", "stop", s_low.alias("_low"), s_high.alias("_high"))
    timed = timed.join(sums.select(F.col("at").alias("_high"), "begun_by"), "_high")
    timed = timed.join(sums.select(F.col("at").alias("_low"), "ended_before"), "_low")
    inverted = slope.filter(F.col("stop") < F.col("start")).select(low.alias("low"), high.alias("high"))
    around = enclosing(status.select(s_low.alias("low"), s_high.alias("high")), inverted)
    timed = timed.join(around, (F.col("_low") == F.col("low")) & (F.col("_high") == F.col("high")), "left")
    count = F.col("begun_by") - F.col("ended_before") - F.coalesce("enclosing", F.lit(0))
    return timed.select("vehicle", "start", "stop", count.alias("overlaps"))


def session_coverage(status: DataFrame, slope: DataFrame) -> DataFrame:
    """How many method-L rows find a method-S charge that began in the same session.

    The join's rows are counted per (vehicle, session) instead of being built, so a session
    with many charges on both sides costs one row.
    """
    key = ["vehicle", "session_start"]
    l = slope.groupBy(*key).agg(F.count("*").alias("l_n"))
    s = status.groupBy(*key).agg(F.count("*").alias("s_n"), F.count("session_stop").alias("s_closed"))
    both = l.join(s, key, "full_outer")
    matched = F.coalesce(F.col("l_n") * F.col("s_closed"), F.lit(0))
    totals = both.groupBy("vehicle").agg(F.sum("l_n").alias("l_n"), F.sum("s_n").alias("s_n"), F.sum(matched).alias("m"))
    totals = totals.agg(F.sum("l_n").alias("l_rows"), F.sum("s_n").alias("s_rows"), F.sum("m").alias("matched_rows"),
                        F.sum(F.when(F.col("m") > 0, 1).otherwise(0)).alias("matched_vehicles"))
    return totals.withColumns({"l_percent": F.try_divide(100 * F.col("matched_rows"), F.col("l_rows")),
                               "s_percent": F.try_divide(100 * F.col("matched_rows"), F.col("s_rows"))})


def vehicles_not_common(left: DataFrame, right: DataFrame) -> DataFrame:
    """Vehicles that only one of the two tables knows."""
    marks = (left.select("vehicle", F.lit(1).alias("l"), F.lit(0).alias("r"))
             .unionAll(right.select("vehicle", F.lit(0), F.lit(1))))
    seen = marks.groupBy("vehicle").agg(F.max("l").alias("l"), F.max("r").alias("r"))
    return seen.filter(F.col("l") != F.col("r")).select("vehicle", F.when(F.col("l") == 1, "first").otherwise("second").alias("only_in"))


def stacked(status: DataFrame, slope: DataFrame) -> DataFrame:
    return (status.withColumn("method", F.lit("status"))
            .unionByName(slope.withColumn("method", F.lit("slope"))))
