"""Telemetry views over the driver's generic tables.

``events`` becomes telemetry: a user is a vehicle and an event a message. Times are
compressed 60 times (except for the rolling job), so that gaps match the thresholds of
the method. All expressions are plain column arithmetic and have the same form in SQL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

EPOCH = 1704067200  # 2024-01-01 00:00:00 UTC
STATUS_OF_EVENT = {"view": 0, "click": 1, "error": 2, "signup": 3, "purchase": 4}


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _divisible(number: int) -> Column:
    return F.col("event_id") % number == 0


def raw_events(spark: SparkSession, folder: str, compressed: bool = True) -> DataFrame:
    """Columns shared by all message kinds."""
    events = _table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    second = F.unix_seconds("ts")
    place = EPOCH + F.floor((second - EPOCH) / 60)
    ts = F.timestamp_seconds(place) if compressed else F.col("ts")
    rts = F.floor((second % 86400) / 60)
    clock = F.concat(F.lit("PT"), F.floor(rts / 60).cast("string"), F.lit("M"), (rts % 60).cast("string"), F.lit("S"))
    status = F.lit(None).cast("int")
    for event, code in STATUS_OF_EVENT.items():
        status = F.when(F.col("event_type") == event, code).otherwise(status)
    return events.select(
        F.col("user_id").alias("vehicle"), F.floor(second / 86400).alias("session"), F.col("event_id").alias("msg"),
        ts.alias("ts"), clock.alias("session_clock"), rts.cast("double").alias("rts"),
        F.when(F.col("user_id") % 3 == 0, 26).otherwise(25).alias("vtype"), status.cast("int").alias("status"),
        (F.col("event_id") % 4).cast("int").alias("charge_mode"), F.col("value"), F.col("event_id"),
        F.when(_divisible(2), "even").otherwise("odd").alias("collector"))


def battery_messages(spark: SparkSession, folder: str, compressed: bool = True) -> tuple[DataFrame, DataFrame]:
    """Messages 68 and 79 over one reading of the events."""
    rows = raw_events(spark, folder, compressed)
    return _remote(rows), _summary(rows)


def remote(spark: SparkSession, folder: str, compressed: bool = True) -> DataFrame:
    return _remote(raw_events(spark, folder, compressed))


def summary(spark: SparkSession, folder: str, compressed: bool = True) -> DataFrame:
    return _summary(raw_events(spark, folder, compressed))


def _remote(events: DataFrame) -> DataFrame:
    """Messages 68: the even events."""
    level = F.when(_divisible(17), 127).when(~_divisible(23), F.floor("value") % 101)
    return events.filter(_divisible(2)).select(
        "vehicle", "session", "msg", "ts", "session_clock", "vtype",
        level.cast("long").alias("load_level"), "charge_mode", "status", "collector")


def _summary(events: DataFrame) -> DataFrame:
    """Messages 79: the odd events."""
    soc = F.when(_divisible(17), 102.2).when(~_divisible(23), F.col("value") - 101 * F.floor(F.col("value") / 101))
    return events.filter(~_divisible(2)).select(
        "vehicle", "session", "msg", "ts", "session_clock", "vtype",
        soc.cast("double").alias("summary_soc"), "charge_mode", "status", "collector")


def statuses(spark: SparkSession, folder: str) -> DataFrame:
    """Messages 79 for the slope method: every event carries a status."""
    return raw_events(spark, folder).select("vehicle", "session", "msg", "ts", "status")


def vehicle_status(spark: SparkSession, folder: str) -> DataFrame:
    """Messages 74: every event."""
    soc = F.when(~_divisible(17), F.floor("value") % 101)
    return raw_events(spark, folder).select(
        "vehicle", "session", "msg", "ts", ((F.col("event_id") % 40) * 0.5).alias("km"), soc.cast("double").alias("soc"),
        (F.col("value") - 40 * F.floor(F.col("value") / 40)).alias("temperature"),
        (F.col("value") - 300 * F.floor(F.col("value") / 300)).alias("range_km"))


def trips(spark: SparkSession, folder: str) -> DataFrame:
    """One trip per vehicle and every third day."""
    days = raw_events(spark, folder).filter(F.col("session") % 3 == 0)
    return days.groupBy("vehicle", "session").agg(
        F.min("msg").alias("msg_first"), F.max("msg").alias("msg_last"),
        F.min("ts").alias("trip_start"), F.max("ts").alias("trip_stop")).drop("session")


#: Hours that every fifth charge, by its first message, lasts longer in the stretched views: beyond each cut on durations, and below some.
STRETCHED = {0: 60, 1: 45, 2: 12}


def stretched_by(msg: str) -> Column:
    """Whole hours to add to a charge."""
    hours = F.lit(0)
    for rest, more in STRETCHED.items():
        hours = F.when(F.col(msg) % 5 == rest, more).otherwise(hours)
    return hours


def stretched(charges: DataFrame) -> DataFrame:
    """Charges in the common columns of which some last for days."""
    more = stretched_by("msg_start")
    return charges.withColumns({"stop": F.timestamp_seconds(F.unix_seconds("stop") + 3600 * more), "hours": F.col("hours") + more})


def stretched_status(charges: DataFrame) -> DataFrame:
    """Grouped method-S charges of which some last for days."""
    return charges.withColumn("ts_stop", F.timestamp_seconds(F.unix_seconds("ts_stop") + 3600 * stretched_by("msg_start")))


def vehicle_status_resent(spark: SparkSession, folder: str) -> DataFrame:
    """Messages 74 of which some arrive twice, and some without a session."""
    rows = vehicle_status(spark, folder)
    again = rows.filter(F.col("msg") % 9 == 0).withColumn("session", F.when(F.col("msg") % 2 == 0, F.col("session")))
    return rows.unionByName(again)


def resent(spark: SparkSession, folder: str) -> DataFrame:
    """Messages 79 of which some arrive twice, the second time with another reading."""
    rows = summary(spark, folder)
    again = rows.filter(F.col("msg") % 7 == 0).withColumn("summary_soc", F.col("summary_soc") + 1)
    return rows.unionByName(again)


def session_closes(spark: SparkSession, folder: str) -> DataFrame:
    """Last time and last relative time of each session."""
    rows = raw_events(spark, folder)
    return rows.groupBy("vehicle", "session").agg(F.max("ts").alias("close_ts"), F.max("rts").alias("close_rts"))


def clock_run(spark: SparkSession, folder: str, second: bool = False) -> DataFrame:
    """Messages with three clocks; the second run's clocks are shifted for some vehicles and lack some rows."""
    rows = raw_events(spark, folder)
    shift = (F.when(F.col("vehicle") % 5 == 0, 3600).when(F.col("vehicle") % 5 == 1, -7200).otherwise(0) if second else F.lit(0))
    if second:
        rows = rows.filter(~_divisible(29))

    def clock(offset: Column) -> Column:
        return F.timestamp_seconds(F.unix_seconds("ts") + offset + shift)

    return rows.select("vehicle", "session", "msg", clock(F.lit(0)).alias("ts"),
                       clock(F.col("event_id") % 7).alias("received"), clock(-(F.col("event_id") % 5)).alias("satellite"))


def second_run(events: DataFrame) -> DataFrame:
    """The events of another run: an hour later for every fifth vehicle, some rows missing."""
    later = F.when(F.col("vehicle") % 5 == 0, 3600).otherwise(0)
    return (events.filter(F.col("msg") % 29 != 0)
            .withColumn("time", F.timestamp_seconds(F.unix_seconds("time") + later)))


def vehicles(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as vehicles with a three-character equipment code."""
    return _table(spark, folder, "customer").select(
        F.col("c_custkey").alias("vehicle"), F.col("c_mktsegment").alias("family"),
        F.concat(F.lpad(F.col("c_nationkey").cast("string"), 2, "0"), F.substring("c_mktsegment", 1, 1)).alias("code"))


def positions(spark: SparkSession, folder: str) -> DataFrame:
    """Place of each equipment characteristic in the code, one per region."""
    return _table(spark, folder, "region").select(
        F.concat(F.lit("C"), F.col("r_regionkey").cast("string")).alias("characteristic"),
        (F.col("r_regionkey") + 1).cast("int").alias("position"))


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the equipment values for each family."""
    families = vehicles(spark, folder).groupBy("family", F.substring("code", 1, 2).alias("value")).agg(F.min("code").alias("_code"))
    nations = _table(spark, folder, "nation").select(
        F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("value"), F.col("n_name").alias("designation"))
    return families.join(nations, "value").select(F.lit("C0").alias("characteristic"), "value", "family", "designation")
