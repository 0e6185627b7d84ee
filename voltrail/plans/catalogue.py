"""The named queries: every operator over the driver's tables.

Each takes (spark, folder) and returns a DataFrame. Floating results are rounded to a few decimals
so that they can be compared with another engine's.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from datetime import date
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from voltrail.functions import battery as B
from voltrail.functions.clock import duration_seconds, parse_time, near_midnight, near_midnight_exact
from voltrail.operators import audit, battery_log, compare, dedup, event_series, fleet, plugs, profile, refine, slope
from voltrail.plans import rolling, slope_method as L, status_method as S
from voltrail.session import scratch_path, shared_folder, stage
from voltrail.sources import readers, sinks, testviews as V

Query = Callable[[SparkSession, str], DataFrame]

DAY = date(2024, 1, 1)
LAST_DAY = date(2024, 1, 29)
FIRST_WINDOW, END_WINDOW = date(2024, 1, 1), date(2024, 1, 31)
SECRET = "not-a-real-secret"
CLOCKS = ("ts", "received", "satellite")
RENAMES = [("event_id", "EVID"), ("user_id", "USID"), ("event_type", "EVTY"), ("unused_name", "UNUS")]

_queries: dict[str, Query] = {}


def query(function: Query) -> Query:
    _queries[function.__name__] = function
    return function


def all_queries() -> dict[str, Query]:
    return dict(_queries)


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    """Round floating columns; -0.0 becomes 0.0."""
    return df.withColumns({f.name: F.round(F.col(f.name).cast("double"), digits) + F.lit(0.0)
                           for f in df.schema.fields if f.dataType.typeName() in ("double", "float")})


# Inputs shared by several queries.

def _battery(spark, folder, compressed=True):
    return battery_log.unify(*V.battery_messages(spark, folder, compressed))


def _status_charges(spark, folder):
    return S.charges(_battery(spark, folder), DAY)


def _slope_charges(spark, folder):
    return L.charges(V.vehicle_status(spark, folder), V.trips(spark, folder))


def _spans(spark, folder):
    return L.spans(stage(_slope_charges(spark, folder)), V.statuses(spark, folder))


def _spans_and_statuses(spark, folder):
    """The spans and the messages 79, each as one written table."""
    statuses = L.statuses(V.statuses(spark, folder))
    return stage(L.spans(stage(_slope_charges(spark, folder)), statuses)), statuses


def _refined(spark, folder):
    return L.refined(*_spans_and_statuses(spark, folder))


def _enriched(spark, folder):
    return L.enriched(stage(_refined(spark, folder)), V.vehicle_status(spark, folder))


def _common(spark, folder):
    """Both methods as written tables; the two chains of jobs do not wait for each other."""
    shared_folder(spark)
    with ThreadPoolExecutor(1) as beside:
        status = beside.submit(lambda: stage(_status_charges(spark, folder)))
        slope = stage(_enriched(spark, folder))
        return compare.common_status(status.result()), compare.common_slope(slope)


def _common_long(spark, folder):
    """Both methods, with some method-L charges that last for days."""
    status, slope = _common(spark, folder)
    return status, V.stretched(slope)


def _stacked(spark, folder):
    return compare.stacked(*_common(spark, folder))  # both sides are written tables


SERIES_NAMES = ("session", "msg", "time")


def _run_events(spark, folder):
    """Event series of uncompressed method-S charges, as the audits read them."""
    charges = S.charges(_battery(spark, folder, compressed=False), LAST_DAY)
    return event_series.to_events(stage(charges), ("session_start", "msg_start", "ts_start"),
                                  ("session_stop", "msg_stop", "ts_stop"), SERIES_NAMES)


def _run_pair(spark, folder):
    events = _run_events(spark, folder)
    return events, V.second_run(events)


# Sources.

@query
def scan_messages(spark, folder):
    wanted = V.vehicles(spark, folder).filter(F.col("family") == "MACHINERY")
    rows = V.raw_events(spark, folder, compressed=False)
    rows = readers.select_messages(rows, date(2024, 1, 5), date(2024, 1, 15), wanted, "odd")
    return rows.select("vehicle", "session", "msg", "ts", "status")


@query
def scan_raw_vs_clean(spark, folder):
    raw = V.resent(spark, folder)
    soc = F.col("summary_soc")
    clean = readers.cleaned(raw, "summary_soc", B.clean_sentinel(F.col("vtype"), soc, B.SUMMARY_INVALID, bev=B.SUMMARY_INVALID_BEV))
    invalid = F.count(F.when(soc == B.INVALID_SOC, 1))
    before = raw.groupBy("vehicle").agg(F.count("*").alias("raw_rows"))
    after = clean.groupBy("vehicle").agg(F.count("*").alias("clean_rows"), invalid.alias("invalid_rows"))
    return before.join(after, "vehicle")


@query
def code_map(spark, folder):
    path = scratch_path(spark, "code_map")
    table = spark.read.parquet(f"{folder}/customer.parquet").select(
        F.col("c_name").alias("standard_name"), F.concat("c_mktsegment", F.lit(";"), "c_custkey").alias("short_code"))
    table.write.option("header", True).option("sep", ";").csv(path)
    return readers.read_csv(spark, path, "standard_name string, short_code string")


@query
def vehicle_subset(spark, folder):
    path = scratch_path(spark, "vehicles")
    chosen = V.vehicles(spark, folder).filter(F.col("family") == "BUILDING").select("vehicle")
    chosen.write.option("header", True).csv(path)
    ids = readers.read_csv(spark, path, "vehicle bigint", ",")
    return fleet.only_vehicles(V.raw_events(spark, folder), ids).select("vehicle", "msg", "ts")


@query
def renamed_messages(spark, folder):
    names = spark.createDataFrame(RENAMES, "standard_name string, short_code string")
    events = spark.read.parquet(f"{folder}/events.parquet").drop("ts", "props")
    return readers.rename_columns(events, names)


@query
def equipment_vehicles(spark, folder):
    found = fleet.equipped(V.vehicles(spark, folder), V.positions(spark, folder), V.labels(spark, folder), "C0", "04")
    return found.select("vehicle", "family", "value", "index", "designation").distinct()


@query
def charges_month(spark, folder):
    path = scratch_path(spark, "charges")
    sinks.append_months(S.charges(_battery(spark, folder, compressed=False), LAST_DAY), path)
    rows = readers.read_month(spark, path, 2024, 1)
    return rows.select("vehicle", "msg_start", "msg_stop", "ts_start", "ts_stop", "duration", "year", "month")


@query
def second_run_csv(spark, folder):
    """Another run read from text: written as delimited text, read with types, and its times parsed."""
    path = scratch_path(spark, "other-run")
    events = V.second_run(_run_events(spark, folder)).select("vehicle", "session", "msg", "event", F.date_format("time", "yyyy-MM-dd HH:mm:ss").alias("time"))
    events.write.option("header", True).option("sep", ";").csv(path)
    read = readers.read_csv(spark, path, "vehicle bigint, session bigint, msg bigint, event string, time string")
    return audit.run_difference(_run_events(spark, folder), read.withColumn("time", parse_time(F.col("time"))))


@query
def catalog_charges(spark, folder):
    """Charges saved as a catalog table and read back by name."""
    name = f"charges_{uuid.uuid4().hex}"
    sinks.save_table(_status_charges(spark, folder).select("vehicle", "msg_start", "msg_stop", "ts_start", "ts_stop"), name)
    return readers.read_table(spark, name)


@query
def charges_overwritten(spark, folder):
    """The second of two writes to one place stands alone."""
    path, charges = scratch_path(spark, "charges"), stage(_status_charges(spark, folder).select("vehicle", "msg_start", "msg_stop", "soc_gain"))
    sinks.overwrite(charges, path)
    sinks.overwrite(charges.filter("soc_gain > 10"), path)
    return readers.read_stage(spark, path)


@query
def raw_landed(spark, folder):
    """Messages landed by kind and day, one day landed twice, and read back for a range of days."""
    root = scratch_path(spark, "raw")
    kinds = {68: V.remote(spark, folder, False), 74: V.vehicle_status(spark, folder), 79: V.summary(spark, folder, False)}
    sinks.land_raw(kinds, root)
    again = kinds[79].filter(F.to_date("ts") == F.lit(date(2024, 1, 6)))
    sinks.land_raw({79: again}, root, (79,))
    rows = readers.read_messages(spark, root, 79, date(2024, 1, 5), date(2024, 1, 12), collector="odd")
    return rows.select("vehicle", "session", "msg", "ts", "status")


@query
def run_record(spark, folder):
    """The configuration of a run over the table's days, as its record holds it."""
    days = V.raw_events(spark, folder, compressed=False).agg(F.min(F.to_date("ts")).alias("a"), F.max(F.to_date("ts")).alias("b")).first()
    config = sinks.RunConfig(("1", "2"), days["a"], days["b"], "run")
    root = scratch_path(spark, "record")
    sinks.write_run_record(spark, config, root)
    return readers.read_stage(spark, f"{root}/run/run_config").select(
        F.concat_ws(",", "vehicles").alias("vehicles"), "start_date", "end_date", "folder_name")


@query
def window_rows(spark, folder):
    """Charges per window, as the window sink counts them while writing."""
    path, charges = scratch_path(spark, "windows"), stage(S.charges(_battery(spark, folder, compressed=False), LAST_DAY))
    days = sorted(row["day"] for row in charges.select(F.to_date("ts_start").alias("day")).distinct().collect())  # one per day
    counts = [(day, sinks.write_window(charges.filter(F.to_date("ts_start") == F.lit(day)), path, day)) for day in days]
    read = spark.read.parquet(path).groupBy(F.col("window").cast("date").alias("window")).agg(F.count("*").alias("read_rows"))
    return spark.createDataFrame(counts, "window date, rows long").join(read, "window")


@query
def events_in_order(spark, folder):
    """The sorted output, with each row's place in it."""
    rows = event_series.ordered(_run_events(spark, folder), "time", "msg", "event")
    return dedup.number_globally(rows.withColumn("_written", F.monotonically_increasing_id()), ("_written",), "place").drop("_written")


@query
def family_labels(spark, folder):
    families = V.vehicles(spark, folder).select("family").distinct().withColumn("label", F.concat(F.lit("family "), F.lower("family")))
    return fleet.family_labels(V.vehicles(spark, folder).select("vehicle", "family"), families)


# Method S.

@query
def session_seconds(spark, folder):
    rows = V.raw_events(spark, folder)
    return rounded(rows.select("vehicle", "session", "msg", duration_seconds(F.col("session_clock")).alias("rts")))


@query
def soc_cleaned(spark, folder):
    soc = B.clean_sentinel(F.col("vtype"), F.col("summary_soc"), B.SUMMARY_INVALID, bev=B.SUMMARY_INVALID_BEV)
    level = B.clean_sentinel(F.col("vtype"), F.col("load_level"), B.REMOTE_INVALID, phev=B.REMOTE_INVALID_PHEV)
    both = (V.summary(spark, folder).select("vehicle", "msg", "vtype", soc.alias("soc"))
            .unionByName(V.remote(spark, folder).select("vehicle", "msg", "vtype", level.cast("double").alias("soc"))))
    return rounded(both)


@query
def soc_estimated(spark, folder):
    cleaned = B.clean_sentinel(F.col("vtype"), F.col("summary_soc"), B.SUMMARY_INVALID, bev=B.SUMMARY_INVALID_BEV)
    return V.summary(spark, folder).select("vehicle", "msg", "vtype", B.displayed_soc(F.col("vtype"), cleaned).alias("soc"))


@query
def battery_unified(spark, folder):
    return rounded(_battery(spark, folder))


@query
def messages_dedup(spark, folder):
    return rounded(dedup.dedup_messages(V.resent(spark, folder)).select("vehicle", "session", "msg", "ts", "summary_soc"))


@query
def soc_settled(spark, folder):
    rows = battery_log.settle_soc(_battery(spark, folder))
    return rounded(rows.select("vehicle", "session", "msg", "rts", "soc"))


@query
def soc_recovered(spark, folder):
    return S.repaired(_battery(spark, folder)).select("vehicle", "msg", "ts", "soc")


@query
def plug_events(spark, folder):
    return S.edge_events(_battery(spark, folder)).select("vehicle", "msg", "ts", "status", "soc", "event")


@query
def plug_events_clean(spark, folder):
    return S.events(_battery(spark, folder)).select("vehicle", "msg", "ts", "status", "soc", "event")


@query
def charges_raw(spark, folder):
    return S.raw_charges(_battery(spark, folder)).select(
        "vehicle", "vtype", "msg_start", "ts_start", "soc_start", "next_msg_start", "msg_stop", "ts_stop", "soc_stop")


@query
def charges_sane(spark, folder):
    rows = plugs.sane_times(S.raw_charges(_battery(spark, folder, compressed=False)), date(2024, 1, 10))
    return rows.select("vehicle", "msg_start", "msg_stop", "ts_start", "ts_stop")


@query
def charge_gaps(spark, folder):
    return S.gaps(_battery(spark, folder), DAY).select(
        "vehicle", "msg_start", "msg_stop", "previous_msg_stop", "following_msg_start", "gap_before", "gap_after")


GROUPED = ("vehicle", "vtype", "msg_start", "next_msg_start", "msg_stop", "ts_start", "ts_stop", "soc_gain")


@query
def charges_grouped(spark, folder):
    return S.grouped(_battery(spark, folder), DAY).select(*GROUPED)


@query
def charges_merged(spark, folder):
    return S.grouped(_battery(spark, folder), DAY, stop_gap="next").select(*GROUPED)


@query
def charge_power(spark, folder):
    rows = plugs.charge_indicators(S.grouped(_battery(spark, folder), DAY))
    return rounded(rows.select("vehicle", "msg_start", "soc_gain", "duration", "speed", "power"))


@query
def power_class(spark, folder):
    rows = plugs.charge_indicators(S.grouped(_battery(spark, folder), DAY))
    return rows.select("vehicle", "msg_start", "vtype", "power_class")


@query
def charges_final(spark, folder):
    return rounded(_status_charges(spark, folder))


@query
def charges_plausible(spark, folder):
    """The cuts on the duration, over charges of which some last for days."""
    rows = plugs.charge_indicators(V.stretched_status(S.grouped(_battery(spark, folder), DAY)))
    return rounded(plugs.plausible_duration(rows).select("vehicle", "msg_start", "msg_stop", "ts_stop", "duration", "power"))


@query
def rolling_new_charges(spark, folder):
    rows = rolling.all_windows(_battery(spark, folder, compressed=False), FIRST_WINDOW, END_WINDOW)
    return rounded(rows.select("window", "vehicle", "msg_start", "msg_stop", "ts_start", "ts_stop", "soc_gain", "power"))


@query
def clock_corrected(spark, folder):
    events = S.events(_battery(spark, folder)).select("vehicle", "session", "msg", "event", "ts", "rts")
    return audit.correct_clock(events, V.session_closes(spark, folder)).drop("rts")


@query
def anonymised(spark, folder):
    rows = _status_charges(spark, folder).select("vehicle", "msg_start", "msg_stop", "soc_gain")
    return fleet.anonymised(rows, SECRET)


# Method L.

@query
def trip_flags(spark, folder):
    rows = L.with_trips(V.vehicle_status_resent(spark, folder), V.trips(spark, folder))
    return rows.select("vehicle", "session", "msg", "ts", "trip_start_inner", "trip_stop_inner", "in_trip")


@query
def slope_flags(spark, folder):
    rows = L.flags(V.vehicle_status(spark, folder), V.trips(spark, folder))
    return rounded(rows.select("vehicle", "msg", "soc_drop", "rising", "rising_pair", "moving", "driving", "charging"))


@query
def slope_filled(spark, folder):
    return L.filled(V.vehicle_status(spark, folder), V.trips(spark, folder)).select("vehicle", "msg", "charging", "filled", "kept")


@query
def slope_sessions(spark, folder):
    return rounded(L.sessions(V.vehicle_status(spark, folder), V.trips(spark, folder)))


@query
def slope_charges(spark, folder):
    return rounded(_slope_charges(spark, folder))


@query
def charge_status_spans(spark, folder):
    return rounded(_spans(spark, folder))


@query
def charge_ids(spark, folder):
    return refine.charge_ids(_spans(spark, folder).select("vehicle", "start", "stop", "charge_start"))


@query
def charge_asof(spark, folder):
    return L.asof(*_spans_and_statuses(spark, folder))


@query
def late_status(spark, folder):
    return refine.late_status(L.asof(*_spans_and_statuses(spark, folder)))


@query
def refined_charges(spark, folder):
    return rounded(_refined(spark, folder).select(
        "vehicle", "charge_no", "charge_start", "charge_stop", "soc_start", "soc_stop", "soc_gain", "start", "stop",
        "late_ongoing", "late_finished", "late_stop", "late_finished_hours", "late_ongoing_hours", "late_stop_hours"))


@query
def charge_endpoints(spark, folder):
    from voltrail.operators.enrich import charge_endpoints as ends
    return rounded(ends(stage(_refined(spark, folder)), dedup.dedup_messages(V.vehicle_status(spark, folder))))


@query
def charges_enriched(spark, folder):
    return rounded(_enriched(spark, folder))


# Comparison of both methods.

@query
def charges_common_s(spark, folder):
    return rounded(compare.common_status(_status_charges(spark, folder)))


@query
def charges_common_l(spark, folder):
    return rounded(compare.common_slope(_enriched(spark, folder)))


PAIR = ("vehicle", "msg_start_s", "start_s", "stop_s", "msg_start_l", "start_l", "stop_l", "hours_s", "hours_l", "abs_diff")


@query
def overlap_pairs(spark, folder):
    return rounded(compare.overlapping(*_common(spark, folder)).select(*PAIR))


@query
def overlap_pairs_any(spark, folder):
    return compare.overlaps_any_vehicle(*_common(spark, folder))


@query
def overlap_best(spark, folder):
    return rounded(compare.best_overlap(*_common_long(spark, folder)).select(*PAIR))


@query
def overlap_mean_diff(spark, folder):
    return rounded(compare.mean_difference(compare.overlapping(*_common(spark, folder))))


@query
def session_coverage(spark, folder):
    return rounded(compare.session_coverage(*_common(spark, folder)))


@query
def vehicles_not_common(spark, folder):
    return compare.vehicles_not_common(*_common(spark, folder))


@query
def charges_stacked(spark, folder):
    return rounded(_stacked(spark, folder))


# Statistics.

@query
def charge_date_range(spark, folder):
    return profile.date_range(_stacked(spark, folder), "method")


@query
def vehicle_counts(spark, folder):
    return profile.vehicle_counts(_stacked(spark, folder), "method")


@query
def charge_describe(spark, folder):
    return rounded(profile.describe(_stacked(spark, folder), ("hours", "soc_start", "soc_stop", "soc_gain"), "method"))


@query
def duration_histogram(spark, folder):
    return rounded(profile.histogram(_stacked(spark, folder), "hours", "method", 100))


@query
def run_difference_density(spark, folder):
    """Density of the seconds between two runs, in 100 bins."""
    diffs = audit.run_difference(*_run_pair(spark, folder)).withColumn("run", F.lit("both"))
    return rounded(profile.histogram(diffs, "diff", "run", 100, density=True), 8)


@query
def run_time_histogram(spark, folder):
    """Events of each run over time, in 20 bins."""
    first, second = _run_pair(spark, folder)
    both = first.withColumn("run", F.lit("first")).unionByName(second.withColumn("run", F.lit("second")))
    return rounded(profile.histogram(both.withColumn("second", F.unix_seconds("time")), "second", "run", 20))


@query
def start_weighted_histogram(spark, folder):
    """Starts of charges weighted by the share of charges that start with them; one bin per vehicle."""
    stacked = stage(_stacked(spark, folder))
    bins = max(1, stacked.select("vehicle").distinct().count())
    starts = profile.start_probability(stacked, "method").withColumn("second", F.unix_seconds("start"))
    return rounded(profile.histogram(starts, "second", "method", bins, weight="probability"))


@query
def vehicles_described(spark, folder):
    """Count, distinct and most frequent vehicle, and the range of the start times."""
    return profile.describe_ids(_stacked(spark, folder), "vehicle", "start", "method")


@query
def run_difference_described(spark, folder):
    diffs = audit.run_difference(*_run_pair(spark, folder)).withColumns({"run": F.lit("both"), "first_second": F.unix_seconds("time_first")})
    return rounded(profile.describe(diffs, ("diff", "first_second"), "run"))


@query
def soc_gain_histogram(spark, folder):
    return rounded(profile.histogram(_stacked(spark, folder), "soc_gain", "method", 10))


@query
def duration_box(spark, folder):
    stacked = compare.stacked(*_common_long(spark, folder))
    return rounded(profile.box_statistics(compare.shorter_than(stacked, 10), "hours", "method"))


@query
def duration_outliers(spark, folder):
    """The pairs whose durations differ by 40 hours."""
    far = compare.differing(compare.overlapping(*_common_long(spark, folder)))
    return rounded(far.select(*PAIR).withColumn("negative_l", F.col("hours_l") < 0))


@query
def iqr_outliers(spark, folder):
    return rounded(profile.outside_quartiles(_stacked(spark, folder), "hours", "method").select(
        "method", "vehicle", "msg_start", "start", "hours", "is_largest"))


@query
def start_probability(spark, folder):
    return rounded(profile.start_probability(_stacked(spark, folder), "method").select(
        "method", "vehicle", "msg_start", "start", "probability"), 8)


@query
def longest_charges(spark, folder):
    return rounded(dedup.rows_at_maximum(_stacked(spark, folder), "hours", ["method"]))


# Series for charts.

COMMON_START, COMMON_STOP = ("session_start", "msg_start", "start"), ("session_stop", "msg_stop", "stop")


@query
def event_series_rows(spark, folder):
    return event_series.to_events(_stacked(spark, folder), COMMON_START, COMMON_STOP, SERIES_NAMES, ("method",))


@query
def event_series_numbered(spark, folder):
    common = compare.common_status(stage(_status_charges(spark, folder)))
    events = event_series.to_events(common, COMMON_START, COMMON_STOP, SERIES_NAMES)
    return event_series.numbered(events, ("time", "msg", "event"))


@query
def event_series_soc(spark, folder):
    common = compare.common_status(stage(_status_charges(spark, folder)))
    events = event_series.to_events(common, COMMON_START, COMMON_STOP, SERIES_NAMES, ("soc_gain", "hours"))
    return rounded(event_series.without_repeats(events, "soc_gain", ("session", "time", "msg", "event")))


@query
def soc_jump_filtered(spark, folder):
    return rounded(event_series.without_soc_jumps(V.vehicle_status(spark, folder)).select("vehicle", "msg", "ts", "soc", "soc_drop"))


@query
def soc_trace(spark, folder):
    wanted = V.vehicles(spark, folder).filter(F.col("family") == "FURNITURE")
    rows = event_series.without_soc_jumps(V.vehicle_status(spark, folder)).select("vehicle", "ts", "soc")
    first, last = F.lit("2024-01-01 02:00:00").cast("timestamp"), F.lit("2024-01-01 09:00:00").cast("timestamp")
    return rounded(event_series.in_period(rows, "ts", first, last, wanted))


@query
def charges_lookup(spark, folder):
    events = _run_events(spark, folder)
    wanted = V.vehicles(spark, folder).filter(F.col("family") == "HOUSEHOLD")
    first, last = F.lit("2024-01-01").cast("timestamp"), F.lit("2024-01-09").cast("timestamp")
    return event_series.in_period(events, "time", first, last, wanted)


# Audits of two runs.

@query
def run_diff(spark, folder):
    return audit.run_difference(*_run_pair(spark, folder))


@query
def run_diff_summary(spark, folder):
    return audit.difference_summary(audit.run_difference(*_run_pair(spark, folder)))


@query
def run_drift(spark, folder):
    return rounded(audit.run_drift(*_run_pair(spark, folder)))


@query
def run_clock_diff(spark, folder):
    return audit.clock_differences(V.clock_run(spark, folder), V.clock_run(spark, folder, second=True), CLOCKS)


@query
def near_midnight_events(spark, folder):
    diffs = audit.run_difference(*_run_pair(spark, folder))
    return diffs.filter(near_midnight(F.col("time_first")))


@query
def near_midnight_asym(spark, folder):
    diffs = audit.run_difference(*_run_pair(spark, folder))
    return diffs.filter(near_midnight_exact(F.col("time_first")))


@query
def vehicle_sample(spark, folder):
    return dedup.sample_ids(V.raw_events(spark, folder), "vehicle", 30, seed=7)


# Names that would hide an imported module or function above.
_queries["event_series"] = _queries.pop("event_series_rows")
_queries["near_midnight"] = _queries.pop("near_midnight_events")
