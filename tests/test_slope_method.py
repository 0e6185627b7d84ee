"""Method L: flags, filling, numbering, refinement and enrichment."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltrail.operators import enrich, refine, slope
from voltrail.operators.series import find_long
from voltrail.plans import slope_method as L
from voltrail.sources import testviews as V

T0 = datetime(2024, 1, 1)


def at(seconds):
    return None if seconds is None else T0 + timedelta(seconds=seconds)


def status_rows(spark, rows):
    """Rows of (vehicle, msg, seconds, soc), standing still and outside trips."""
    frame = spark.createDataFrame([(v, 1, m, at(s), 0.0, float(soc)) for v, m, s, soc in rows],
                                  "vehicle string, session long, msg long, ts timestamp, km double, soc double")
    return frame.withColumn("in_trip", F.lit(0))


def test_run_from_the_first_row_is_no_charge(spark):
    rows = [("a", i, i * 60, soc) for i, soc in enumerate([10, 20, 30, 30, 20, 15, 15, 14, 20, 30, 30, 30])]
    numbered = slope.slope_numbered(status_rows(spark, rows)).orderBy("msg").collect()
    assert [r["charge_no"] for r in numbered][0] == 0
    sessions = slope.slope_sessions(slope.slope_numbered(status_rows(spark, rows))).collect()
    assert all(r["charge_start"] > T0 for r in sessions)


@pytest.mark.parametrize("gap,filled", [(599, 1), (600, 0)])
def test_flat_step_is_filled_within_ten_minutes(spark, gap, filled):
    times = [0, 60, 120, 120 + gap, 130 + gap, 190 + gap, 250 + gap]
    rows = [("a", i, t, soc) for i, (t, soc) in enumerate(zip(times, [50, 40, 50, 50, 50, 60, 60]))]
    got = {r["msg"]: r["filled"] for r in slope.slope_filled(status_rows(spark, rows)).collect()}
    assert got[3] == filled


def test_driving_is_not_charging(spark):
    rows = status_rows(spark, [("a", i, i * 60, 10 + i) for i in range(4)])
    moving = rows.withColumn("km", F.col("msg").cast("double")).withColumn("in_trip", F.lit(1))
    assert {r["charging"] for r in slope.slope_flags(moving).filter("msg > 0").collect()} == {0}


def test_trip_interval_is_shortened(spark):
    messages = status_rows(spark, [("a", i, i * 5, 10) for i in range(7)]).drop("in_trip")
    trips = spark.createDataFrame([("a", 0, 5, at(0), at(30)), ("b", 0, 9, at(0), at(99))],
                                  "vehicle string, msg_first long, msg_last long, trip_start timestamp, trip_stop timestamp")
    got = {r["msg"]: r["in_trip"] for r in slope.attach_trips(messages, trips).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0}


def test_cut_series_number_alike(spark, small):
    messages = L.with_trips(V.vehicle_status(spark, small), V.trips(spark, small))
    columns = ["vehicle", "msg", "charging", "filled", "kept", "charge_no"]
    plain = sorted(map(tuple, slope.slope_numbered(messages).select(*columns).collect()))
    long = find_long(messages, ("vehicle",), 30)
    kept = messages.join(long.frame.select("vehicle"), "vehicle", "left_semi")
    vehicles = {r["vehicle"] for r in long.frame.collect()}
    cut = sorted(map(tuple, slope.slope_numbered(kept, long).select(*columns).collect()))
    assert cut == [r for r in plain if r[0] in vehicles]


def charge(spark, start, stop):
    return spark.createDataFrame([("a", 1, at(start), at(stop), 10.0, 50.0, 40.0, 1)],
                                 "vehicle string, charge_no long, charge_start timestamp, charge_stop timestamp, "
                                 "soc_start double, soc_stop double, soc_gain double, charging int")


def statuses(spark, rows):
    return spark.createDataFrame([("a", 1, m, at(s), st) for m, s, st in rows],
                                 "vehicle string, session long, msg long, ts timestamp, status int")


@pytest.mark.parametrize("late,moved", [(6839, True), (7200, False)])
def test_late_finish_moves_the_stop(spark, late, moved):
    messages = statuses(spark, [(1, 100, 1), (2, 500, 1), (3, 1000 + late, 4)])
    row = L.refined(L.spans(charge(spark, 0, 1000), messages), messages).first()
    assert row["start"] == at(100)
    assert row["stop"] == (at(1000 + late) if moved else at(1000))


def test_finish_inside_sets_the_stop(spark):
    messages = statuses(spark, [(1, 100, 1), (2, 800, 4), (3, 900, 4), (4, 1500, 4)])
    row = L.refined(L.spans(charge(spark, 0, 1000), messages), messages).first()
    assert (row["start"], row["stop"], row["finished_last"]) == (at(100), at(800), 3)


@pytest.mark.parametrize("piece", [None, 3])
def test_charge_begun_last_matches_a_plain_loop(spark, piece):
    """Messages at the same second, at a start, without a time, far apart and beyond all charges; bins that hold nothing, bins that hold much."""
    rng = random.Random(12)
    messages, charges = [], []
    for v in "abc":
        for m in range(60):
            messages.append((v, 1, m, at(rng.choice([None, rng.randrange(0, 60_000), rng.randrange(0, 900) * 100, 5_000_000])), rng.choice([0, 1, 4, None])))
        starts = sorted({rng.randrange(0, 900) * 100 for _ in range(12)})
        charges += [(v, k, at(a), at(a), at(a + rng.randrange(0, 9000))) for k, a in enumerate(starts)]
    table = spark.createDataFrame(messages, "vehicle string, session long, msg long, ts timestamp, status int")
    spans = spark.createDataFrame(charges, "vehicle string, charge_no long, charge_start timestamp, start timestamp, stop timestamp")
    want = []
    for v in "abc":
        line = [(x[3] is not None, x[3], 1, x[2], x) for x in messages if x[0] == v] + [(True, c[3], 0, 0, c) for c in charges if c[0] == v]
        line.sort(key=lambda e: (e[0], e[1] or T0, e[2], e[3]))
        last = None
        for i, e in enumerate(line):
            if e[2] == 0:
                last = e[4]
            else:
                after = line[i + 1] if i + 1 < len(line) else None
                want.append((v, e[4][3], e[4][2], e[4][4], after[4][4] if after and after[2] == 1 else None, *((last[2], last[3], last[4]) if last else (None,) * 3)))
    if piece:
        spark.conf.set("spark.voltrail.series.maxRows", str(piece))
    try:
        got = L.asof(spans, table).collect()
    finally:
        spark.conf.unset("spark.voltrail.series.maxRows")
    assert Counter(map(tuple, got)) == Counter(want)


def test_bucketed_messages_are_not_shuffled(spark, small):
    """Without broadcasts: messages 79 and 74 are read from their buckets into joins, windows and groups; only rows per bin move."""
    statuses, readings = L.statuses(V.statuses(spark, small)), L.readings(V.vehicle_status(spark, small))
    charges = L.stage(L.charges(V.vehicle_status(spark, small), V.trips(spark, small)))
    spans = L.stage(L.spans(charges, statuses))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for rows, table in ((L.refined(spans, statuses), "statuses"), (L.enriched(L.stage(L.refined(spans, statuses)), readings), "readings"),
                            (L.spans(charges, statuses), "statuses")):
            plan = rows._jdf.queryExecution().executedPlan().toString().split("\n")
            scans = [i for i, line in enumerate(plan) if f"voltrail_{table}_" in line]
            assert scans and all("Bucketed: true" in plan[i] for i in scans)
            for i in scans:
                depth, above = len(plan[i]) - len(plan[i].lstrip(" :+-")), []
                for line in reversed(plan[:i]):
                    here = len(line) - len(line.lstrip(" :+-"))
                    if here < depth:
                        depth = here
                        above.append(line.lstrip(" :+-"))
                first = next(x for x in above if x.startswith(("Exchange", "SortMergeJoin", "Window", "HashAggregate", "SortAggregate", "ObjectHashAggregate")))
                assert not first.startswith("Exchange")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_late_status_needs_the_next_message(spark):
    messages = statuses(spark, [(1, 100, 1), (2, 1500, 1), (3, 1600, 1), (4, 1700, 0)])
    late = refine.late_status(L.asof(L.spans(charge(spark, 0, 1000), messages), messages)).first()
    assert (late["late_ongoing"], late["late_ongoing_ts"], late["late_finished"]) == (3, at(1600), None)


def test_enrich_does_not_fan_out_and_keeps_empty_charges(spark):
    messages = spark.createDataFrame(
        [("a", session, msg, at(s), 0.0, float(s), 5.0, 7.0) for session, msg, s in [(2, 1, 10), (1, 9, 20), (2, 3, 30), (2, 3, 31)]],
        "vehicle string, session long, msg long, ts timestamp, km double, soc double, temperature double, range_km double")
    charges = spark.createDataFrame([("a", at(0), at(40), 1.0, 2.0), ("a", at(100), at(90), 1.0, 2.0)],
                                    "vehicle string, start timestamp, stop timestamp, soc_start double, soc_stop double")
    got = L.enriched(charges, messages).orderBy("start").collect()
    assert len(got) == 2 and len(got[0]) == 15
    assert (got[0]["session_first"], got[0]["msg_first"], got[0]["session_last"], got[0]["msg_last"]) == (1, 9, 2, 3)
    assert got[1]["session_first"] is None


def test_charge_ids_are_dense(spark):
    frame = spark.createDataFrame([(f"v{i % 7}", at(i), at(i)) for i in range(50)], "vehicle string, start timestamp, charge_start timestamp")
    rows = refine.charge_ids(frame.repartition(8)).orderBy("charge_id").collect()
    assert [r["charge_id"] for r in rows] == list(range(1, 51))
    assert [(r["vehicle"], r["start"]) for r in rows] == sorted((r["vehicle"], r["start"]) for r in rows)


def test_stage_tables(spark, small):
    tables = L.run(V.vehicle_status(spark, small), V.trips(spark, small), V.statuses(spark, small))
    assert tables["enriched"].count() == tables["charges"].count() > 0


def test_repeated_messages_keep_one_row_per_trip(spark):
    from voltrail.operators.slope import attach_trips

    messages = spark.createDataFrame([("v", 1, 5, T0)] * 3 + [("v", None, 6, T0), ("v", 1, 99, T0)], "vehicle string, session long, msg long, ts timestamp")
    trips = spark.createDataFrame([("v", 1, 10, T0 - timedelta(hours=1), T0 + timedelta(hours=1)), ("v", 2 ** 40, 2 ** 62, T0, T0)],
                                  "vehicle string, msg_first long, msg_last long, trip_start timestamp, trip_stop timestamp")
    rows = attach_trips(messages, trips).collect()
    assert sorted((r["msg"], r["in_trip"]) for r in rows) == [(5, 1), (5, 1), (5, 1), (6, 1), (99, 0)]


@pytest.mark.parametrize("piece,together", [(None, 64), (None, 3), (25, 64), (25, 3)])
def test_trips_match_a_plain_left_join(spark, monkeypatch, piece, together):
    """Disjoint, nested, equal and touching trips, a crowd of overlapping ones, repeated messages, null sessions and ids."""
    rng = random.Random(11)
    messages = [(rng.choice("ab"), rng.choice([1, 2, None]), rng.choice([None, *range(0, 400)]), T0 + timedelta(seconds=rng.randrange(4000))) for _ in range(300)]
    messages += messages[:30]
    trips = []
    for v in "ab":
        for first in range(0, 400, 20):
            trips.append((v, first, first + rng.choice([0, 5, 15, 19, 20]), at(rng.randrange(2000)), at(2000 + rng.randrange(2000))))
        trips += [(v, 100, 160, at(0), at(5000)), (v, 110, 120, at(5), at(900)), trips[-1], (v, 390, 10, at(0), at(9))]
        trips += [(v, 200 + i, 230 + i, at(i), at(3000)) for i in range(8)]
    schema = "vehicle string, msg_first long, msg_last long, trip_start timestamp, trip_stop timestamp"
    m = spark.createDataFrame(messages, "vehicle string, session long, msg long, ts timestamp")
    t = spark.createDataFrame(trips, schema)
    long = find_long(m, ("vehicle",), piece) if piece else None
    monkeypatch.setattr(slope, "TOGETHER", together)
    got = slope.attach_trips(m, t, long).select("vehicle", "session", "msg", "ts", "trip_start", "trip_stop", "in_trip").collect()
    want = []
    for row in messages:
        inside = [x for x in trips if x[0] == row[0] and row[2] is not None and x[1] <= row[2] <= x[2]]
        margin = timedelta(seconds=10)
        want += [(*row, x[3], x[4], int(x[3] + margin <= row[3] <= x[4] - margin)) for x in inside] or [(*row, None, None, 0)]
    assert Counter(map(tuple, got)) == Counter(want)


def test_trips_and_flags_take_one_shuffle_of_the_messages(spark, small):
    rows = L.flags(V.vehicle_status(spark, small), V.trips(spark, small))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(vehicle") == 2  # the messages with the trips, and the few rows of the trips among themselves
    assert "Join" not in plan


def test_ordinary_rows_are_counted_beside_long_series(spark):
    from voltrail.operators.series import measure, together

    rows = spark.range(900).selectExpr("case when id < 600 then 'long' when id < 800 then concat('v', id % 20) end as vehicle", "id as msg")
    long, ordinary = measure(rows, ("vehicle",), 50)
    assert long.frame.collect() == [("long",)] and ordinary == 200
    assert measure(rows, ("vehicle",), 600) == (None, 800) and measure(rows.limit(0), ("vehicle",)) == (None, 0)
    spark.conf.set("spark.voltrail.series.taskRows", "50")
    try:
        assert together(rows, ("vehicle",), None, 800).rdd.getNumPartitions() == 16
    finally:
        spark.conf.unset("spark.voltrail.series.taskRows")


def test_series_with_outliers_and_ties_are_cut_evenly(spark):
    from voltrail.operators.series import as_series, find_long

    rows = spark.range(900).selectExpr("if(id % 3 = 0, null, 'v') as vehicle", "if(id = 1, 4102444800, if(id % 2 = 0, 7, id)) as ts", "id as msg")
    long = find_long(rows, ("vehicle",), 50)
    cut = as_series(rows, ("vehicle",), ("ts", "msg"), long, before=2, after=2).number("n")
    sizes = [r["count"] for r in cut.rows.filter("_own").groupBy("_piece").count().collect()]
    assert len(sizes) == 12 and max(sizes) == 50
    whole = as_series(rows, ("vehicle",), ("ts", "msg")).number("n")
    assert sorted(map(tuple, cut.own_rows().select("msg", "n").collect())) == sorted(map(tuple, whole.rows.select("msg", "n").collect()))
