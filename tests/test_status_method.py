"""Method S: repair, events, pairing and grouping on small series, also cut into pieces."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltrail.operators import battery_log, plugs
from voltrail.operators.series import find_long
from voltrail.plans import status_method as S
from voltrail.sources import testviews as V

T0 = datetime(2024, 1, 1)
SCHEMA = ("vehicle string, session long, msg_type int, msg long, ts timestamp, rts float, load_level long, "
          "summary_soc double, soc long, charge_mode int, status int, vtype int")


def battery(spark, rows):
    """Rows of (vehicle, msg, seconds, rts, soc, status)."""
    return spark.createDataFrame(
        [(v, 1, 68, m, T0 + timedelta(seconds=s), float(r), None, None, soc, 0, st, 25) for v, m, s, r, soc, st in rows], SCHEMA)


def socs(df):
    return [r["soc"] for r in df.orderBy("vehicle", "msg").collect()]


def test_settle_takes_soc_of_the_end_of_the_first_minute(spark):
    rows = [("a", 1, 0, 10, 40, 0), ("a", 2, 20, 30, 45, 0), ("a", 3, 60, 70, 50, 0)]
    assert socs(battery_log.settle_soc(battery(spark, rows))) == [45, 45, 50]


def test_settle_null_modes(spark):
    rows = [("a", 1, 0, 10, 40, 0), ("a", 2, 10, 20, None, 0), ("a", 3, 20, 30, 45, 0), ("a", 4, 55, 65, 50, 0)]
    assert socs(battery_log.settle_soc(battery(spark, rows)))[0] == 50  # third known SOC, past the minute
    assert socs(battery_log.settle_soc(battery(spark, rows), null_mode="aligned"))[0] == 45
    with pytest.raises(ValueError):
        battery_log.settle_soc(battery(spark, rows), null_mode="other")


def brute_settle(rows):
    out = []
    for v, m, s, r, soc, st in rows:
        frame = sorted((x[3], x[1], x[4]) for x in rows if x[0] == v and r <= x[3] <= r + 60)
        known = [x[2] for x in frame if x[2] is not None]
        inside = sum(x[0] <= 60 for x in frame)
        out.append(soc if r > 60 or len(known) <= 1 else known[min(inside, len(known)) - 1])
    return out


def test_settle_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(f"v{i % 40:02}", i // 40, i, rng.randrange(0, 180), rng.choice([None, 999, 1, 2, 3, 4]), 0) for i in range(400)]
    rows.sort(key=lambda r: (r[0], r[1]))
    assert socs(battery_log.settle_soc(battery(spark, rows))) == brute_settle(rows)


def test_settle_a_long_session_with_one_clock_value(spark):
    """A stuck clock puts 200,000 rows at the same second; the work stays linear."""
    n = 200_000
    rows = spark.range(n).select(F.lit("a").alias("vehicle"), F.lit(1).cast("long").alias("session"), F.lit(68).alias("msg_type"), F.col("id").alias("msg"),
                                 F.lit(30.0).cast("float").alias("rts"), F.when(F.col("id") % 3 != 0, F.col("id")).alias("soc"))
    known = [i for i in range(n) if i % 3]
    for mode, want in (("compact", known[-1]), ("aligned", None)):
        got = battery_log.settle_soc(rows, null_mode=mode).groupBy("soc").count().collect()
        assert [tuple(r) for r in got] == [(want if mode == "compact" else (n - 1 if (n - 1) % 3 else None), n)]


def test_recover_boundaries(spark):
    rows = [("a", 1, 0, 99, 999, 0), ("a", 2, 300, 99, 50, 0), ("b", 1, 0, 99, 999, 0), ("b", 2, 301, 99, 50, 0),
            ("c", 1, 0, 99, None, 0), ("c", 2, 10, 99, 50, 0)]
    assert socs(battery_log.recover_soc(battery(spark, rows))) == [50, 50, None, 50, None, 50]


def brute_recover(rows):
    out = []
    for v, m, s, r, soc, st in rows:
        frame = sorted(x for x in rows if x[0] == v and x[1] >= m)[:11]
        result = soc
        if soc == 999:
            known, result = [x[4] for x in frame if x[4] is not None], None
            for i in range(len(known)):
                if frame[i][2] - s > 300:
                    break
                if known[i] != 999:
                    result = known[i]
                    break
        out.append(result)
    return out


@pytest.mark.parametrize("piece", [None, 12])
def test_recover_against_brute_force(spark, piece):
    rng = random.Random(2)
    rows = []
    for v in range(6):
        at = 0
        for m in range(60):
            at += rng.choice([-20, 5, 30, 90, 200])  # times may go back
            rows.append((f"v{v}", m, at + 10000, 99, rng.choice([999, 999, 999, None, 7, 8]), 0))
    frame = battery(spark, rows)
    long = find_long(frame, ("vehicle",), piece) if piece else None
    assert (long is not None) == (piece is not None)
    assert socs(battery_log.recover_soc(frame, long=long)) == brute_recover(rows)


def events_of(df):
    return [(r["msg"], r["event"]) for r in df.orderBy("vehicle", "msg").collect()]


def test_edges_and_alternation_with_null_status(spark):
    rows = [("a", i, i, 99, 50, st) for i, st in enumerate([1, None, 1, 0])]
    edges = plugs.plug_edges(battery(spark, rows))
    assert events_of(edges) == [(1, "unplug"), (3, "unplug")]
    assert events_of(plugs.alternate(edges)) == [(1, "unplug")]


def test_alternation_keeps_last_plug_and_first_unplug(spark):
    rows = battery(spark, [("a", i, i, 99, 50, 0) for i in range(4)])
    event = F.when(F.col("msg") < 2, "plug").otherwise("unplug")
    assert events_of(plugs.alternate(rows.withColumn("event", event))) == [(1, "plug"), (2, "unplug")]


def test_pairing_keeps_lonely_events(spark):
    kinds = {0: "unplug", 1: "plug", 2: "plug", 3: "unplug", 4: "unplug", 5: "plug"}
    rows = battery(spark, [("a", i, i, 99, 50, 0) for i in kinds])
    event = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])[F.col("msg").cast("int")]
    got = plugs.pair_events(rows.withColumn("event", event)).select("msg_start", "next_msg_start", "msg_stop")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(
        [(None, None, 0), (1, 2, None), (2, 5, 3), (2, 5, 4), (5, None, None)], key=str)


def charging(spark, spans, vtype=25):
    """Rows for one vehicle: status 1 from each start to its stop, soc rising by ten."""
    rows, msg = [("a", 0, 0, 99, 10, 0)], 1
    for k, (start, stop) in enumerate(spans):
        rows += [("a", msg, start, 99, 10, 1), ("a", msg + 1, stop, 99, 20, 0)]
        msg += 2
    return battery(spark, rows)


def final(spark, spans, stop_gap="previous"):
    got = S.charges(charging(spark, spans), F.lit(T0.date()), stop_gap=stop_gap)
    seconds = lambda t: int((t - T0).total_seconds())
    return sorted((seconds(r["ts_start"]), seconds(r["ts_stop"])) for r in got.collect())


def test_short_break_is_dropped_or_merged(spark):
    near, apart = [(100, 1000), (1060, 2000)], [(100, 1000), (1061, 2000)]
    assert final(spark, near) == [(100, 1000)]
    assert final(spark, near, "next") == [(100, 2000)]
    assert final(spark, apart) == final(spark, apart, "next") == apart
    with pytest.raises(ValueError):
        final(spark, near, "other")


def test_duration_limits(spark):
    assert final(spark, [(10, 310)]) == []
    assert final(spark, [(10, 311)]) == [(10, 311)]
    assert final(spark, [(0, 172799)]) == [(0, 172799)]
    assert final(spark, [(0, 172800)]) == []


def test_final_schema_and_invariants(spark, small):
    frame = battery_log.unify(V.remote(spark, small), V.summary(spark, small))
    charges = S.charges(frame, F.lit(T0.date()))
    assert len(charges.columns) == 28
    events = S.events(frame).select("vehicle", "msg", "event").orderBy("vehicle", "msg").collect()
    for a, b in zip(events, events[1:]):
        assert a["vehicle"] != b["vehicle"] or a["event"] != b["event"]
    rows = charges.orderBy("vehicle", "msg_start").collect()
    assert rows
    for a, b in zip(rows, rows[1:]):
        assert a["vehicle"] != b["vehicle"] or a["ts_stop"] <= b["ts_start"]


@pytest.mark.parametrize("piece", [None, 12])
def test_chain_of_steps_on_random_series(spark, piece):
    """Random plugs, breaks, ties of messages over sessions and null states; whole and cut series, against a plain loop."""
    rng = random.Random(8)
    rows = []
    for v in range(5):
        at = 0
        for m in range(150):
            at += rng.choice([5, 20, 59, 60, 61, 400])
            rows.append((f"v{v}", 1 + m // 70, 68, m - m // 9, T0 + timedelta(seconds=at), 99.0, None, None, rng.choice([10, 20, 30]), 0, rng.choice([1, 1, 0, None, 3]), 25))
    seen, unique = set(), []
    for r in rows:
        if (r[0], r[1], r[3]) not in seen:
            seen.add((r[0], r[1], r[3]))
            unique.append(r)
    frame = spark.createDataFrame(unique, SCHEMA)

    def brute(stop_gap):
        out = []
        for v in sorted({r[0] for r in unique}):
            line = sorted((r for r in unique if r[0] == v), key=lambda r: (r[3], r[1], r[2]))
            marks = [("plug" if b[10] == 1 and a[10] not in (1, None) else "unplug" if a[10] == 1 and b[10] != 1 else None, b) for a, b in zip(line, line[1:])]
            marks = [(k, r) for k, r in marks if k]
            kept = [(k, r) for i, (k, r) in enumerate(marks) if (k == "plug" and (i + 1 == len(marks) or marks[i + 1][0] == "unplug"))
                    or (k == "unplug" and (i == 0 or marks[i - 1][0] == "plug"))]
            charges = [(a[1], b[1]) for a, b in zip(kept, kept[1:]) if a[0] == "plug" and b[0] == "unplug"]
            gap = [(b[0][4] - a[1][4]).total_seconds() for a, b in zip(charges, charges[1:])]
            before, after = [None, *gap], [*gap, None]
            apart = lambda g: g is None or g > 60
            points = [(c[0][3], 0, c[0]) for c, g in zip(charges, before) if apart(g)]
            points += [(c[1][3], 1, c[1]) for c, g in zip(charges, before if stop_gap == "previous" else after) if apart(g)]
            points.sort(key=lambda p: p[:2])
            for i, (msg, kind, r) in enumerate(points):
                opens = [p for p in points[:i] if p[1] == 0]
                if kind == 1 and opens and opens[-1][0] < msg and r[8] >= opens[-1][2][8]:
                    out.append((v, opens[-1][0], msg))
        return out

    if piece:
        spark.conf.set("spark.voltrail.series.maxRows", str(piece))
    try:
        for stop_gap in ("previous", "next"):
            got = S.grouped(frame, F.lit(T0.date()), stop_gap=stop_gap).select("vehicle", "msg_start", "msg_stop").collect()
            assert sorted(map(tuple, got)) == sorted(brute(stop_gap)) and len(got) > 20
    finally:
        spark.conf.unset("spark.voltrail.series.maxRows")


def test_long_vehicles_are_cut_once(spark, small, monkeypatch):
    """All messages are sorted and written once for the whole chain, the events once more; no later step cuts or writes again."""
    from voltrail.operators import series
    frames, sorts, written = type(spark.range(1)), [], []
    plain_sort, plain_stage = frames.repartitionByRange, series.stage
    monkeypatch.setattr(frames, "repartitionByRange", lambda df, *columns: sorts.append(columns) or plain_sort(df, *columns))
    monkeypatch.setattr(series, "stage", lambda df, name="stage": written.append(name) or plain_stage(df, name))
    frame = battery_log.unify(V.remote(spark, small), V.summary(spark, small))
    spark.conf.set("spark.voltrail.series.maxRows", "25")
    try:
        S.charges(frame, F.lit(T0.date()))
    finally:
        spark.conf.unset("spark.voltrail.series.maxRows")
    assert len(sorts) == 1 and written == ["long-keys", "long-series", "events"]


def test_long_vehicles_give_the_same_charges(spark, small):
    frame = battery_log.unify(V.remote(spark, small), V.summary(spark, small))
    plain = sorted(map(tuple, S.charges(frame, F.lit(T0.date())).collect()), key=str)
    spark.conf.set("spark.voltrail.series.maxRows", "25")
    try:
        assert sorted(map(tuple, S.charges(frame, F.lit(T0.date())).collect()), key=str) == plain
    finally:
        spark.conf.unset("spark.voltrail.series.maxRows")
