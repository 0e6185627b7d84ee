"""Overlaps, statistics and audits against brute force."""

import random
import statistics
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltrail.operators import audit, compare, dedup, dominance, event_series, fleet, intervals, profile

T0 = datetime(2024, 1, 1)
COMMON = ("vehicle string, session_start long, session_stop long, msg_start long, msg_stop long, start timestamp, "
          "stop timestamp, soc_start double, soc_stop double, hours double, soc_gain double")


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def charges(spark, spans):
    """Spans of (vehicle, start, stop) in seconds."""
    return spark.createDataFrame([(v, a // 500, b // 500, i, i, at(a), at(b), 0.0, 1.0, (b - a) / 3600, 1.0)
                                  for i, (v, a, b) in enumerate(spans)], COMMON)


def spans(seed, n, inverted=0.2):
    """A third of all spans belong to one vehicle; some last for weeks or stop before they start."""
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        a = rng.randrange(0, 400_000)
        length = rng.choice([10, 3000, 50_000, 5_000_000])
        out.append((rng.choice(["hot", "b", "c"]), a, a - rng.randrange(0, 9000) if rng.random() < inverted else a + rng.randrange(0, length)))
    return out


def touch(s, l):
    return l[1] <= s[1] <= l[2] or l[1] <= s[2] <= l[2] or s[1] <= l[1] <= s[2] or s[1] <= l[2] <= s[2]


def test_overlaps_match_brute_force(spark):
    s, l = spans(1, 120, 0), spans(2, 120)
    pairs = compare.overlapping(charges(spark, s), charges(spark, l)).select("msg_start_s", "msg_start_l").collect()
    expected = sorted((i, j) for i, a in enumerate(s) for j, b in enumerate(l) if a[0] == b[0] and touch(a, b))
    assert sorted(map(tuple, pairs)) == expected


def test_overlaps_of_one_busy_vehicle_are_not_compared_all_with_all(spark):
    """32,000 by 32,000 charges of one vehicle, of a minute to weeks; only charges that are near each other are compared."""
    n = 32_000
    row = lambda shift, long: spark.range(n).select(
        F.lit("v").alias("vehicle"), (F.col("id") * 3600 + shift).alias("a"),
        (F.col("id") * 3600 + shift + F.when(F.col("id") % 8000 == 7, long).when(F.col("id") % 2 == 0, 60).otherwise(3000)).alias("b"))
    s, l = row(0, 2_000_000).withColumnsRenamed({"a": "sa", "b": "sb"}), row(1800, 90_000).withColumnsRenamed({"a": "la", "b": "lb"})
    meet = (F.col("sa") <= F.col("lb")) & (F.col("la") <= F.col("sb"))
    began = time.perf_counter()
    got = intervals.overlap_pairs(s, l, ["vehicle"], (F.col("sa"), F.col("sb")), (F.col("la"), F.col("lb")), 60, meet).select("sa", "la").collect()
    assert time.perf_counter() - began < 60
    length = lambda i, long: long if i % 8000 == 7 else 60 if i % 2 == 0 else 3000
    left, want = [(i * 3600, i * 3600 + length(i, 2_000_000)) for i in range(n)], []
    for j in range(n):
        la, lb = j * 3600 + 1800, j * 3600 + 1800 + length(j, 90_000)
        want += [(left[i][0], la) for i in {*range(max(0, j - 1), min(n, j + 27)), *range(7, min(n, j + 1), 8000)} if left[i][0] <= lb and la <= left[i][1]]
    assert sorted(map(tuple, got)) == sorted(want) and len(want) > 20_000


def test_overlap_counts_over_all_vehicles(spark):
    s, l = spans(3, 80, 0), spans(4, 80) + [("c", stop, start) for _, start, stop in spans(6, 40, 0)] + [("c", 400_000, -400_000), ("d", 90_000, 10)]
    got = compare.overlaps_any_vehicle(charges(spark, s), charges(spark, l)).select("vehicle", "start", "stop", "overlaps").collect()
    meets = lambda a, b: any(x <= p <= y for x, y, p in ((b[1], b[2], a[1]), (b[1], b[2], a[2]), (a[1], a[2], b[1]), (a[1], a[2], b[2])))
    expected = [(a[0], at(a[1]), at(a[2]), sum(meets(a, b) for b in l)) for a in s]
    assert sorted(map(tuple, got)) == sorted(expected)


@pytest.mark.parametrize("width", [1, 100, 10_000])
def test_points_in_intervals_match_brute_force(spark, width):
    rng = random.Random(5)
    points = [(rng.choice("ab"), rng.randrange(-500, 20_000)) for _ in range(200)]
    held = [(rng.choice("ab"), lo, lo + rng.choice([-1, 0, 5, 300, 15_000])) for lo in (rng.randrange(-500, 15_000) for _ in range(60))]
    p = spark.createDataFrame([(k, x, i) for i, (k, x) in enumerate(points)], "k string, x long, i long")
    q = spark.createDataFrame([(k, a, b, j) for j, (k, a, b) in enumerate(held)], "k string, a long, b long, j long")
    got = intervals.points_inside(p, q, ["k"], F.col("x"), F.col("a"), F.col("b"), width, F.col("x").between(F.col("a"), F.col("b")))
    expected = sorted((i, j) for i, (k, x) in enumerate(points) for j, (m, a, b) in enumerate(held) if k == m and a <= x <= b)
    assert sorted(map(tuple, got.select("i", "j").collect())) == expected


@pytest.mark.parametrize("piece", [None, 40])
def test_enclosing_intervals_of_one_day_match_brute_force(spark, piece):
    """All outer intervals begin and end on one day but for a few with wrong clocks; ties of both ends; nodes cut into pieces."""
    rng = random.Random(9)
    outer = [(rng.randrange(0, 200), 86_400 - rng.randrange(0, 300)) for _ in range(400)] + [(-9_000_000_000, 9_000_000_000), (50, 60)] * 2
    inner = [(rng.randrange(-5, 220), 86_400 - rng.randrange(-5, 320)) for _ in range(150)] + [(55, 56), (5, 2)]
    schema = "low long, high long"
    if piece:
        spark.conf.set("spark.voltrail.series.maxRows", str(piece))
    try:
        got = dominance.enclosing(spark.createDataFrame(inner, schema), spark.createDataFrame(outer, schema))
        assert "Python" not in got._jdf.queryExecution().toString() and "Pandas" not in got._jdf.queryExecution().toString()
        have = {(r["low"], r["high"]): r["enclosing"] for r in got.collect()}
    finally:
        spark.conf.unset("spark.voltrail.series.maxRows")
    assert all(have.get((a, b), 0) == sum(x < a and y > b for x, y in outer) for a, b in inner)
    assert dominance.enclosing(spark.createDataFrame(inner, schema), spark.createDataFrame([], schema)).count() == 0


def test_best_overlap_takes_the_earliest_partner(spark):
    s, l = charges(spark, [("a", 0, 1000)]), charges(spark, [("a", 500, 600), ("a", 100, 200), ("a", -300_000, 50)])
    best = compare.best_overlap(s, l).collect()
    assert len(best) == 1 and best[0]["start_l"] == at(100)


def test_session_coverage_counts_the_fan_out(spark):
    l, s = charges(spark, [("a", 0, 10), ("a", 1, 10), ("b", 0, 10)]), charges(spark, [("a", 2, 10), ("a", 3, 10), ("c", 0, 9)])
    row = compare.session_coverage(s, l).first()
    assert (row["l_rows"], row["s_rows"], row["matched_rows"], row["matched_vehicles"]) == (3, 3, 4, 1)
    assert row["l_percent"] == pytest.approx(400 / 3)


def test_vehicles_not_common(spark):
    got = compare.vehicles_not_common(charges(spark, [("a", 0, 1), ("b", 0, 1)]), charges(spark, [("b", 0, 1), ("c", 0, 1)]))
    assert sorted(map(tuple, got.collect())) == [("a", "first"), ("c", "second")]


def test_exact_quantiles_match_the_standard_library(spark):
    rng = random.Random(6)
    data = {"x": [rng.choice([0.0, 1.0, 1.0, 1.0, rng.random() * 1e6]) for _ in range(301)], "y": [5.0], "z": [rng.gauss(0, 1) for _ in range(200)]}
    frame = spark.createDataFrame([(g, v) for g, vs in data.items() for v in vs], "g string, v double")
    got = {r["g"]: (r["q25"], r["q50"], r["q75"]) for r in profile.exact_quantiles(frame, "v", "g", (0.25, 0.5, 0.75)).collect()}
    assert got["y"] == (5.0, 5.0, 5.0)
    for name in ("x", "z"):
        assert got[name] == pytest.approx(statistics.quantiles(data[name], n=4, method="inclusive"))


def test_histogram_closes_the_last_bin(spark):
    frame = spark.createDataFrame([("a", float(v)) for v in range(11)] + [("b", 10.0)], "g string, v double")
    got = {(r["g"], r["bin"]): r["n"] for r in profile.histogram(frame, "v", "g", 10).collect()}
    assert got[("a", 9)] == 2 and got[("b", 9)] == 1 and sum(got.values()) == 12


def test_box_and_outliers(spark):
    frame = spark.createDataFrame([("a", float(v)) for v in [1, 2, 3, 4, 5, 100]], "g string, v double")
    box = profile.box_statistics(frame, "v", "g").first()
    assert (box["whisker_low"], box["whisker_high"], box["fliers"]) == (1.0, 5.0, 1)
    outside = profile.outside_quartiles(frame, "v", "g").collect()
    assert sorted((r["v"], r["is_largest"]) for r in outside) == [(1.0, False), (2.0, False), (5.0, False), (100.0, True)]


def test_longest_keeps_ties(spark):
    frame = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", 3.0), ("b", 2.0)], "g string, v double")
    assert sorted(map(tuple, dedup.rows_at_maximum(frame, "v", ["g"]).select("g", "v").collect())) == [("a", 3.0), ("a", 3.0), ("b", 2.0)]


def test_sample_is_repeatable(spark):
    frame = spark.range(1000).withColumnRenamed("id", "vehicle")
    one = [r[0] for r in dedup.sample_ids(frame.union(frame), "vehicle", 30, 3).collect()]
    two = [r[0] for r in dedup.sample_ids(frame.repartition(7), "vehicle", 30, 3).collect()]
    assert one == two and len(set(one)) == 30


def test_event_series_and_repeats(spark):
    frame = charges(spark, [("a", 0, 100), ("a", 0, 100), ("b", 5, 6)])
    names = ("session", "msg", "time")
    events = event_series.to_events(frame, ("session_start", "msg_start", "start"), ("session_stop", "msg_stop", "stop"), names, ("soc_gain",))
    assert events.count() == 6
    gains = event_series.without_repeats(events, "soc_gain", ("session", "time", "msg", "event"))
    assert sorted(r["soc_gain"] for r in gains.collect()) == [0, 0, 0, 0, 1.0, 1.0]
    assert event_series.ordered(events, "time").first()["vehicle"] == "a"


def test_run_difference_and_drift(spark):
    schema = "vehicle string, session long, msg long, event string, time timestamp"
    first = spark.createDataFrame([("a", 1, i, "plug", at(i)) for i in range(3)], schema)
    second = spark.createDataFrame([("a", 1, i, "plug", at(i + 200_000)) for i in range(2)], schema)
    summary = audit.difference_summary(audit.run_difference(first, second)).first()
    assert (summary["least"], summary["greatest"], summary["missing"], summary["n"]) == (-200_000, -200_000, 1, 3)
    drift = audit.run_drift(first, second).first()
    assert (drift["mean_diff"], drift["pairs"], drift["drifts"]) == (-200_000.0, 2, True)


def test_anonymised_keeps_column_order(spark):
    frame = spark.createDataFrame([(1, "v", 2)], "a int, vehicle string, b int")
    assert fleet.anonymised(frame, "k").columns == ["a", "pseudonym", "b"]
    assert fleet.anonymised(frame, "k", name="id").columns == ["a", "id", "b"]
    with pytest.raises(ValueError):
        fleet.anonymised(frame)
    spark.conf.set("spark.voltrail.pseudonym.secret", "k")
    assert fleet.anonymised(frame).collect() == fleet.anonymised(frame, "k").collect()
    spark.conf.unset("spark.voltrail.pseudonym.secret")


def test_family_labels(spark):
    vehicles = spark.createDataFrame([("v", "F1"), ("w", "F2")], "vehicle string, family string")
    families = spark.createDataFrame([("F1", "small car")], "family string, label string")
    assert [r["label"] for r in fleet.family_labels(vehicles, families).collect()] == ["small car"]
