"""Column expressions on hand-made values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from voltrail.functions import battery as B, clock, codes


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_duration_seconds(spark):
    rows = [("P1Y2M3DT4H5M6.7S",), ("PT1H",), ("P1M",), ("PT1M",), (None,), ("PT0S",)]
    got = values(spark, rows, "d string", clock.duration_seconds(F.col("d")))
    expected = [37091108.0, 3600.0, 2629800.0, 60.0, None, 0.0]
    assert got[4] is None
    assert [g for i, g in enumerate(got) if i != 4] == pytest.approx([e for e in expected if e is not None], rel=1e-6)


def test_sentinels_then_displayed_soc(spark):
    rows = [(26, 102.2), (26, 0.0), (25, 0.0), (25, 57.9), (26, 95.0), (26, None), (30, 50.0), (25, 999.0)]
    cleaned = B.clean_sentinel(F.col("v"), F.col("s"), B.SUMMARY_INVALID, bev=B.SUMMARY_INVALID_BEV)
    got = values(spark, rows, "v int, s double", B.displayed_soc(F.col("v"), cleaned))
    assert got == [999, 0, 999, 57, 100, 999, 999, 999]


def test_displayed_soc_rounds_half_to_even(spark):
    scaled = [(26, 21.897 + 0.7246 * x) for x in (2.5, 3.5)]
    python = [round((s - 21.897) / 0.7246) for _, s in scaled]
    assert values(spark, scaled, "v int, s double", B.displayed_soc(F.col("v"), F.col("s"))) == python


def test_remote_sentinels(spark):
    rows = [(25, 127), (26, 66), (25, 66), (26, None)]
    column = B.clean_sentinel(F.col("v"), F.col("s"), B.REMOTE_INVALID, phev=B.REMOTE_INVALID_PHEV)
    assert values(spark, rows, "v int, s long", column) == [999, 999, 66, None]


def test_speed_and_power_class(spark):
    rows = [(26, 45, 7200), (25, 0, 600), (25, 10, 0), (25, None, 600), (30, 10, 600)]
    frame = spark.createDataFrame(rows, "v int, gain long, seconds long")
    speed = B.charge_speed(F.col("gain"), F.col("seconds"))
    power = B.charge_kw(F.col("v"), speed)
    got = [tuple(r) for r in frame.select(speed, B.power_class(power)).collect()]
    assert got[0] == (22.5, "2-GreenUp 3.7kW(<5.5)")  # 2.7 in float32 is not below 2.7
    assert got[1] == (0.0, "0-Uncertain <1.2kW")
    assert got[2] == (None, "6-not classified")
    assert got[3] == (None, "6-not classified")
    assert got[4] == (60.0, "6-not classified")


def test_gap_is_cut_toward_zero(spark):
    a, b = datetime(2024, 1, 1, 0, 0, 0, 900000), datetime(2024, 1, 1, 0, 0, 2)
    rows = [(a, b), (b, a), (a, None)]
    assert values(spark, rows, "a timestamp, b timestamp", clock.seconds_between(F.col("a"), F.col("b"))) == [1, -1, None]


def test_clock_correction(spark):
    ts, close = datetime(2024, 1, 1), datetime(2024, 1, 1, 1)
    rows = [(ts, 10.0, close, 70.4), (ts, 10.0, None, 70.0), (ts, None, close, 70.0)]
    column = clock.corrected_time(F.col("a"), F.col("r"), F.col("c"), F.col("cr"))
    got = values(spark, rows, "a timestamp, r double, c timestamp, cr double", column)
    assert got == [datetime(2024, 1, 1, 0, 59), ts, ts]


def test_near_midnight(spark):
    times = [(23, 29, 59), (23, 30, 0), (0, 30, 59), (0, 31, 0), (0, 10, 0), (0, 10, 1)]
    rows = [(datetime(2024, 1, 1, *t),) for t in times]
    assert values(spark, rows, "t timestamp", clock.near_midnight(F.col("t"))) == [False, True, True, False, True, True]
    assert values(spark, rows, "t timestamp", clock.near_midnight_exact(F.col("t"))) == [False, True, False, False, True, False]


def test_parse_time_gives_null_for_bad_text(spark):
    rows = [("2024-01-01 10:00:00",), ("yesterday",)]
    assert values(spark, rows, "t string", clock.parse_time(F.col("t"))) == [datetime(2024, 1, 1, 10), None]


def test_pseudonym(spark):
    import hashlib
    rows = [("v1",), (None,)]
    got = values(spark, rows, "v string", codes.pseudonym(F.col("v"), "k"))
    assert got == [hashlib.md5(b"v1k").hexdigest(), None]
    assert values(spark, rows[:1], "v string", codes.pseudonym(F.col("v"), "k", "sha2")) == [hashlib.sha256(b"v1k").hexdigest()]
    with pytest.raises(ValueError):
        codes.pseudonym(F.col("v"), "k", "crc")


def test_code_slots(spark):
    frame = spark.createDataFrame([("01A04B",)], "c string")
    row = frame.select(codes.slot_value(F.col("c"), F.lit(2)), codes.slot_index(F.col("c"), F.lit(2))).first()
    assert tuple(row) == ("04", "B")
