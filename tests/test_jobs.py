"""Sources, sinks, the rolling job and the stream."""

import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from voltrail import schemas
from voltrail.operators.battery_log import unify
from voltrail.plans import rolling
from voltrail.sources import readers, sinks, testviews as V
from voltrail.streaming import daily

CONFIG = json.dumps({"vin": ["v1", "v2"], "start_date": "2024-01-01", "end_date": "2024-01-05", "folder_name": "run"})


@pytest.fixture(scope="module")
def landed(spark, small, tmp_path_factory):
    """Raw messages in day folders."""
    root = str(tmp_path_factory.mktemp("raw"))
    text = lambda df: df.withColumn("vehicle", F.col("vehicle").cast("string"))
    sinks.land_raw({68: text(V.remote(spark, small, False)), 79: text(V.summary(spark, small, False)),
                    74: text(V.vehicle_status(spark, small))}, root)
    return root


def days(spark, root):
    def read(first, last):
        return unify(readers.read_messages(spark, root, 68, first, last, schema=schemas.battery_remote()),
                     readers.read_messages(spark, root, 79, first, last, schema=schemas.battery_summary()))
    return read


def test_scan_prunes_days_and_filters(spark, landed):
    rows = readers.read_messages(spark, landed, 79, date(2024, 1, 3), date(2024, 1, 4), ["3", "4", "5"], "odd", schemas.battery_summary())
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "LeftSemi" in plan
    got = rows.select("vehicle", F.to_date("ts").alias("d")).distinct().collect()
    assert got and {r["vehicle"] for r in got} <= {"3", "4", "5"} and {r["d"] for r in got} <= {date(2024, 1, 3), date(2024, 1, 4)}
    assert readers.read_messages(spark, landed, 79, date(2024, 1, 3), date(2024, 1, 4), collector="other").isEmpty()


def test_rename_both_ways(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "LONG_A int, other int, LONG_B int")
    names = spark.createDataFrame([("LONG_A", "A"), ("LONG_B", "B"), ("LONG_C", "C")], "standard_name string, short_code string")
    short = readers.rename_columns(frame, names)
    assert short.columns == ["A", "other", "B"]
    assert readers.rename_columns(short, names, "short_code").columns == frame.columns
    with pytest.raises(ValueError):
        readers.rename_columns(frame, names, "third")


def test_csv_with_types(spark, tmp_path):
    (tmp_path / "map.csv").write_text("standard_name;short_code\nLONG;L\n")
    assert readers.read_csv(spark, str(tmp_path / "map.csv"), schemas.code_map()).collect() == [("LONG", "L")]
    (tmp_path / "run.csv").write_text("vehicle,time\nv,2024-01-01 10:00:00\n")
    row = readers.read_csv(spark, str(tmp_path / "run.csv"), "vehicle string, time timestamp", ",").first()
    assert row["time"].hour == 10


def test_run_record_and_paths(spark, tmp_path):
    config = sinks.RunConfig.from_json(CONFIG)
    sinks.write_run_record(spark, config, str(tmp_path))
    row = readers.read_stage(spark, f"{tmp_path}/run/run_config").first()
    assert row["vehicles"] == ["v1", "v2"] and row["charges_path"].endswith("run/charges") and row["run_at"] is not None


def test_month_folders_and_row_count(spark, tmp_path):
    path = str(tmp_path / "charges")
    frame = spark.range(10).select(F.concat(F.lit("v"), "id").alias("vehicle"),
                                   F.when(F.col("id") < 4, F.lit("2024-01-31")).otherwise("2024-02-01").cast("timestamp").alias("ts_start"))
    assert sinks.append_months(frame, path) == 10
    assert sinks.append_months(frame, path) == 10
    assert readers.read_month(spark, path, 2024, 1).count() == 8


def test_table_sink(spark):
    sinks.save_table(spark.range(3), "charge_table")
    assert readers.read_table(spark, "charge_table").count() == 3
    spark.sql("drop table charge_table")


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="b"):
        schemas.require(spark.createDataFrame([(1,)], "a int"), "a", "b")


FIRST, END = date(2024, 1, 1), date(2024, 1, 6)
KEY = ["window", "vehicle", "msg_start", "msg_stop"]


def test_daily_job_equals_all_windows_and_can_be_repeated(spark, landed, tmp_path):
    path = str(tmp_path / "charges")
    counts = rolling.run_days(spark, days(spark, landed), FIRST, END, path)
    written = sorted(map(tuple, spark.read.parquet(path).select(*KEY).collect()))
    at_once = rolling.all_windows(days(spark, landed)(FIRST, END), FIRST, END)
    assert written == sorted(map(tuple, at_once.select(*KEY).collect()))
    assert sum(counts.values()) == len(written) > 0
    assert len({k[1:3] for k in written}) == len(written)  # no charge start twice


def test_tasks_of_the_chain_hold_as_many_rows_whatever_the_input(spark):
    """A task sorts its rows several times, so its memory goes with its rows; rows without a vehicle are in no task's count."""
    from voltrail.plans import status_method

    def battery(vehicles):
        rows = spark.range(vehicles * 30).selectExpr("nullif(id div 30, 7) as vehicle", "id % 30 as msg")
        ts = F.timestamp_seconds(F.lit(1704067200) + F.col("msg") * 20000)
        none = F.lit(None)
        return rows.select(F.lit(25).alias("vtype"), "vehicle", F.lit(1).cast("long").alias("session"), F.lit(68).alias("msg_type"), "msg", ts.alias("ts"),
                           F.lit(99.0).alias("rts"), none.cast("long").alias("load_level"), none.cast("double").alias("summary_soc"),
                           (F.col("msg") * 3 + 1).alias("soc"), F.lit(0).alias("charge_mode"), (F.col("msg") % 2).cast("int").alias("status"))

    def largest_task(frame):
        rows = status_method.repaired(rolling.in_windows(frame, FIRST, END).drop("part"), rolling.WINDOW_KEYS)
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id().alias("task")).count().collect()]
        return max(sizes), sum(sizes)

    def charges(frame):
        return sorted(map(tuple, rolling.all_windows(frame, FIRST, END).collect()), key=str)

    plain = charges(battery(50))
    spark.conf.set("spark.voltrail.series.taskRows", "500")
    try:
        for vehicles in (50, 400):
            most, rows = largest_task(battery(vehicles))
            assert rows > 40 * vehicles and most < 1000
        assert charges(battery(50)) == plain and len(plain) > 49
    finally:
        spark.conf.unset("spark.voltrail.series.taskRows")


def test_chain_of_repeats(spark):
    """A charge dropped in one window no longer hides its successor in the next."""
    rows = [("a", date(2024, 1, 1), 1, 10), ("a", date(2024, 1, 2), 5, 20), ("a", date(2024, 1, 3), 15, 30), ("a", date(2024, 1, 4), 40, 50)]
    keys = spark.createDataFrame(rows, "vehicle string, window date, msg_start long, msg_stop long")
    new = rolling._new_charges(keys).select("msg_start").collect()
    assert sorted(r[0] for r in new) == [1, 15, 40]


def test_stream_follows_landed_days(spark, landed, tmp_path):
    """Days come in any order and late; the result is that of the whole job, for windows of which all has landed."""
    from pyspark.sql.types import IntegerType, StructField, StructType

    schema = StructType([*schemas.battery_summary().fields[:0], StructField("ts", schemas.battery_summary()["ts"].dataType), StructField("kind", IntegerType())])
    landing, out = str(tmp_path / "landing"), str(tmp_path / "out")

    def land(kind, *days_of_january):
        wanted = [F.lit(date(2024, 1, d)) for d in days_of_january]
        rows = spark.read.parquet(f"{landed}/kind={kind}").filter(F.col("day").isin(*wanted))
        rows.withColumn("kind", F.lit(kind)).write.mode("append").partitionBy("kind", "day").parquet(landing)

    def run():
        daily.follow(spark, landing, schema, days(spark, landing), out, str(tmp_path / "state"), str(tmp_path / "stream")).awaitTermination()
        return sorted(map(tuple, spark.read.parquet(out).select("window", "vehicle", "msg_start", "msg_stop").collect()))

    def whole(first, end):
        rows = rolling.all_windows(days(spark, landing)(first, end), first, end)
        return sorted(map(tuple, rows.select(*KEY).collect()))

    land(79, 1, 2, 3, 4)
    land(68, 1, 3, 4)
    assert run() == whole(date(2024, 1, 3), date(2024, 1, 4))
    land(68, 2)  # late
    assert run() == whole(date(2024, 1, 1), date(2024, 1, 4))


def test_a_late_file_reruns_only_what_changes(spark, tmp_path, monkeypatch):
    """Thirty windows; a window emits its days' files less what the one before emitted, so a late file changes two of them."""
    landing, state, out = (str(tmp_path / name) for name in ("landing", "state", "out"))
    schema = spark.createDataFrame([], "ts timestamp, kind int").schema
    emitted, worked, failing = {}, [], []
    first, count = date(2024, 1, 1), 31

    def land(day, *kinds):
        rows = spark.createDataFrame([(datetime(day.year, day.month, day.day, 5), k, day) for k in kinds], "ts timestamp, kind int, day date")
        rows.write.mode("append").partitionBy("kind", "day").parquet(landing)

    def work(spark, rows, day, output, follows):
        if day in failing:
            failing.remove(day)
            raise RuntimeError("lost")
        worked.append(day)
        last = emitted.get(day - timedelta(days=1), "") if follows else ""
        emitted[day] = "".join(sorted(set(files.get(day, "") + files.get(day + timedelta(days=1), "")) - set(last)))
        return len(emitted[day]), emitted[day]

    monkeypatch.setattr(daily, "run_marked_day", work)
    run = lambda: daily.follow(spark, landing, schema, lambda a, b: None, out, state, str(tmp_path / "stream")).awaitTermination()
    files = {first + timedelta(days=i): chr(300 + i) for i in range(count)}
    rows = spark.createDataFrame([(datetime(d.year, d.month, d.day, 5), k, d) for d in files for k in (68, 79)], "ts timestamp, kind int, day date")
    rows.write.partitionBy("kind", "day").parquet(landing)
    run()
    assert worked == sorted(files)[:30]
    late = first + timedelta(days=4)
    files[late] += "z"
    worked.clear()
    land(late, 68)
    run()
    assert worked == [late - timedelta(days=1), late] or worked == [late - timedelta(days=1), late, late + timedelta(days=1)]
    whole = {}
    for d in sorted(files)[:30]:
        last = whole.get(d - timedelta(days=1), "")
        whole[d] = "".join(sorted(set(files[d] + files[d + timedelta(days=1)]) - set(last)))
    assert emitted == whole
    files[late] += "y"
    worked.clear()
    failing.append(late)
    land(late, 79)
    with pytest.raises(Exception):
        run()
    run()
    for d in sorted(files)[:30]:
        last = whole.get(d - timedelta(days=1), "") if d > first else ""
        whole[d] = "".join(sorted(set(files[d] + files[d + timedelta(days=1)]) - set(last)))
    assert emitted == whole and len(worked) <= 5


def test_marks_do_not_depend_on_the_order_of_rows(spark, tmp_path):
    day, rows = date(2024, 1, 1), spark.createDataFrame([("a", 1, 2), ("b", 3, 4), ("b", 5, 6)], "vehicle string, msg_start long, msg_stop long")
    keys = ("vehicle", "msg_start", "msg_stop")
    mark = lambda df: sinks.write_marked_window(df, str(tmp_path), day, keys)
    assert mark(rows) == mark(rows.orderBy(F.desc("msg_start")).repartition(3)) and mark(rows)[0] == 3
    assert mark(rows)[1] != mark(rows.filter("msg_start > 1"))[1] and mark(rows.limit(0)) == (0, "0:0")


def test_a_window_that_turns_out_empty_replaces_its_rows(spark, tmp_path):
    path, day = str(tmp_path / "out"), date(2024, 1, 1)
    row = spark.createDataFrame([("v", 1)], "vehicle string, msg_start long")
    assert sinks.write_window(row, path, day) == 1 and sinks.write_window(row.limit(0), path, day) == 0
    assert spark.read.parquet(path).count() == 0


def test_a_short_list_of_vehicles_skips_row_groups(spark, tmp_path):
    """40,000 messages of 2,000 vehicles; names next to each other lie far apart in the list that is read."""
    conf, size = spark.sparkContext._jsc.hadoopConfiguration(), "parquet.block.size"
    rows = spark.range(40_000).select(F.concat(F.lit("vehicle-"), F.md5((F.col("id") % 2000).cast("string"))).alias("vehicle"),
                                      F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id")).alias("ts"), F.md5(F.col("id").cast("string")).alias("load"))
    wanted = [r["vehicle"] for r in rows.filter("id in (3, 700, 1500)").collect()]
    conf.set(size, str(64 << 10))
    try:
        sinks.land_raw({74: rows}, str(tmp_path), (74,))
    finally:
        conf.unset(size)
    for ids, most in ((wanted, 0.2), (wanted + ["vehicle-0none"], 0.2), (["vehicle-7" + "f" * 31], 0.0)):
        found = spark.read.parquet(f"{tmp_path}/kind=74").filter(F.col("vehicle").isin(ids))
        assert found.count() == 20 * len(set(ids) & set(wanted))
        found = spark.read.parquet(f"{tmp_path}/kind=74").filter(F.col("vehicle").isin(ids)).select("vehicle", "load")
        found.collect()
        leaves = found._jdf.queryExecution().executedPlan().collectLeaves()
        read = sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))
        assert read <= most * 40_000


def test_landing_a_day_keeps_the_others(spark, tmp_path):
    def at(day):
        return {74: spark.createDataFrame([("v", f"2024-01-0{day} 10:00:00")], "vehicle string, ts string").withColumn("ts", F.to_timestamp("ts"))}
    for day in (1, 2, 2):
        sinks.land_raw(at(day), str(tmp_path), (74,))
    assert spark.read.parquet(f"{tmp_path}/kind=74").count() == 2


def test_ids_of_any_number_and_type(spark):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-01")], "vehicle int, ts string").withColumn("ts", F.to_timestamp("ts"))
    many = readers.select_messages(rows, date(2024, 1, 1), date(2024, 1, 1), list(range(2, 3000)))
    assert [r["vehicle"] for r in many.collect()] == [2] and many.schema["vehicle"].dataType.simpleString() == "int"
