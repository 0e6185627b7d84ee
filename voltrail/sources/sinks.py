"""Writers: stage tables, month folders, catalog tables, the raw landing and the run record."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

RAW_KINDS = (68, 74, 79)
VEHICLES_IN_A_ROW_GROUP = 20_000


@dataclass(frozen=True)
class RunConfig:
    """One run: which vehicles, which days (end excluded), and where to write."""

    vehicles: tuple[str, ...]
    start_date: date
    end_date: date
    folder_name: str
    start_plot: str | None = None
    end_plot: str | None = None

    @classmethod
    def from_json(cls, text: str) -> "RunConfig":
        raw = json.loads(text)
        return cls(tuple(raw["vin"]), date.fromisoformat(raw["start_date"]), date.fromisoformat(raw["end_date"]),
                   raw["folder_name"], raw.get("start_periode_plot"), raw.get("end_periode_plot"))

    def charges_path(self, root: str) -> str:
        return f"{root}/{self.folder_name}/charges"

    def raw_path(self, root: str) -> str:
        return f"{root}/{self.folder_name}/raw"


def overwrite(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_months(df: DataFrame, path: str, time: str = "ts_start") -> int:
    """Append charges under ``year=/month=``; returns the number of rows, counted while writing.

    Rows are gathered by month in partitions of about the advised size, so a large month gets many writers and a
    small one a single file.
    """
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"))
    part = counted.withColumns({"year": F.year(time), "month": F.month(time)})
    part.hint("rebalance", F.col("year"), F.col("month")).write.mode("append").partitionBy("year", "month").parquet(path)
    return seen.get["rows"]


def write_window(df: DataFrame, path: str, day: date) -> int:
    """Charges of one window under ``year=/month=/window=``; returns the number of rows.

    The window's own folder is replaced as a whole, so a run that is repeated leaves no row twice, and
    none of an earlier run when it finds nothing.
    """
    return write_marked_window(df, path, day)[0]


def write_marked_window(df: DataFrame, path: str, day: date, keys: Sequence[str] = ()) -> tuple[int, str]:
    """:func:`write_window`, with a mark of what the ``keys`` of its rows are, whatever their order; taken while writing."""
    seen = Observation()
    hashed = F.coalesce(F.sum(F.xxhash64(*keys).cast("decimal(38,0)")), F.lit(0)) if keys else F.lit(0)
    df.observe(seen, F.count(F.lit(1)).alias("rows"), hashed.cast("string").alias("mark")).write.mode("overwrite").parquet(window_path(path, day))
    found = seen.get
    return found["rows"], f"{found['rows']}:{found['mark']}"


def window_path(path: str, day: date) -> str:
    return f"{path}/year={day.year}/month={day.month}/window={day}"


def save_table(df: DataFrame, name: str, source: str = "parquet") -> None:
    """A catalog table; ``source="delta"`` where that package is installed."""
    df.write.mode("overwrite").format(source).saveAsTable(name)


def land_raw(messages: Mapping[int, DataFrame], path: str, kinds: Sequence[int] = RAW_KINDS) -> None:
    """Write each message kind to ``path/kind=K/day=D``, the layout that the reader prunes by.

    Days that are landed again are replaced; all other days stay. Rows are in order of vehicle and time, so a file holds
    few vehicles of few days and a vehicle with many messages several files; a Bloom filter on the vehicle lets a
    reader with a short list skip what lies between.
    """
    for kind in kinds:
        order = [c for c in ("day", "vehicle", "ts") if c in (*messages[kind].columns, "day")]
        rows = messages[kind].withColumn("day", F.to_date("ts")).repartitionByRange(*order).sortWithinPartitions(*order)
        (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("parquet.bloom.filter.enabled#vehicle", "true")
             .option("parquet.bloom.filter.expected.ndv#vehicle", str(VEHICLES_IN_A_ROW_GROUP)).partitionBy("day").parquet(f"{path}/kind={kind}"))


def write_run_record(spark: SparkSession, config: RunConfig, root: str) -> DataFrame:
    """One row with the configuration, the time and the output paths, as Parquet."""
    record = spark.createDataFrame(
        [(list(config.vehicles), config.start_date, config.end_date, config.folder_name,
          datetime.now(timezone.utc), config.charges_path(root), config.raw_path(root))],
        "vehicles array<string>, start_date date, end_date date, folder_name string, "
        "run_at timestamp, charges_path string, raw_path string")
    overwrite(record, f"{root}/{config.folder_name}/run_config")
    return record
