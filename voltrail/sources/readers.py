"""Scans of telemetry, stage tables, CSV dimensions and catalog tables."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from voltrail.operators.dedup import dedup_messages


def read_messages(spark: SparkSession, root: str, kind: int, first: date, last: date,
                  vehicles: Sequence[str] | DataFrame | None = None, collector: str | None = None,
                  schema: T.StructType | None = None) -> DataFrame:
    """Messages of one kind from ``root/kind=K/day=D``; only the wanted folders are read."""
    reader = spark.read.schema(_with_partitions(schema)) if schema else spark.read
    rows = reader.option("basePath", root).parquet(f"{root}/kind={kind}")
    rows = rows.filter(F.col("day").between(F.lit(first), F.lit(last)))
    return _restricted(rows, vehicles, collector).drop("kind", "day")


def _with_partitions(schema: T.StructType) -> T.StructType:
    fields = list(schema.fields)
    if "collector" not in schema.names:
        fields.append(T.StructField("collector", T.StringType()))
    return T.StructType([*fields, T.StructField("kind", T.IntegerType()), T.StructField("day", T.DateType())])


def select_messages(messages: DataFrame, first: date, last: date, vehicles: Sequence[str] | DataFrame | None = None,
                    collector: str | None = None, time: str = "ts") -> DataFrame:
    """Messages of an inclusive range of days; the time filter reaches the file scan."""
    begin, end = F.lit(first).cast("timestamp"), F.date_add(F.lit(last), 1).cast("timestamp")
    return _restricted(messages.filter((F.col(time) >= begin) & (F.col(time) < end)), vehicles, collector)


def _restricted(rows: DataFrame, vehicles: Sequence[str] | DataFrame | None, collector: str | None) -> DataFrame:
    """Ids are joined as a table of the column's own type, however many there are."""
    if collector is not None:
        rows = rows.filter(F.col("collector") == collector)
    if vehicles is None:
        return rows
    if not isinstance(vehicles, DataFrame):
        vehicles = rows.sparkSession.createDataFrame([(v,) for v in vehicles], T.StructType([rows.schema["vehicle"]]))
    return rows.join(vehicles.select("vehicle"), "vehicle", "left_semi")


def cleaned(messages: DataFrame, soc: str, clean: Column) -> DataFrame:
    """The cleaned form of a raw scan: one row per message, sentinels marked."""
    return dedup_messages(messages).withColumn(soc, clean)


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, separator: str = ";") -> DataFrame:
    """A delimited file with a header, in the types given instead of text."""
    return (spark.read.schema(schema).option("header", True).option("sep", separator)
            .option("timestampFormat", "yyyy-MM-dd HH:mm:ss").csv(path))


def read_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


def read_stage(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_month(spark: SparkSession, path: str, year: int, month: int) -> DataFrame:
    """One month of charges; other months' files are not opened."""
    return spark.read.parquet(path).filter((F.col("year") == year) & (F.col("month") == month))


def rename_columns(df: DataFrame, code_map: DataFrame, source: str = "standard_name") -> DataFrame:
    """Rename by the code map, from ``standard_name`` to ``short_code`` or back; unknown names stay.

    The map is asked for this table's columns only, so what reaches the driver is never more than
    one row per column.
    """
    if source not in ("standard_name", "short_code"):
        raise ValueError(f"cannot rename from {source!r}")
    target = "short_code" if source == "standard_name" else "standard_name"
    known = code_map.filter(F.col(source).isin(df.columns) & F.col(target).isNotNull())
    pairs = known.groupBy(source).agg(F.max(target).alias(target)).collect()
    return df.withColumnsRenamed({row[source]: row[target] for row in pairs})
