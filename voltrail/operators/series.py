"""Ordered series per vehicle, also when one vehicle is too long for one task.

Most steps look at neighbouring messages of a vehicle, which a window over the vehicle
gives. A vehicle that holds a large share of all rows would put them all in one task, so
such *long* series are cut into pieces of equal row count. Rows near a cut are copied to the
neighbouring piece (``before`` / ``after`` rows), so that windows with a bounded row
reach see the same rows as they would uncut; values carried over any distance
(:func:`carry`, :func:`running_total`) pass from piece to piece through one row per piece.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, replace
from math import ceil

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from voltrail.session import stage

MAX_ROWS_SETTING = "spark.voltrail.series.maxRows"
MAX_ROWS = 2_000_000
TASK_ROWS_SETTING = "spark.voltrail.series.taskRows"
TASK_ROWS = 100_000
MARKS = ("_piece", "_own", "_pos")


@dataclass(frozen=True)
class LongSeries:
    """The series above the row limit, as a written table of their keys."""

    frame: DataFrame
    keys: tuple[str, ...]
    size: int


@dataclass(frozen=True)
class Series:
    """Rows with the columns that name a series and the columns that order it fully."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    long: LongSeries | None = None

    def window(self, backward: bool = False) -> WindowSpec:
        part = self.keys + ("_piece",) if self.long else self.keys
        order = [F.col(c).desc() if backward else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*part).orderBy(*order)

    def with_columns(self, columns: dict[str, Column]) -> "Series":
        return replace(self, rows=self.rows.withColumns(columns))

    def without(self, *columns: str) -> "Series":
        return replace(self, rows=self.rows.drop(*columns))

    def where(self, condition: Column) -> "Series":
        return replace(self, rows=self.rows.filter(condition))

    def select(self, columns: Sequence[Column | str], order: Sequence[str]) -> "Series":
        """Other columns and another order for the same rows; within a piece and from piece to piece the order must be the same."""
        marks = MARKS if self.long else ()
        return replace(self, rows=self.rows.select(*columns, *marks), order=tuple(order))

    def owned(self, name: str = "series") -> "Series":
        """The series without copies of rows. A cut one is written, since later steps read it several times; it keeps its pieces."""
        if self.long is None:
            return self
        return replace(self, rows=stage(self.rows.filter("_own"), name))

    def own_rows(self) -> DataFrame:
        """The rows without copies and marks."""
        if self.long is None:
            return self.rows
        return self.rows.filter("_own").drop(*MARKS)

    def number(self, name: str) -> "Series":
        """Row number from 1 within the series."""
        if self.long is None:
            return self.with_columns({name: F.row_number().over(self.window()).cast("long")})
        return self.with_columns({name: F.col("_pos") + 1})


def find_long(df: DataFrame, keys: Sequence[str], max_rows: int | None = None) -> LongSeries | None:
    """List all series above the row limit; None when there are none."""
    return measure(df, keys, max_rows)[0]


def measure(df: DataFrame, keys: Sequence[str], max_rows: int | None = None) -> tuple[LongSeries | None, int]:
    """The series above the row limit, None when there are none, and the number of rows of all others.

    One pre-aggregated count over the keys. A row per long series and one for the others are written to the shared folder,
    so Spark knows their size when it joins them.
    """
    if max_rows is None:
        max_rows = int(df.sparkSession.conf.get(MAX_ROWS_SETTING, str(MAX_ROWS)))
    counted = with_keys(df, keys).groupBy(*keys).agg(F.count("*").alias("_n"))
    key = F.when(F.col("_n") > max_rows, F.struct(*keys)).alias("_key")
    sizes = stage(counted.groupBy(key).agg(F.sum("_n").alias("_rows")), "long-keys")
    found, rows = sizes.agg(F.count("_key"), F.sum(F.when(F.col("_key").isNull(), F.col("_rows")))).first()
    long = sizes.filter("_key is not null").select("_key.*")
    return LongSeries(long, tuple(keys), max_rows) if found else None, rows or 0


def with_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows that name their series. Rows without a key are in no series and are left out, cut or not."""
    return df.dropna(subset=list(keys))


def split(df: DataFrame, long: LongSeries) -> tuple[DataFrame, DataFrame]:
    """The rows of ordinary and of long series."""
    listed = long.frame
    return df.join(listed, list(long.keys), "left_anti"), df.join(listed, list(long.keys), "left_semi")


def by_length(df: DataFrame, long: LongSeries | None,
              step: Callable[[DataFrame, LongSeries | None], DataFrame]) -> DataFrame:
    """Run ``step`` on the ordinary series and, cut into pieces, on the long ones."""
    if long is None:
        return step(df, None)
    short, cut = split(df, long)
    return step(short, None).unionByName(step(cut, long))


def together(df: DataFrame, keys: Sequence[str], long: LongSeries | None, rows: int = 0) -> DataFrame:
    """One shuffle that serves every later window and key that contains ``keys``.

    With ``rows``, about the number of rows, a task gets some ``spark.voltrail.series.taskRows`` (100,000) of them, or a quarter of that
    where cores would be idle: a task sorts its rows several times, and the memory for that does not grow with the input.
    """
    if long:
        return df
    most = int(df.sparkSession.conf.get(TASK_ROWS_SETTING, str(TASK_ROWS)))
    tasks = max(ceil(rows / most), min(df.sparkSession.sparkContext.defaultParallelism, ceil(4 * rows / most)))
    return df.repartition(tasks, *keys) if tasks > 1 else df.repartition(*keys)


def as_series(df: DataFrame, keys: Sequence[str], order: Sequence[str], long: LongSeries | None = None,
              before: int = 0, after: int = 0) -> Series:
    """Order rows by series; with ``long`` every row must belong to a long series.

    Long series are cut by rank: the rows are sorted in parallel over keys and order, and a row's place is
    its place in its partition and the series' rows in the partitions before. Outliers, nulls and ties in the order do
    not matter to the size of a piece.
    """
    keys, order = tuple(keys), tuple(order)
    df = with_keys(df, keys)
    if long is None:
        return Series(df, keys, order)
    if long.size < max(before, after, 1):
        raise ValueError("pieces must not be shorter than the rows copied over a cut")
    columns = [F.col(c).asc() for c in (*keys, *order)]
    rest = [F.col(c).asc() for c in df.columns if c not in keys + order]  # full ties are cut alike in every run, and anywhere
    placed = df.repartitionByRange(*columns, *rest).sortWithinPartitions(*columns, *rest).withColumn("_place", F.monotonically_increasing_id())
    placed = stage(placed.withColumn("_slot", F.shiftright("_place", 33)), "long-series")  # read several times below and in carry()
    sizes = placed.groupBy(*keys, "_slot").agg(F.count("*").alias("_n"), F.min("_place").alias("_begin"))
    earlier = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(*keys, "_slot", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_begin")).alias("_shift"))
    ranked = (placed.join(sizes, [*keys, "_slot"]).withColumn("_pos", F.col("_place") + F.col("_shift"))
                    .drop("_slot", "_place", "_shift"))
    piece = F.floor(F.col("_pos") / long.size).cast("long")
    offset = F.col("_pos") % long.size
    copies = F.array_compact(F.array(
        F.struct(piece.alias("_piece"), F.lit(True).alias("_own")),
        F.when(offset < after, F.struct((piece - 1).alias("_piece"), F.lit(False).alias("_own"))),
        F.when(long.size - offset <= before, F.struct((piece + 1).alias("_piece"), F.lit(False).alias("_own")))))
    return Series(ranked.select("*", F.inline(copies)), keys, order, long)


@dataclass(frozen=True)
class Carried:
    """A non-null value brought along the series: from before a row, or backward from after it."""

    value: Column
    backward: bool = False
    include_self: bool = True


def carry(series: Series, values: dict[str, Carried]) -> Series:
    """Add for each name the last non-null value at or before each row (or the next one after it).

    All names share one row per piece that takes their values over the cuts.
    """
    def reach(item: Carried) -> WindowSpec:
        return series.window(item.backward).rowsBetween(Window.unboundedPreceding, 0 if item.include_self else -1)

    rows = series.rows.withColumns({n: F.last(v.value, ignorenulls=True).over(reach(v)) for n, v in values.items()})
    if series.long is None:
        return replace(series, rows=rows)
    piece = [*series.keys, "_piece"]
    edges, carried = [], []
    for name, item in values.items():
        place = F.when(item.value.isNotNull(), F.struct(*series.order))
        edges.append((F.min_by if item.backward else F.max_by)(item.value, place).alias(f"_edge_{name}"))
        order = F.col("_piece").desc() if item.backward else F.col("_piece").asc()
        earlier = Window.partitionBy(*series.keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        carried.append(F.last(f"_edge_{name}", ignorenulls=True).over(earlier).alias(f"_carried_{name}"))
    taken = series.rows.filter("_own").groupBy(*piece).agg(*edges).select(*piece, *carried)
    rows = rows.join(taken, piece, "left")
    rows = rows.withColumns({n: F.coalesce(F.col(n), F.col(f"_carried_{n}")) for n in values})
    return replace(series, rows=rows.drop(*[f"_carried_{n}" for n in values]))


def neighbours(series: Series, before: dict[str, Column | str], after: dict[str, Column | str]) -> Series:
    """Add values of the row before and of the row after; null at the ends of the series.

    In a cut series, which must be without copies of rows, the first and last row of each piece are handed to the next
    piece that has rows, by one row per piece.
    """
    by = series.window()
    shifted = {**{n: F.lag(v).over(by) for n, v in before.items()}, **{n: F.lead(v).over(by) for n, v in after.items()}}
    if series.long is None:
        return series.with_columns(shifted)
    piece = [*series.keys, "_piece"]
    place = F.struct(*series.order)
    values = lambda side: F.struct(F.lit(True).alias("_is"), *[v.alias(n) if isinstance(v, Column) else F.col(v).alias(n) for n, v in side.items()])
    ends = series.rows.groupBy(*piece).agg(F.max_by(values(before), place).alias("_end"), F.min_by(values(after), place).alias("_begin"))
    pieces = Window.partitionBy(*series.keys).orderBy("_piece")
    ends = ends.select(*piece, F.lag("_end").over(pieces).alias("_end"), F.lead("_begin").over(pieces).alias("_begin"))
    rows = series.rows.withColumns({**shifted, "_first": F.lag(F.lit(1)).over(by).isNull(), "_last": F.lead(F.lit(1)).over(by).isNull()})
    rows = rows.join(ends, piece).withColumns({
        **{n: F.when(F.col("_first"), F.col("_end")[n]).otherwise(F.col(n)) for n in before},
        **{n: F.when(F.col("_last"), F.col("_begin")[n]).otherwise(F.col(n)) for n in after}})
    return replace(series, rows=rows.drop("_first", "_last", "_end", "_begin"))


def running_total(series: Series, name: str, value: Column) -> Series:
    """Sum of ``value`` from the start of the series to each row; copies of rows do not count."""
    series = _running(series, name, F.sum, value, 0)
    return series if series.long is None else series.with_columns({name: F.col(name) + F.col("_ahead")}).without("_ahead")


def maximum_before(series: Series, name: str, value: Column) -> Series:
    """The largest ``value`` of all earlier rows of the series, null at its start."""
    series = _running(series, name, F.max, value, -1)
    return series if series.long is None else series.with_columns({name: F.greatest(name, "_ahead")}).without("_ahead")


def _running(series: Series, name: str, function: Callable[[Column | str], Column], value: Column, last: int) -> Series:
    """A function from the start of the series to each row (or to the one before); in a cut series from the start of the piece, beside that of all
    earlier pieces in ``_ahead``."""
    if series.long is None:
        return series.with_columns({name: function(value).over(series.window().rowsBetween(Window.unboundedPreceding, last))})
    owned = replace(series, rows=series.rows.filter("_own"))
    reach = owned.window().rowsBetween(Window.unboundedPreceding, last)
    piece = [*series.keys, "_piece"]
    whole = owned.rows.groupBy(*piece).agg(function(value).alias("_whole"))
    earlier = Window.partitionBy(*series.keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    ahead = function("_whole").over(earlier)
    whole = whole.select(*piece, (F.coalesce(ahead, F.lit(0)) if function is F.sum else ahead).alias("_ahead"))
    return replace(owned, rows=owned.rows.withColumn(name, function(value).over(reach)).join(whole, piece))


def series_minimum(series: Series, name: str, column: str) -> Series:
    """The smallest value of the ordering column ``column`` in the series."""
    if series.long is None:
        reach = series.window().rowsBetween(Window.unboundedPreceding, 0)
        return series.with_columns({name: F.min(column).over(reach)})
    lowest = series.rows.groupBy(*series.keys).agg(F.min(column).alias(name))  # one row per long series
    return replace(series, rows=series.rows.join(lowest, list(series.keys)))
