"""Joins on intervals, by equal bins instead of a range comparison alone.

Every interval is put into the bins it touches and joined on ``(keys, bin)``, so one
busy vehicle spreads over many join keys and nothing is compared across distant times.
An interval has a home level, the finest one at which it touches few bins, which bounds its rows however long
it is. A pair meets at the higher home of its two: there the longer interval stands in its home bins and the
shorter one is copied to, so rows are compared only where one of them fills a good part of the bin. A pair that shares several
bins is kept in the first of them only, so no de-duplication is needed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from voltrail.session import stage

#: Bins that an interval may touch at its home level, and by how much bins grow from level to level.
FAN = 64
NARROW_FAN = 4
LARGEST = 2 ** 63


def levels(width: int, fan: int = FAN) -> int:
    """How many levels it takes until ``fan`` bins span all 64-bit numbers (or the bins themselves would be wider)."""
    return next(k for k in range(1, 64) if width * fan ** k >= LARGEST // fan)


def _homed(df: DataFrame, low: Column, high: Column, width: int, fan: int, name: str) -> DataFrame:
    """Adds the span ``{name}lo``, ``{name}hi`` and its home level; rows without a span go."""
    df = df.withColumns({f"{name}lo": low, f"{name}hi": high}).filter(F.col(f"{name}lo").isNotNull())
    lo, hi, last = F.col(f"{name}lo"), F.col(f"{name}hi"), levels(width, fan) - 1
    home = F.lit(last)
    for level in reversed(range(last)):
        step = width * fan ** level
        home = F.when(F.floor(hi / step) - F.floor(lo / step) < fan, level).otherwise(home)
    return df.withColumn(f"{name}home", home)


def _in_bins(df: DataFrame, name: str, width: int, fan: int, at: dict[int, Column]) -> DataFrame:
    """One row per bin touched, at each level for which the row fulfils a condition."""
    lo, hi = F.col(f"{name}lo"), F.col(f"{name}hi")
    none = F.array().cast("array<struct<_level:int,_bin:bigint,first:bigint>>")
    each = [none]
    for level, condition in at.items():
        step = width * fan ** level
        first = F.floor(lo / step)
        each.append(F.when(condition, F.transform(F.sequence(first, F.floor(hi / step)), _entry(level, first))).otherwise(none))
    return df.select("*", F.inline(F.concat(*each)).alias("_level", "_bin", f"{name}first")).drop(f"{name}lo", f"{name}hi", f"{name}home")


def _entry(level: int, first: Column) -> Callable[[Column], Column]:
    return lambda at: F.struct(F.lit(level).alias("_level"), at.alias("_bin"), first.alias("first"))


def _used(df: DataFrame, name: str) -> list[int]:
    """The home levels of some rows; there are fewer than 64."""
    return sorted(row[0] for row in df.select(f"{name}home").distinct().collect())


def overlap_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str], left_span: tuple[Column, Column],
                  right_span: tuple[Column, Column], width: int, condition: Column) -> DataFrame:
    """Inner join of rows with equal keys whose spans meet and that fulfil ``condition``.

    Spans are whole numbers (seconds, message ids), ``width`` the finest bin. Apart from the keys the two sides
    must not share column names. Two joins share the pairs: home rows of the left with the right's copies at the
    same and higher levels than their homes, and home rows of the right with the left's at higher ones. Copies are made
    at levels that are some row's home only, so without long intervals there is nothing to compare at the high levels.
    """
    fan = NARROW_FAN
    a = stage(_homed(left, *left_span, width, fan, "_l"), "intervals")
    b = stage(_homed(right, *right_span, width, fan, "_r"), "intervals")

    def pairs(home: DataFrame, own: str, copied: DataFrame, other: str, even: bool) -> DataFrame:
        used = _used(home, own)
        homes = _in_bins(home, own, width, fan, {k: F.col(f"{own}home") == k for k in used})
        copies = _in_bins(copied, other, width, fan, {k: F.col(f"{other}home") <= k if even else F.col(f"{other}home") < k for k in used})
        return homes.join(copies, [*keys, "_level", "_bin"]).filter((F.col("_bin") == F.greatest(f"{own}first", f"{other}first")) & condition)

    columns = [*left.columns, *[c for c in right.columns if c not in keys]]
    return pairs(a, "_l", b, "_r", True).select(*columns).unionByName(pairs(b, "_r", a, "_l", False).select(*columns))


def points_inside(points: DataFrame, intervals: DataFrame, keys: Sequence[str], at: Column,
                  low: Column, high: Column, width: int, condition: Column, finest: str | None = None) -> DataFrame:
    """Inner join of points to the intervals that hold them (both ends included).

    The points are the large side: they are copied only to levels that some interval
    uses, which is one level when no interval is longer than ``FAN`` bins. The binned intervals are
    written, so that they are made once for the list of levels (at most eleven) and for the join. A column ``finest``
    that holds the points' bins of the finest level is joined as it is, so points dealt by it are not shuffled.
    """
    homed = _homed(intervals.filter(low <= high), low, high, width, FAN, "_r")
    wide = stage(_in_bins(homed, "_r", width, FAN, {k: F.col("_rhome") == k for k in range(levels(width))}), "intervals")
    used = sorted(row["_level"] for row in wide.select("_level").distinct().collect()) or [0]
    parts = []
    if finest and 0 in used:
        used.remove(0)
        near = wide.filter("_level = 0").drop("_level").withColumnRenamed("_bin", finest)
        parts.append(points.join(near, [*keys, finest]))
    if used:
        steps = F.array(*[F.struct(F.lit(k).alias("_level"), F.floor(at / (width * FAN ** k)).alias("_bin")) for k in used])
        far = wide.filter("_level > 0") if finest else wide
        parts.append(points.select("*", F.inline(steps)).join(far, [*keys, "_level", "_bin"]).drop("_level", "_bin"))
    pairs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return pairs.filter(condition).drop("_rfirst", *([finest] if finest else []))
