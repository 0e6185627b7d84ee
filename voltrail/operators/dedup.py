"""De-duplication, global numbering, samples and extremes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.session import stage


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key, the first by ``order``.

    Spark drops all but the first row of each key before the shuffle as well
    (WindowGroupLimit), so a key with very many copies sends one row per task.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def dedup_messages(df: DataFrame, keys: Sequence[str] = ("vehicle", "session", "msg")) -> DataFrame:
    """One row per message; of several copies the one with the smallest remaining values stays."""
    rest = [F.col(c).asc_nulls_last() for c in df.columns if c not in keys]
    return first_per_key(df, keys, rest)


def number_globally(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """Row number over the whole table, by a parallel sort.

    The sorted rows are written with their partition and place, then shifted by the
    row counts of the partitions before, a table of one row per partition.
    """
    placed = (df.repartitionByRange(*order).sortWithinPartitions(*order)
                .withColumn("_place", F.monotonically_increasing_id())
                .withColumn("_part", F.shiftright("_place", 33)))
    placed = stage(placed.withColumn("_place", F.col("_place").bitwiseAND(F.lit(2 ** 33 - 1))), "numbered")
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    ahead = sizes.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_ahead"))
    return (placed.join(F.broadcast(ahead), "_part")
                  .withColumn(name, F.col("_ahead") + F.col("_place") + 1).drop("_part", "_place", "_ahead"))


def rows_at_maximum(df: DataFrame, value: str, groups: Sequence[str]) -> DataFrame:
    """The rows that hold their group's maximum, ties included; for a handful of groups."""
    top = stage(df.groupBy(*groups).agg(F.max(value).alias(value)))
    return df.join(top, [*groups, value], "left_semi")


def sample_ids(df: DataFrame, column: str, n: int, seed: int = 0) -> DataFrame:
    """``n`` distinct ids in an order set by the seed, so that a sample can be drawn again."""
    ids = df.select(column).distinct()
    drawn = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col(column).cast("string")))
    return ids.orderBy(drawn, column).limit(n)
