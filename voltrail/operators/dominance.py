"""How many intervals enclose each of some others, by a merge tree over ranks.

The outer intervals are ranked by their beginnings. At level k of the tree every 2**k consecutive ranks form a node.
An interval asks about the outer ones that begin before it, which is a prefix of the ranks: one node per
bit set in its length. Within a node the ends are put in order, and a running count says how many lie beyond. So an outer
interval has a row per level and a question at most as many, and a node is a series like any other: large ones are cut into pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voltrail.operators.series import MAX_ROWS, MAX_ROWS_SETTING, LongSeries, as_series, by_length, find_long, running_total
from voltrail.session import stage

NODE = ("_level", "_node")


def enclosing(spans: DataFrame, outer: DataFrame) -> DataFrame:
    """(low, high, enclosing): of how many rows of ``outer`` the beginning is smaller and the end larger.

    Spans that no outer row can enclose may be missing. Three numbers come to the driver.
    """
    outer = stage(outer.groupBy("low", "high").agg(F.count("*").alias("n")), "outer")
    first, last, rows = outer.agg(F.min("low"), F.max("high"), F.count("*")).first()
    asked = spans.select("low", "high").filter((F.col("low") > first) & (F.col("high") < last)).distinct()
    levels = range(max(rows, 1).bit_length())
    ranked, rank = _ranked(asked, outer), F.col("_rank")
    own = F.array(*[_node(k, F.shiftright(rank - 1, k)) for k in levels])
    before = F.filter(F.array(*[_node(k, F.shiftright(rank, k) - 1) for k in levels]), lambda node: node["_node"] % 2 == 0)
    spread = ranked.select("low", "high", "n", (-F.col("high")).alias("_end"), F.inline(F.when(F.col("n") > 0, own).otherwise(before)))

    def beyond(rows: DataFrame, long: LongSeries | None) -> DataFrame:
        """Of equal ends the questions come first."""
        return running_total(as_series(rows, NODE, ("_end", "n", "low"), long), "_beyond", F.col("n")).own_rows()

    counted = by_length(spread, find_long(spread, NODE), beyond).filter("n = 0")
    return counted.groupBy("low", "high").agg(F.sum("_beyond").alias("enclosing"))


def _node(level: int, at: Column) -> Column:
    return F.struct(F.lit(level).alias("_level"), at.alias("_node"))


def _ranked(asked: DataFrame, outer: DataFrame) -> DataFrame:
    """Outer rows with their ranks from 1, and questions (n = 0) with the number of outer rows that begin before them; written."""
    rows = outer.unionByName(asked.withColumn("n", F.lit(0).cast("long"))).withColumn("_all", F.lit(0))
    size = int(outer.sparkSession.conf.get(MAX_ROWS_SETTING, str(MAX_ROWS)))
    series = as_series(rows, ("_all",), ("low", "n", "high"), LongSeries(rows, ("_all",), size))  # of equal beginnings the questions come first
    return stage(running_total(series, "_rank", F.when(F.col("n") > 0, 1).otherwise(0)).own_rows().drop("_all"), "ranked")
