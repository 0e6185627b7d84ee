"""Statistics over charge tables.

Groups are labels such as the method. Their summaries are written as tables before they are joined back, so
Spark knows their size: a small one is broadcast, a large one is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.session import stage


def exact_quantiles(df: DataFrame, value: str, group: str, probabilities: Sequence[float]) -> DataFrame:
    """Interpolated quantiles per group, without gathering a group's values in one task.

    Values are counted per distinct value, and the counts are range-partitioned, which evens the partitions out whatever
    the values are. The totals per partition tell which partitions hold the wanted ranks, and only the
    values of those are put in order. The input is read once.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(group, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    placed = stage(counts.repartitionByRange(group, "_v").withColumn("_bucket", F.spark_partition_id()), "counts")
    per_group = Window.partitionBy(group)  # one row per partition
    before = per_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy(group, "_bucket").agg(F.sum("_n").alias("_in"))
    totals = totals.withColumns({"_total": F.sum("_in").over(per_group), "_ahead": F.coalesce(F.sum("_in").over(before), F.lit(0))})
    wanted = F.array(*[F.lit(float(p)) for p in probabilities])
    ranks = totals.withColumn("_p", F.explode(wanted)).withColumn("_rank", F.col("_p") * (F.col("_total") - 1))
    low, high = F.floor("_rank"), F.ceil("_rank")
    end = F.col("_ahead") + F.col("_in")
    ranks = ranks.filter(((low >= F.col("_ahead")) & (low < end)) | ((high >= F.col("_ahead")) & (high < end)))
    ranks = ranks.select(group, "_bucket", "_ahead", "_p", "_rank")
    inside = Window.partitionBy(group, "_bucket", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    found = placed.join(stage(ranks), [group, "_bucket"])
    found = found.withColumn("_last", F.col("_ahead") + F.sum("_n").over(inside) - 1)
    found = found.withColumn("_first", F.col("_last") - F.col("_n") + 1)

    def at(rank: Column) -> Column:
        return F.max(F.when((rank >= F.col("_first")) & (rank <= F.col("_last")), F.col("_v")))

    ends = found.groupBy(group, "_p", "_rank").agg(at(low).alias("_a"), at(high).alias("_b"))
    result = F.col("_a") + (F.col("_rank") - F.floor("_rank")) * (F.col("_b") - F.col("_a"))
    ends = ends.withColumn("_q", result)
    picks = [F.max(F.when(F.col("_p") == float(p), F.col("_q"))).alias(f"q{round(p * 100)}") for p in probabilities]
    return ends.groupBy(group).agg(*picks)


def describe(df: DataFrame, columns: Sequence[str], group: str) -> DataFrame:
    """Count, mean, standard deviation, least, quartiles and greatest of each column, per group."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    long = df.select(group, F.inline(pairs)).withColumn("_part", F.concat_ws("|", group, "column"))
    basic = long.groupBy("_part", group, "column").agg(
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("least"), F.max("value").alias("greatest"))
    return basic.join(exact_quantiles(long, "value", "_part", (0.25, 0.5, 0.75)), "_part", "left").drop("_part")


def date_range(df: DataFrame, group: str) -> DataFrame:
    return df.groupBy(group).agg(F.min("start").alias("first_start"), F.max("start").alias("last_start"),
                                 F.min("stop").alias("first_stop"), F.max("stop").alias("last_stop"))


def vehicle_counts(df: DataFrame, group: str) -> DataFrame:
    """Rows and distinct vehicles, counted through one row per vehicle."""
    per_vehicle = df.groupBy(group, "vehicle").agg(F.count("*").alias("rows"))
    return per_vehicle.groupBy(group).agg(F.sum("rows").alias("rows"), F.count("vehicle").alias("vehicles"))


def describe_ids(df: DataFrame, name: str, time: str, group: str) -> DataFrame:
    """Of an id: count, distinct, the most frequent and how often; of a time: first and last. Counted through one row per id."""
    each = df.groupBy(group, name).agg(F.count(name).alias("_n"), F.min(time).alias("_first"), F.max(time).alias("_last"))
    top = F.max(F.when(F.col(name).isNotNull(), F.struct("_n", (-F.col(name)).alias("_id"))))
    described = each.groupBy(group).agg(F.sum("_n").alias("n"), F.count(name).alias("unique"), top.alias("_top"),
                                        F.min("_first").alias("first"), F.max("_last").alias("last"))
    return described.select(group, "n", "unique", (-F.col("_top._id")).alias("top"), F.col("_top._n").alias("freq"), "first", "last")


def histogram(df: DataFrame, value: str, group: str, bins: int, weight: str | None = None, density: bool = False) -> DataFrame:
    """Counts in equal bins over the range of all groups; the last bin includes its end.

    With ``weight`` a row counts as much as that column says; with ``density`` the area over all bins of a group is 1.
    """
    known = df.filter(F.col(value).isNotNull())
    kept = [weight] if weight else []
    span = known.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("span"))
    low, high = F.col("_span.lo"), F.col("_span.hi")
    width = (high - low) / bins
    index = F.when(high == low, 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - low) / width)))
    placed = known.select(group, value, *kept, span.scalar().alias("_span")).withColumn("bin", index.cast("long"))
    amount = F.count("*") if weight is None else F.sum(weight)
    counted = placed.groupBy(group, "bin").agg(amount.alias("n"), F.min(low + F.col("bin") * width).alias("bin_start"), F.min(width).alias("_width"))
    if density:
        total = F.sum("n").over(Window.partitionBy(group))  # at most one row per bin
        counted = counted.withColumn("n", F.try_divide(F.col("n"), total * F.col("_width")))
    return counted.drop("_width")


def box_statistics(df: DataFrame, value: str, group: str) -> DataFrame:
    """Quartiles, whiskers within 1.5 times their distance, and the number of points beyond."""
    quartiles = stage(exact_quantiles(df, value, group, (0.25, 0.5, 0.75)))
    reach = 1.5 * (F.col("q75") - F.col("q25"))
    low, high = F.col("q25") - reach, F.col("q75") + reach
    inside = F.col(value).between(low, high)
    joined = df.filter(F.col(value).isNotNull()).select(group, value).join(quartiles, group)
    return joined.groupBy(group, "q25", "q50", "q75").agg(
        F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.count(F.when(~inside, 1)).alias("fliers"), F.count("*").alias("n"))


def outside_quartiles(df: DataFrame, value: str, group: str) -> DataFrame:
    """Rows below the first or above the third quartile; ``is_largest`` marks the greatest of each group."""
    quartiles = stage(exact_quantiles(df, value, group, (0.25, 0.75)))
    outside = df.join(quartiles, group).filter((F.col(value) < F.col("q25")) | (F.col(value) > F.col("q75")))
    top = outside.groupBy(group).agg(F.max(value).alias("_top"))
    return outside.join(stage(top), group).withColumn("is_largest", F.col(value) == F.col("_top")).drop("_top", "q25", "q75")


def start_probability(df: DataFrame, group: str) -> DataFrame:
    """Each row with the share of its group's rows that start at the same instant."""
    same = df.groupBy(group, "start").agg(F.count("*").alias("_n"))
    total = same.groupBy(group).agg(F.sum("_n").alias("_total"))
    share = same.join(stage(total), group).select(group, "start", (F.col("_n") / F.col("_total")).alias("probability"))
    return df.join(share, [group, "start"])
