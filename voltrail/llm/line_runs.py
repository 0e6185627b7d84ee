"""Repeated lines by levelled sorted runs of line hashes, in DataFrame functions only.

A run is a table of line hashes, dealt into buckets and sorted within them, with how many documents of its batch
held the line and the largest of their ids. A batch of documents is reduced to such rows and merge-anti-joined with all runs:
what no run holds is a run of its own, so every line stands in one run; what runs hold already
are repeats, which bring the counts up to date. When a level has `FAN` runs they are merged into one of the next level, so
a batch meets few runs however many came before. All runs have equal buckets, so those joins move no rows.

Lines that enough documents hold are dropped everywhere but in the largest of them. A line that a great part of all
documents hold is one row here: counts are combined before the shuffle, and the occurrences of the most frequent lines, which
are few by their number, meet a broadcast list.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voltrail.llm.common import LOWER, UPPER
from voltrail.session import stage, stage_buckets

MIN_CHARS = 40
MIN_DOCS = 5
#: Batches that the documents of one call are dealt to, and runs of one level that are merged.
BATCHES = 4
FAN = 4
#: A line held by more than one in so many occurrences is frequent; there are fewer such lines than this.
FREQUENT = 10_000
STRIPPED = " \t\n\x0b\x0c\r"
HASH = ("h1", "h2")


class Run(NamedTuple):
    level: int
    #: (h1, h2, docs, largest), in buckets by hash and sorted.
    lines: DataFrame


class Index(NamedTuple):
    buckets: int
    runs: tuple[Run, ...] = ()
    #: Tables of the same columns: lines of later batches that a run held already.
    repeats: tuple[DataFrame, ...] = ()


def new_index(spark: SparkSession) -> Index:
    return Index(int(spark.conf.get("spark.sql.shuffle.partitions")))


def key(line: str | Column) -> Column:
    """What makes lines equal: the line without blanks at its ends, A-Z lower-cased."""
    line = F.col(line) if isinstance(line, str) else line
    return F.translate(F.btrim(line, F.lit(STRIPPED)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _row(text: str) -> Column:
    """Tells rows of one id apart by their texts."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def occurrences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, batches: int = BATCHES) -> DataFrame:
    """Written rows (batch, h1, h2, id, row, at), in order of batch: every line whose key is long enough, with its place. Rows without an id have none.

    All rows of an id are in one batch.
    """
    split = docs.filter(F.col(id_column).isNotNull()).select(F.col(id_column).alias("id"), _row(text_column).alias("row"),
                                                             F.posexplode(lines_of(F.col(text_column))).alias("at", "line"))
    keyed = split.filter(F.length("line") >= min_chars).withColumn("key", key("line")).filter(F.length("key") >= min_chars)
    rows = keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "id", "row", "at",
                        F.pmod(F.xxhash64("id"), F.lit(batches)).cast("int").alias("batch"))
    return stage(rows.sortWithinPartitions("batch", *HASH), "occurrences")  # a batch reads its pages only


def ingest(index: Index, batch: DataFrame) -> Index:
    """The index with the lines of one more batch: rows (h1, h2, id). An id must not be in two batches.

    One merge with the runs and one write: the table of the batch says of each line whether it is new.
    """
    own = batch.groupBy(*HASH).agg(F.count_distinct("id").alias("docs"), F.max("id").alias("largest"))
    table = stage_buckets(marked(own.repartition(index.buckets, *HASH), index.runs), HASH, name="run", buckets=index.buckets)
    run, again = (table.filter(f).drop("new") for f in ("new", "not new"))
    return compacted(Index(index.buckets, (*index.runs, Run(0, run)), (*index.repeats, again)))


def marked(lines: DataFrame, runs: Sequence[Run]) -> DataFrame:
    """The lines with a column `new`: no run holds them. Sorted buckets are merged, and no row of a run moves."""
    new = F.lit(True)
    for i, run in enumerate(runs):
        lines = lines.join(run.lines.select(*HASH, F.lit(True).alias(f"in_{i}")).hint("merge"), list(HASH), "left")
        new = new & F.col(f"in_{i}").isNull()
    return lines.select(*HASH, "docs", "largest", new.alias("new"))


def compacted(index: Index) -> Index:
    """Merges the runs of every level that has `FAN` of them. Runs have no line in common, so nothing needs to be counted."""
    runs = list(index.runs)
    level = 0
    while any(r.level >= level for r in runs):
        here = [r for r in runs if r.level == level]
        if len(here) >= FAN:
            merged = here[0].lines
            for run in here[1:]:
                merged = merged.unionByName(run.lines)
            runs = [r for r in runs if r.level != level] + [Run(level + 1, stage_buckets(merged, HASH, name="run", buckets=index.buckets))]
        level += 1
    return index._replace(runs=tuple(runs))


def repeated(index: Index, min_docs: int = MIN_DOCS) -> DataFrame:
    """(h1, h2, docs, largest) of the lines that at least so many documents hold, written."""
    tables = [*(r.lines for r in index.runs), *index.repeats]
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more)
    whole = rows.groupBy(*HASH).agg(F.sum("docs").alias("docs"), F.max("largest").alias("largest"))
    return stage(whole.filter(F.col("docs") >= min_docs), "repeated")


def _gone(found: DataFrame, lines: DataFrame) -> DataFrame:
    """(id, row, gone): the places of the lines that each row loses.

    Frequent lines are fewer than `FREQUENT`, as their documents are distinct occurrences; they are broadcast and their
    occurrences stay where they are. Any other line has few occurrences, which are shuffled by its hash.
    """
    most = found.count() / FREQUENT
    frequent = F.broadcast(lines.filter(F.col("docs") > most))
    places = found.join(frequent, list(HASH)).select("id", "row", "at", "largest")
    others = found.join(frequent.select(*HASH), list(HASH), "left_anti").join(lines.filter(F.col("docs") <= most), list(HASH))
    places = places.unionByName(others.select("id", "row", "at", "largest")).filter(F.col("id") < F.col("largest"))
    return places.groupBy("id", "row").agg(F.array_sort(F.collect_set("at")).alias("gone"))


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
                 batches: int = BATCHES) -> DataFrame:
    """(id, n_lines, n_dropped, kept) of every row, the id under its own name; other columns are not read.

    Lines of at least `min_chars` code points in their key that at least `min_docs` ids hold go, but for all of those in the largest
    such id. A null or empty text is one empty line. Rows without an id neither count nor lose anything. Rows of one id count as one
    document, and each of them loses the lines that its id loses. No line is lost from an empty table.
    """
    index = new_index(docs.sparkSession)
    found = occurrences(docs, id_column, text_column, min_chars, batches)
    for batch in range(batches):
        index = ingest(index, found.filter(F.col("batch") == batch))
    return without(docs, _gone(found, repeated(index, min_docs)), id_column, text_column)


def without(docs: DataFrame, gone: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's lines but those at its places of `gone`; a text is cut once at those places, whatever their number."""
    rows = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"), _row(text_column).alias("row"))
    met = rows.join(gone, ["id", "row"], "left").withColumn("lines", lines_of(F.col("text")))
    none = F.array().cast("array<int>")
    ends = F.concat("gone", F.array(F.size("lines")))
    begins = F.concat(F.array(F.lit(0)), F.transform("gone", lambda g: g + 1))
    pieces = F.zip_with(begins, ends, lambda a, b: F.slice(F.col("lines"), a + 1, b - a))
    kept = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(F.flatten(pieces), "\n"))
    return met.select(F.col("id").alias(id_column), F.size("lines").cast("long").alias("n_lines"),
                      F.size(F.coalesce("gone", none)).cast("long").alias("n_dropped"), kept.alias("kept"))
