"""Shared pieces of the corpus operators: table reads, row keys, word patterns, components."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from voltrail.session import stage

#: A word: a maximal run of anything but space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors' Python workers, once per application."""
    if not getattr(spark.sparkContext, "_voltrail_shipped", False):
        top = Path(__file__).resolve().parents[2]
        archive = Path(tempfile.mkdtemp(prefix="voltrail-")) / "voltrail.zip"
        with zipfile.ZipFile(archive, "w") as z:
            for source in sorted((top / "voltrail").rglob("*.py")):
                z.write(source, source.relative_to(top))
        spark.sparkContext.addPyFile(str(archive))
        spark.sparkContext._voltrail_shipped = True
    return spark


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    return ship(spark).read.parquet(f"{folder.rstrip('/')}/{name}.parquet").select(*columns)


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id's text, modulo a divisor; null for a null id."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(column.cast("string").cast("binary")) % divisor


def held_out(doc_id: str | Column, divisor: int, rest: int) -> Column:
    """True for the rows kept out of learning; a null id counts as learning."""
    return F.coalesce(remainder(doc_id, divisor) == rest, F.lit(False))


def text_bytes(text: str) -> Column:
    """UTF-8 bytes of a text; null is empty."""
    return F.coalesce(F.col(text), F.lit("")).cast("binary")


def words_column(text: str | Column) -> Column:
    """The words of a text as an array; null and blank texts give an empty array."""
    column = F.col(text) if isinstance(text, str) else text
    return F.filter(F.split(F.coalesce(column, F.lit("")), BLANKS), lambda w: w != "")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of undirected links: (node, root), root the smallest node reachable.

    Alternating large and small stars; every round is a grouped minimum and a join, and is written to
    the shared folder, so no task holds a component and a lost executor repeats one round at most.
    Nodes without a link to another node are not listed.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = stage(edges, "links")
    before = None
    while True:
        edges = stage(_small_star(_large_star(edges)), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = tuple(now)


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    larger = both.filter("v > u").join(least, "u")
    return larger.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Edges have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    smaller = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return smaller.unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def broadcast_if_small(df: DataFrame, most_rows: int = 500_000, name: str = "side") -> DataFrame:
    """Written rows of `df`, to be broadcast by the next join if they are counted to be few; else that join shuffles."""
    df = stage(df, name)
    return F.broadcast(df) if df.count() <= most_rows else df


#: A key of more than one in so many rows is frequent; there are fewer such keys than this.
FREQUENT = 10_000


def joined_to_frequent(rows: DataFrame, counted: DataFrame, keys: list[str], n: str) -> DataFrame:
    """Inner join of written rows to a written table of keys, of which column `n` says how many of the rows have each.

    Rows of frequent keys stay where they are: those keys are fewer than FREQUENT by their number, and are broadcast. The other
    rows are shuffled, no more than one in FREQUENT of them to a key. Every row meets its key either way.
    """
    most = rows.count() / FREQUENT
    frequent = F.broadcast(counted.filter(F.col(n) > most).drop(n))
    others = rows.join(frequent.select(*keys), keys, "left_anti").join(counted.filter(F.col(n) <= most).drop(n), keys)
    return rows.join(frequent, keys).unionByName(others)


def row_key(id_column: str, text_column: str) -> Column:
    """Identity of a row: its id and its text. Rows that agree in both are treated alike by every operator."""
    return F.struct(F.col(id_column).alias("id"), F.xxhash64(F.coalesce(F.col(text_column), F.lit(""))).alias("text"),
                    F.length(text_column).alias("chars"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores as it takes to be none of the table's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, so that helper columns beside it cannot clash with them."""
    return F.struct(*[F.col(f"`{c}`") for c in df.columns])


def bounded_sample(ids: DataFrame, group: str, id_column: str, most: int) -> DataFrame:
    """Up to `most` rows (group, id) of each group, in order of a hash of the id, as a written table.

    Groups are first thinned by hash to slightly more than `most` rows, so that no task ranks a whole group.
    There must be few groups: their counts are broadcast.
    """
    counts = F.broadcast(ids.groupBy(group).agg(F.count("*").alias("rows_")))
    place = F.xxhash64(id_column)
    near = F.pmod(place, F.lit(1 << 31)) < (1 << 31) * (1.2 * most + 100) / F.col("rows_")
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.pmod(place, F.lit(1 << 31)), id_column))
    return stage(ids.join(counts, group).filter(near).withColumn("rank_", rank).filter(F.col("rank_") <= most).select(group, id_column), "chosen")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, learn: Column, per_class: int, id_column: str = "doc_id",
                    text_column: str = "text") -> DataFrame:
    """Up to `per_class` labelled rows of each class 0 and 1, as a written table (id, text, y).

    `learn` (over the id column of `docs`) says which rows may be used. Rows are taken in order of a hash of their id, so a
    repeated run takes the same. An id with several labels has the larger one; of repeated rows one text is taken.
    """
    known = labels.filter(F.col(label).isin(0, 1) & F.col(id_column).isNotNull()).groupBy(id_column).agg(F.max(label).cast("int").alias("y"))
    ids = docs.filter(learn).select(id_column).distinct().join(known, id_column)
    chosen = bounded_sample(ids, "y", id_column, per_class).withColumnRenamed(id_column, "id")
    texts = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return stage(texts.join(F.broadcast(chosen), "id").groupBy("id", "y").agg(F.min("text").alias("text")), "sample")
