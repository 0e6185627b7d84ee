"""Benchmark decontamination by spaced seeds, in DataFrame functions only.

Texts become hashes of their words (runs of letters and digits, lower-case). A mask keeps four positions of a span and
ignores the others, so a seed also meets a passage with substituted words in between. The four masks
between them meet every pattern of equal and replaced words that the threshold accepts in an item of seven words or more (a test
runs through all of them). Shorter items are met by a hash of all their words. Document seeds are
joined with benchmark seeds; each hit names a document, an item and a diagonal, and there the whole
item is laid over the document: the best segment by (equal words) - (different words) is its overlap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from voltrail.llm.common import broadcast_if_small, row_key, whole_row
from voltrail.session import stage

#: Kept positions of each mask.
MASKS = ((0, 2, 3, 4), (0, 2, 3, 5), (0, 3, 4, 5), (0, 2, 3, 7))
#: Items of fewer words have one seed, the whole item.
SEEDED = 7
MIN_WORDS = 10
MIN_SHARE = 0.6
SEEDS_TO_BROADCAST = 1_000_000


def word_hashes(text: str) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def whole(n: int) -> tuple[int, ...]:
    """The mask of an item of n words, all of them kept."""
    return tuple(range(n))


def seeds(rows: DataFrame, hashes: str, masks=MASKS) -> DataFrame:
    """A row (key, pos) for each mask and position of the array `hashes`, beside the other columns. A key names its mask."""
    used = sorted({p for mask in masks for p in mask})
    shifted = F.arrays_zip(*[(F.col(hashes) if p == 0 else F.slice(hashes, F.lit(p + 1), F.size(hashes))).alias(f"w{p}") for p in used])
    others = [c for c in rows.columns if c != hashes]
    at = rows.select(*others, F.posexplode(shifted).alias("pos", "w"))
    keys = F.array(*[F.when(F.col(f"w.w{max(mask)}").isNotNull(), F.xxhash64(F.lit(str(mask)), *[F.col(f"w.w{p}") for p in mask]))
                     for mask in masks])
    return at.select(*others, "pos", F.explode(keys).alias("key")).filter("key is not null")


def beneath(doc: str, diagonal: str, length: str) -> Column:
    """The words of a document that lie under an item of some length at a diagonal; no more than the item has."""
    begin = F.greatest(F.col(diagonal), F.lit(0))
    return F.slice(doc, begin + 1, F.greatest(F.col(diagonal) + F.col(length) - begin, F.lit(0)))


def overlap(item: str, doc: str, diagonal: str) -> Column:
    """struct(score, equal, start): the best segment of an item laid over what :func:`beneath` cut out of a document at a diagonal."""
    first = F.greatest(F.lit(0), -F.col(diagonal))
    offset = F.least(F.col(diagonal), F.lit(0))
    last = F.least(F.size(item), F.size(doc) - offset) - 1
    here = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    zero = F.struct(*[F.lit(0).alias(n) for n in ("run", "same", "begin", "score", "equal", "start")])

    def step(acc, j):
        hit = F.get(F.col(item), j) == F.get(F.col(doc), j + offset)
        fresh = acc["run"] <= 0
        run = F.when(fresh, 0).otherwise(acc["run"]) + F.when(hit, 1).otherwise(-1)
        same = F.when(fresh, 0).otherwise(acc["same"]) + F.when(hit, 1).otherwise(0)
        begin = F.when(fresh, j + F.col(diagonal)).otherwise(acc["begin"])
        best = run > acc["score"]
        return F.struct(run.alias("run"), same.alias("same"), begin.alias("begin"),
                        F.when(best, run).otherwise(acc["score"]).alias("score"),
                        F.when(best, same).otherwise(acc["equal"]).alias("equal"),
                        F.when(best, begin).otherwise(acc["start"]).alias("start"))

    return F.aggregate(here, zero, step, lambda acc: F.struct(*[acc[n].alias(n) for n in ("score", "equal", "start")]))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text",
                 item_column: str = "item_id", item_text: str = "text", min_words: int = MIN_WORDS,
                 min_share: float = MIN_SHARE, masks=MASKS) -> DataFrame:
    """One row per document row and item that overlap: key (see row_key), doc_id, item_id, item_words, equal_words,
    overlap (equal less different words of the best segment), start (its first word in the document).

    A pair counts if its overlap is at least min(min_words, min_share of the item's words). Items of fewer than SEEDED words
    count only where all their words stand in a row, as a part of them is too short to tell from ordinary text; null and empty texts
    have no words and items without words are not looked for. Null ids stay null; rows equal in id and text are reported once, as are repeated items; empty tables give no rows.
    """
    sources = docs.select(row_key(id_column, text_column).alias("key_"), F.col(text_column).alias("text_"))
    items = stage(benchmark.select(F.col(item_column).alias("item_id"), word_hashes(item_text).alias("item"))
                  .distinct().withColumn("item_key", F.xxhash64("item_id", F.to_json("item"))), "items")
    lengths = [r.n for r in items.select(F.size("item").alias("n")).filter(F.col("n").between(1, SEEDED - 1)).distinct().orderBy("n").collect()]
    sized = items.select("item_key", "item", F.size("item").alias("item_words"))
    wanted = seeds(sized.filter(F.col("item_words") >= SEEDED), "item", masks)
    for n in lengths:
        wanted = wanted.unionByName(seeds(sized.filter(F.col("item_words") == n), "item", (whole(n),)))
    wanted = broadcast_if_small(wanted.select("item_key", "item_words", "key", F.col("pos").alias("at")).distinct(), SEEDS_TO_BROADCAST, "seeds")
    found = seeds(sources.select("key_", word_hashes("text_").alias("words")), "words", (*masks, *map(whole, lengths)))
    hits = found.join(wanted, "key").select("key_", "item_key", "item_words", (F.col("pos") - F.col("at")).alias("diagonal")).distinct()
    hits = broadcast_if_small(hits, name="hits").alias("h")
    of = sources.join(hits, F.col("h.key_").eqNullSafe(sources["key_"])).select(
        "h.key_", "h.item_key", "diagonal", "item_words", word_hashes("text_").alias("all_words"))
    of = of.select("key_", "item_key", "diagonal", beneath("all_words", "diagonal", "item_words").alias("words")).distinct()
    laid = of.join(items, "item_key").select(
        "key_", "item_id", F.size("item").alias("item_words"), overlap("item", "words", "diagonal").alias("o"))
    best = laid.groupBy("key_", "item_id", "item_words").agg(F.max("o").alias("o"))
    enough = F.col("o.score") >= F.least(F.lit(float(min_words)), F.col("item_words") * min_share)
    return best.filter(enough).select(F.col("key_").alias("key"), F.col("key_.id").alias("doc_id"), "item_id", "item_words",
                                      F.col("o.equal").alias("equal_words"), F.col("o.score").alias("overlap"), "o.start")


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **settings) -> DataFrame:
    """The rows of `docs` that overlap no benchmark item; all columns stay, whatever their names. Repeated rows stay or go together, null
    texts and rows without an id are judged like all others, empty tables on either side take nothing away."""
    found = contaminated(docs, benchmark, id_column, text_column, **settings).select("key").distinct()
    found = broadcast_if_small(found, name="found")
    rows = docs.select(whole_row(docs).alias("row"), row_key(id_column, text_column).alias("of"))
    return rows.join(found, rows["of"].eqNullSafe(found["key"]), "left_anti").select("row.*")
