"""Removal of word windows that repeat across documents, behind a count-min prefilter.

1. Exact copies are settled by their text: of a class of equal texts only the smallest id goes on, and the
   others lose every word that a whole window covers.
2. Each window of `window` words has an anchor, the least hash among its shingles of `shingle` words. Equal
   windows have equal anchors, so a window is no more frequent than its anchor, and a count-min
   sketch of anchors overestimates window counts. It counts one anchor per document, with about 20 times
   fewer entries than windows. Every task counts its own cells, and the partial counts are merged per cell; the
   width follows the number of anchors, so the sketch is as sharp, and its parts as small, at any size.
3. Windows whose anchor is estimated to repeat, in all cells, are grouped exactly (by 128 bits of hash),
   and those that also start in a document with a smaller id are marked. No repeated window is lost.
4. Words under marked windows are removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voltrail.llm.common import broadcast_if_small, joined_to_frequent, text_bytes
from voltrail.session import stage

WINDOW, SHINGLE = 50, 8
DEPTH, CELLS_PER_ANCHOR = 2, 64
DOCS_AT_ONCE = 500
CACHE_WORDS = 300_000
MARKS_TO_BROADCAST = 4_000_000
#: Odd multipliers of the two window hashes.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)

KEY = "id long, digest binary"
#: Marks of a document as (first window, last window) of each run.
RUNS = "id long, part int, firsts array<int>, lasts array<int>"


class WordHashes(dict):
    """128 bits of hash per word, remembered."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) > CACHE_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_128_intdigest(word)
        return value


_hashes = WordHashes()
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n."""
    if base not in _powers or len(_powers[base][0]) < n:
        size = 1 << n.bit_length()
        _powers[base] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, b, np.uint64)]) for b in (base, pow(base, -1, 1 << 64)))
    return _powers[base]


def rolling(hashes: np.ndarray, width: int, base: int) -> np.ndarray:
    """Hash of each run of `width` neighbours: the sum of hash * base^place, modulo 2^64."""
    up, down = powers(base, len(hashes) + width)
    total = np.r_[np.uint64(0), np.cumsum(hashes * down[:len(hashes)])]
    return (total[width:] - total[:-width]) * up[width - 1:width - 1 + len(hashes) - width + 1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbours, from running minima within blocks of that size."""
    n = len(x) - width + 1
    blocks = np.pad(x, (0, -len(x) % width), constant_values=np.iinfo(x.dtype).max).reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def anchors(hashes: np.ndarray, window: int, shingle: int) -> np.ndarray:
    """The anchor of each window, as a signed 64-bit number."""
    return sliding_least(mixed(rolling(hashes, shingle, BASES[0])), window - shingle + 1).view(np.int64)


def _word_hashes(words: list[bytes]) -> np.ndarray:
    """Shape (words, 2): the two halves of each word's hash."""
    mask = (1 << 64) - 1
    values = [_hashes[w] for w in words]
    return np.array([[v & mask for v in values], [v >> 64 for v in values]], np.uint64).reshape(2, -1)


def _low_hashes(words: list[bytes]) -> np.ndarray:
    mask = (1 << 64) - 1
    return np.fromiter((_hashes[w] & mask for w in words), np.uint64, len(words))


def _anchor_rows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                some = batch.slice(at, DOCS_AT_ONCE)
                found = []
                for text in some.column(2):
                    words = text.as_py().split()
                    found.append(np.unique(anchors(_low_hashes(words), window, shingle)) if len(words) >= window else [])
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(found, pa.list_(pa.int64()))], ["id", "digest", "anchors"])

    return run


def _window_rows(window: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                words = batch.column(2)[i].as_py().split()
                low, high = _word_hashes(words)
                kept = np.flatnonzero(np.isin(anchors(low, window, shingle), batch.column(3)[i].values.to_numpy()))
                yield pa.RecordBatch.from_arrays([
                    pa.repeat(batch.column(0)[i], len(kept)), pa.repeat(batch.column(1)[i], len(kept)),
                    pa.array(rolling(low, window, BASES[0])[kept].view(np.int64)), pa.array(rolling(high, window, BASES[1])[kept].view(np.int64)),
                    pa.array(kept.astype(np.int32))], ["id", "part", "h1", "h2", "pos"])

    return run


def _run_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        firsts, lasts = [], []
        for starts in batch.column(2):
            places = np.sort(starts.values.to_numpy())
            cuts = np.flatnonzero(np.diff(places) > 1)
            firsts.append(places[np.r_[0, cuts + 1]])
            lasts.append(places[np.r_[cuts, len(places) - 1]])
        runs = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(firsts, runs), pa.array(lasts, runs)],
                                         ["id", "part", "firsts", "lasts"])


def _kept_rows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                some = batch.slice(at, DOCS_AT_ONCE)
                rows = []
                for text, firsts, lasts, copy in zip(*(some.column(c) for c in (1, 2, 3, 4))):
                    words = text.as_py().split()
                    kept = words
                    if copy.as_py() and len(words) >= window:
                        kept = []
                    elif firsts.as_py():
                        ends = np.zeros(len(words) + 1, np.int64)
                        np.add.at(ends, firsts.values.to_numpy(), 1)
                        np.add.at(ends, lasts.values.to_numpy() + window, -1)
                        kept = [w for w, covered in zip(words, np.cumsum(ends).tolist()) if not covered]
                    body = b" ".join(kept)
                    rows.append((len(words), len(words) - len(kept), hashlib.sha256(body).hexdigest(), body))
                columns = list(zip(*rows)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                                  pa.array(columns[2], pa.string()), pa.array(columns[3], pa.binary()).cast(pa.string())],
                                                 ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    return run


def part(digest: str):
    return F.xxhash64(digest).bitwiseAND((1 << 31) - 1).cast("int").alias("part")


def repeated_windows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW,
                     shingle: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """(copies, marks). copies: digest, least - texts of several ids and the smallest of them. marks: RUNS - of the other
    texts, the windows that also start in a document with a smaller id; `part` is 32 bits of the digest and tells rows with the same id apart."""
    rows = docs.filter(F.col(id_column).isNotNull()).select(
        F.col(id_column).cast("long").alias("id"), F.unhex(F.md5(text_bytes(text_column))).alias("digest"), text_bytes(text_column).alias("text"))
    every = stage(rows.mapInArrow(_anchor_rows(window, shingle), KEY + ", anchors array<long>"), "anchors")
    classes = every.groupBy("digest").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.first("anchors").alias("anchors"))
    classes = stage(classes, "classes")
    copies = classes.filter("id < last").select("digest", F.col("id").alias("least"))

    total = classes.agg(F.sum(F.size("anchors"))).first()[0] or 0
    width = 1 << max(16, (total * CELLS_PER_ANCHOR).bit_length())
    cell = lambda depth: F.pmod(F.xxhash64(F.lit(depth), "anchor"), F.lit(width)) * DEPTH + depth
    exploded = classes.select("id", "digest", F.explode("anchors").alias("anchor"))
    sketch = stage(exploded.select(F.explode(F.array(*[cell(d) for d in range(DEPTH)])).alias("cell")).groupBy("cell").count()
                   .filter("count > 1").select("cell"), "sketch")
    for depth in range(DEPTH):
        exploded = exploded.withColumn("cell", cell(depth)).join(sketch, "cell", "left_semi").drop("cell")
    wanted = stage(exploded.groupBy("id", "digest").agg(F.collect_set("anchor").alias("anchors")), "wanted")

    names = broadcast_if_small(wanted.select("id", "digest"), name="names")
    texts = rows.join(names, ["id", "digest"], "left_semi").join(wanted, ["id", "digest"]).select("id", part("digest"), "text", "anchors")
    found = stage(texts.mapInArrow(_window_rows(window, shingle), "id long, part int, h1 long, h2 long, pos int"), "windows")
    least = stage(found.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.max("id").alias("most"), F.count("*").alias("n"))
                  .filter("least < most").select("h1", "h2", "least", "n"), "least")
    met = joined_to_frequent(found, least, ["h1", "h2"], "n").filter("id > least")
    marked = met.groupBy("id", "part").agg(F.collect_set("pos").alias("starts"))
    return copies, stage(marked.mapInArrow(_run_rows, RUNS), "marks")


def deduplicated(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = WINDOW,
                 shingle: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256 and the kept words joined by blanks (kept).

    Rows with a null id have no place in the order: they lose nothing, and no other row loses words to them. Rows with
    the same id do not lose words to each other. A null text has no words; an empty table gives no rows.
    """
    copies, marks = repeated_windows(docs, id_column, text_column, window, shingle)
    rows = docs.select(F.col(id_column).cast("long").alias("id"), F.unhex(F.md5(text_bytes(text_column))).alias("digest"), text_bytes(text_column).alias("text"))
    few = (marks.agg(F.sum(F.size("firsts") + 4)).first()[0] or 0) < MARKS_TO_BROADCAST
    rows = rows.join(broadcast_if_small(copies, name="copies"), "digest", "left").withColumn("part", part("digest")).join(
        F.broadcast(marks) if few else marks, ["id", "part"], "left")
    return rows.select("id", "text", "firsts", "lasts", F.coalesce(F.col("id") > F.col("least"), F.lit(False)).alias("copy")).mapInArrow(
        _kept_rows(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")
