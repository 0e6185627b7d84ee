"""Scores of texts by prediction by partial matching, beside a smoothed word base.

The model is a trie of byte contexts up to ORDER bytes, with an end mark after each text and start marks before it. The
probability of a byte comes from the longest context that has seen it; every longer context
that has not pays an escape (method D: half a count per distinct symbol is set aside for it), and what
longer contexts predict is excluded below. Under the last order all symbols not yet excluded are equally likely, so
the probabilities of all continuations of a context add up to one.

As the model does not change while it scores, the probability of a byte depends on its ORDER bytes of context
alone. Texts lie in blocks of bounded size. A block lists its distinct grams (context and byte) and words
with their training counts; these lists, not the texts, meet the counts of the whole corpus, in joins and windows. Contexts are
evaluated in groups that share their last two bytes; only counts of one-byte contexts are shared with all
tasks (at most 258 * 257). Each block gets back the values of its own grams and words and scores its texts. Nothing else of
the model, which grows with the corpus, goes through the driver or is broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.llm.common import text_bytes
from voltrail.session import stage

ORDER = 5
END, START, SYMBOLS = 256, 257, 257
BITS = 9
#: Of the count of each symbol in a context, what goes to the escape.
ESCAPE = 0.5
BLOCK_BYTES = 24 << 20
BYTES_AT_ONCE = 1 << 20
LISTS_TO_MERGE = 6
CACHE_WORDS = 100_000
GRAMS_PER_GROUP = 400_000
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint16)
WORD_KEY_SEED = 0


def grams(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """The grams of all texts one after another, and the number of each text's (its bytes and the end)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    lengths = np.diff(offsets)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0]:offsets[-1]] if lengths.sum() else np.zeros(0, np.uint8)
    symbols = np.full(int(lengths.sum()) + len(texts) * (order + 1), START, np.uint64)
    number = np.arange(len(texts))
    symbols[np.arange(len(data)) + np.repeat(number * (order + 1) + order, lengths)] = LOWER[data]
    symbols[np.cumsum(lengths + order + 1) - 1] = END
    found = np.zeros(max(0, len(symbols) - order), np.uint64)
    for j in range(order + 1):
        found = (found << np.uint64(BITS)) | symbols[j:len(symbols) - order + j]
    return found[symbols[order:] != START], lengths + 1


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Neighbouring texts of about BYTES_AT_ONCE together."""
    begin = size = 0
    for i, n in enumerate(pa.compute.binary_length(texts).to_pylist()):
        size += n
        if size >= BYTES_AT_ONCE:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def word_key(word: bytes) -> int:
    """64 bits of hash stand for a word; signed."""
    import xxhash

    value = xxhash.xxh3_64_intdigest(word, WORD_KEY_SEED)
    return value - (1 << 64) if value >> 63 else value


class Tally:
    """Training counts of the grams and words of one block; those of texts that are only scored count zero."""

    def __init__(self):
        self.grams: list[tuple[np.ndarray, np.ndarray]] = []
        self.words: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, texts: pa.Array, learn: np.ndarray) -> None:
        for begin, end in slices(texts):
            part, here = texts.slice(begin, end - begin), learn[begin:end]
            found, lengths = grams(part)
            weight = np.repeat(here, lengths)
            for mine in (True, False):
                keys, counts = np.unique(found[weight == mine], return_counts=True)
                self._merge(self.grams, keys, counts if mine else np.zeros_like(counts))
            words: Counter = Counter()
            for text, mine in zip(part, here):
                split = text.as_py().lower().split()
                words.update(split if mine else dict.fromkeys(split, 0))
            self._merge(self.words, np.fromiter(map(word_key, words), np.int64, len(words)), np.fromiter(words.values(), np.int64, len(words)))
            self.size += int(lengths.sum())

    @staticmethod
    def _merge(lists: list[tuple[np.ndarray, np.ndarray]], keys: np.ndarray, counts: np.ndarray) -> None:
        lists.append((keys, counts))
        if len(lists) > LISTS_TO_MERGE:
            lists[:] = [_sums(np.concatenate([k for k, _ in lists]), np.concatenate([c for _, c in lists]))]

    def rows(self, block: int) -> pa.RecordBatch:
        (keys, counts), (words, uses) = (_sums(*map(np.concatenate, zip(*lists))) for lists in (self.grams, self.words))
        return pa.RecordBatch.from_pydict({
            "block": np.full(len(keys) + len(words), block, np.int64), "kind": np.repeat([0, 1], [len(keys), len(words)]).astype(np.int8),
            "key": np.concatenate((keys.view(np.int64), words)),
            "n": np.concatenate((counts, uses)).astype(np.int64)})


def _tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tallies: dict[int, Tally] = {}
    for batch in batches:
        blocks = batch.column(0).to_numpy()
        learn = batch.column(1).to_numpy(zero_copy_only=False)
        cuts = np.r_[0, np.flatnonzero(np.diff(blocks)) + 1, len(blocks)]
        for begin, end in zip(cuts[:-1], cuts[1:]):
            if begin == end:
                continue
            block = int(blocks[begin])
            tally = tallies.setdefault(block, Tally())
            tally.add(batch.column(2).slice(begin, end - begin), learn[begin:end])
            for other in [b for b, t in tallies.items() if b != block or t.size > 2 * BLOCK_BYTES]:
                yield tallies.pop(other).rows(other)
    for block, tally in tallies.items():
        yield tally.rows(block)


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys with their summed counts."""
    used, back = np.unique(keys, return_inverse=True)
    return used, np.bincount(back, counts, len(used))


def _at(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values of sorted keys; zero where a key is missing."""
    if not len(keys):
        return np.zeros(len(wanted))
    place = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[place] == wanted, values[place], 0.0)


def log10_probabilities(keys: np.ndarray, counts: np.ndarray, pair_keys: np.ndarray, pair_counts: np.ndarray,
                        order: int = ORDER) -> np.ndarray:
    """log10 of the probability of each gram's last symbol after its context.

    keys, counts: distinct grams with training counts (zero for grams that are only scored); all grams of the corpus with the
    same two last bytes of context must be among them. pair_*: counts of (last byte, symbol) in the corpus.
    """
    symbol_mask = np.uint64((1 << BITS) - 1)
    tables = {}
    for k in range(order, -1, -1):  # context length k: grams of k + 1 symbols
        if k >= 2:
            mask = np.uint64((1 << BITS * (k + 1)) - 1)
            seen = counts > 0
            tables[k] = _sums(keys[seen] & mask, counts[seen])
        elif k == 1:
            tables[k] = _sums(pair_keys, pair_counts)
        else:
            tables[k] = _sums(pair_keys & symbol_mask, pair_counts)
    contexts = {}
    for k, (have, n) in tables.items():
        context = have >> np.uint64(BITS)
        total = _sums(context, n)
        distinct = _sums(context, np.ones(len(n)))
        below = np.zeros(len(have))
        if k:  # what the next shorter context counts of the symbols seen here
            shorter = have & np.uint64((1 << BITS * k) - 1)
            below = _at(*tables[k - 1], shorter)
        contexts[k] = (total[0], total[1], distinct[1], _sums(context, below)[1])

    result, open_ = np.zeros(len(keys)), np.ones(len(keys), bool)
    excluded_n, excluded_q = np.zeros(len(keys)), np.zeros(len(keys))
    for k in range(order, -1, -1):
        gram = keys & np.uint64((1 << BITS * (k + 1)) - 1)
        context = gram >> np.uint64(BITS)
        names, total, distinct, below = contexts[k]
        n, q = _at(names, total, context) - excluded_n, _at(names, distinct, context) - excluded_q
        here = _at(*tables[k], gram)
        used = open_ & (q > 0)
        hit = used & (here > 0)
        result[hit] += np.log10((here[hit] - ESCAPE) / n[hit])
        missed = used & ~hit
        result[missed] += np.log10(ESCAPE * q[missed] / n[missed])
        open_ &= ~hit
        excluded_n, excluded_q = _at(names, below, context), _at(names, distinct, context)
    result[open_] -= np.log10(SYMBOLS - excluded_q[open_])
    return result


class Lookup:
    """Values of 64-bit keys in an open-addressed table of numpy arrays; zero for other keys. Keys may be repeated with their value."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(len(keys) * 2).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, np.iinfo(np.uint64).max, np.uint64), np.zeros(1 << bits, values.dtype)
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == np.iinfo(np.uint64).max
            self.keys[slot[free]] = keys[free]
            placed = self.keys[slot] == keys
            self.values[slot[placed]] = values[placed]
            keys, values, slot = keys[~placed], values[~placed], (slot[~placed] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        slot = self._slot(wanted)
        out, found = self.values[slot], self.keys[slot]
        far = np.flatnonzero((found != wanted) & (found != np.iinfo(np.uint64).max))
        while len(far):
            slot[far] = (slot[far] + 1) & self.mask
            out[far], found = self.values[slot[far]], self.keys[slot[far]]
            far = far[(found != wanted[far]) & (found != np.iinfo(np.uint64).max)]
        out[self.keys[slot] != wanted] = 0.0
        return out


class _Words(dict):
    """log10(count + 1) of words, by their keys."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        super().__init__()
        order = np.argsort(keys)
        self.keys_, self.logs = keys[order], np.log10(counts[order].astype(float) + 1)

    def __missing__(self, word: bytes) -> float:
        if len(self) > CACHE_WORDS:
            self.clear()
        key = word_key(word)
        place = int(np.searchsorted(self.keys_, key))
        value = self[word] = float(self.logs[place]) if place < len(self.keys_) and self.keys_[place] == key else 0.0
        return value


def score(docs: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text", block: Column | None = None) -> DataFrame:
    """One row per document: doc_id, learn, n_bytes, n_tokens, n_known, train_tokens, base_score, score.

    learn: which rows the counts are taken from (null: none). block: a number for rows that are read together; any rows may share
    one, results do not depend on it, but a block has to fit into a task. By default rows are dealt by hash into blocks
    of about BLOCK_BYTES. Upper-case A-Z count as lower-case. A null text is empty: its score is that of the end mark.
    Values travel to the blocks as 32-bit floats. Without anything to learn from all symbols are equally likely, and the base score is 0.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(learn, F.lit(False)).alias("learn"), text_bytes(text_column).alias("text"),
                       *([block.cast("long").alias("block")] if block is not None else []))
    if block is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", F.xxhash64("text")), F.lit(size // BLOCK_BYTES + 1)))
        rows = rows.repartition("block").sortWithinPartitions("block")
    listed = stage(rows.select("block", "learn", "text").mapInArrow(_tallied, "block long, kind byte, key long, n long"), "tallies")
    of_grams, of_words = listed.filter("kind = 0"), listed.filter("kind = 1")

    totals = stage(of_grams.groupBy("key").agg(F.sum("n").alias("n")), "grams")
    pairs = totals.filter("n > 0").groupBy(F.col("key").bitwiseAND((1 << 2 * BITS) - 1).alias("key")).agg(F.sum("n").alias("n")).collect()
    pair_keys, pair_counts = np.array([r.key for r in pairs], np.uint64), np.array([r.n for r in pairs], float)
    groups = totals.count() // GRAMS_PER_GROUP + 1
    shared = F.shiftright("key", BITS).bitwiseAND((1 << 2 * BITS) - 1)

    def evaluated(part: pa.Table) -> pa.Table:
        keys = part.column("key").to_numpy().view(np.uint64)
        values = log10_probabilities(keys, part.column("n").to_numpy().astype(float), pair_keys, pair_counts)
        return pa.table({"key": part.column("key"), "value": values.astype(np.float32)})

    model = totals.select("key", "n", F.pmod(F.xxhash64(shared), F.lit(groups)).alias("group")).groupBy("group").applyInArrow(
        evaluated, "key long, value float")
    gram_values = of_grams.select("block", "key").join(model, "key").select("block", F.lit(0).cast("byte").alias("kind"), "key", "value")

    everywhere = Window.partitionBy("key")
    word_totals = stage(of_words.select("block", "key", F.sum("n").over(everywhere).alias("n"),
                                        (F.row_number().over(everywhere.orderBy("block")) == 1).alias("first")), "words")
    sizes = rows.filter("learn").agg(F.count("*").alias("texts")).first()
    seen = word_totals.filter("first").agg(F.sum("n").alias("tokens"), F.count_if(F.col("n") > 0).alias("distinct")).first()
    ends = sizes.texts
    tokens, distinct = (seen.tokens or 0) + ends, seen.distinct + (ends > 0)
    word_values = word_totals.select("block", F.lit(1).cast("byte").alias("kind"), "key", F.col("n").cast("float").alias("value"))
    values = gram_values.unionByName(word_values)
    share = float(np.log10(tokens + distinct + 1))

    def scored(texts: pa.Table, values: pa.Table) -> pa.Table:
        kind, key, value = (values.column(c).to_numpy() for c in ("kind", "key", "value"))
        look = Lookup(key[kind == 0].view(np.uint64), value[kind == 0])
        words = _Words(key[kind == 1], value[kind == 1])
        end_value = float(np.log10(ends + 1))
        texts = texts.combine_chunks()
        body = texts.column("text").combine_chunks() if texts.num_rows else pa.array([], pa.binary())
        body = body.chunk(0) if isinstance(body, pa.ChunkedArray) else body
        columns = {"n_bytes": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for begin, end in slices(body):
            part = body.slice(begin, end - begin)
            found, lengths = grams(part)
            logs = look(found).astype(np.float64)
            columns["score"].append(np.add.reduceat(logs, np.cumsum(lengths) - lengths))
            columns["n_bytes"].append(lengths - 1)
            per_text = [np.array([*map(words.__getitem__, t.as_py().lower().split()), end_value]) for t in part]
            columns["n_tokens"].append(np.array([len(v) for v in per_text]))
            columns["n_known"].append(np.array([np.count_nonzero(v) for v in per_text]))
            columns["base_score"].append(np.array([v.sum() - len(v) * share for v in per_text]))
        flat = {k: np.concatenate(v) if v else np.zeros(0) for k, v in columns.items()}
        return pa.table({"doc_id": texts.column("doc_id"), "learn": texts.column("learn"), **{k: pa.array(flat[k], pa.int64()) for k in ("n_bytes", "n_tokens", "n_known")},
                         "train_tokens": pa.array(np.full(texts.num_rows, tokens), pa.int64()), "base_score": flat["base_score"], "score": flat["score"]})

    return rows.groupBy("block").cogroup(values.groupBy("block")).applyInArrow(
        scored, f"doc_id {docs.schema[id_column].dataType.simpleString()}, learn boolean, n_bytes long, n_tokens long, n_known long, "
                "train_tokens long, base_score double, score double")
