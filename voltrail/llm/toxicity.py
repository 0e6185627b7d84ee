"""Toxicity by nearest labelled examples under exact TF-IDF cosine.

A bounded sample of labelled texts is the set of examples, their words are the terms. A word weighs the more, the fewer of all
documents hold it and the more its presence in the examples goes with the label (the square of their correlation, and a
little for every word). Example vectors (1 + ln tf) * weight have length 1 and lie in an inverted index whose
examples are cut into blocks, with the largest weight of each term in each block. A
query adds up these maxima for a bound per block, opens the most promising blocks, and then those whose bound
reaches the k-th best found: the result is exact. Neighbours vote with weights that grow
with nearness; votes are turned into probabilities by a logistic curve fitted to the examples' own
votes (each without itself), weighted to the frequency of the classes among all labelled rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.llm.common import labelled_sample
from voltrail.session import stage

PER_CLASS = 4000
#: Characters of the examples of each class.
CHARACTERS = 32 << 20
#: What a word without any association with the label weighs, beside 1 for a word that alone decides it.
LEAST = 0.01
NEIGHBOURS = 15
BLOCK = 64
#: Texts that are looked up together.
LOT = 64
#: Blocks that a query opens before it knows what the others must reach.
OPENED = 4
#: Terms in more than this share of the examples, and at most so many, are dense.
DENSE, DENSE_SHARE = 1024, 1 / 64
#: ASCII other than letters and digits ends a word.
ENDS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))

RESULT = "score double, neighbours array<long>, similarities array<double>"


def words(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "surrogatepass").translate(ENDS).split()


class BlockMaxIndex:
    """Examples as rows of (term, weight); exact k nearest by inner product of unit vectors, for a lot of queries at a time.

    Examples are put in order of their strongest term and cut into blocks, so that a block's examples are of a kind and its maxima
    tell it from others. Terms of many examples stand in a dense matrix, with the maxima of each block in another; the
    postings of the others are added up first, which is little work, and give exact maxima per block.
    """

    def __init__(self, rows: Iterable[dict[int, float]], terms: int):
        packed = [(np.fromiter(row, np.int32, len(row)), np.fromiter(row.values(), np.float64, len(row))) for row in rows]
        owner = np.repeat(np.arange(len(packed), dtype=np.int32), [len(t) for t, _ in packed])
        self._build(owner, np.concatenate([t for t, _ in packed] or [np.zeros(0, np.int32)]), np.concatenate([w for _, w in packed] or [np.zeros(0)]), len(packed), terms)

    @classmethod
    def of_entries(cls, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, terms: int) -> "BlockMaxIndex":
        """The index of so many examples, given by their entries (example, term, weight) in order of the examples."""
        index = cls.__new__(cls)
        index._build(owner, term, weight, size, terms)
        return index

    def _build(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, size: int, terms: int) -> None:
        self.size = size
        self.blocks = max(1, -(-size // BLOCK))
        strongest = np.full(size, -1, np.int64)
        by_weight = np.lexsort((weight, owner))
        strongest[owner[by_weight]] = term[by_weight]  # the last one of an example stays
        del by_weight
        self.example = np.lexsort((np.arange(size), strongest))
        self.place = np.empty(size, np.int64)
        self.place[self.example] = np.arange(size)
        frequency = np.bincount(term, minlength=terms)
        dense = np.argsort(-frequency, kind="stable")[:DENSE]
        dense = dense[frequency[dense] > size * DENSE_SHARE]
        self.column = np.full(terms, -1, np.int32)
        self.column[dense] = np.arange(len(dense))
        rare = self.column[term] < 0
        self.dense = np.zeros((self.blocks * BLOCK, len(dense)))
        self.dense[self.place[owner[~rare]], self.column[term[~rare]]] = weight[~rare]
        self.most = self.dense.reshape(self.blocks, BLOCK, -1).max(axis=1)
        owner, term, weight = owner[rare], term[rare], weight[rare]
        order = np.argsort(term, kind="stable")
        self.posting, self.weight = self.place[owner[order]].astype(np.int32), weight[order]
        self.of_term = np.searchsorted(term[order], np.arange(terms + 1))

    def nearest(self, query: dict[int, float], k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and similarities, best first, ties to the earlier example; only similarities above 0."""
        term, weight = np.fromiter(query, np.int64, len(query)), np.fromiter(query.values(), np.float64, len(query))
        return self.nearest_of(1, np.zeros(len(query), np.int64), term, weight, k, [without])[0][0]

    def nearest_of(self, queries: int, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int,
                   without: Sequence[int] = ()) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
        """The same for so many queries, given by their entries (query, term, weight), and how many blocks they opened."""
        column = self.column[term]
        asked = np.zeros((queries, self.dense.shape[1]))
        asked[owner[column >= 0], column[column >= 0]] = weight[column >= 0]
        rare = np.flatnonzero(column < 0)
        at, of = spread(self.of_term[term[rare]], self.of_term[term[rare] + 1])
        cells = self.blocks * BLOCK
        scores = np.bincount(owner[rare][of] * cells + self.posting[at], weight[rare][of] * self.weight[at], queries * cells).astype(float, copy=False).reshape(-1, self.blocks, BLOCK)
        bounds = asked @ self.most.T + scores.max(axis=2)
        opened = np.zeros(bounds.shape, bool)
        first = np.argsort(-bounds, axis=1, kind="stable")[:, :OPENED]
        np.put_along_axis(opened, first, np.take_along_axis(bounds, first, 1) > 0, 1)
        self._add(opened, asked, scores)
        closed = np.where(opened[:, :, None], scores, 0.0)
        hidden = [(i, e) for i, e in enumerate(without) if e >= 0]
        for i, e in hidden:
            closed[i, self.place[e] // BLOCK, self.place[e] % BLOCK] = 0
        flat = closed.reshape(queries, -1)
        least = np.partition(flat, -k, axis=1)[:, -k] if flat.shape[1] > k else np.zeros(queries)
        more = ~opened & (bounds > 0) & (bounds >= least[:, None] - 1e-12)
        self._add(more, asked, scores)
        opened |= more
        for i, e in hidden:
            scores[i, self.place[e] // BLOCK, self.place[e] % BLOCK] = 0
        out = []
        for query, open_ in zip(scores, opened):
            blocks = np.flatnonzero(open_)
            sims = query[blocks].reshape(-1)
            limit = max(np.partition(sims, -k)[-k] if len(sims) > k else 0.0, 1e-300)
            hit = np.flatnonzero(sims >= limit)
            examples, sims = self.example[blocks[hit // BLOCK] * BLOCK + hit % BLOCK], sims[hit]
            best = np.lexsort((examples, -sims))[:k]
            out.append((examples[best], sims[best]))
        return out, int(opened.sum())

    def _add(self, opened: np.ndarray, asked: np.ndarray, scores: np.ndarray) -> None:
        """Adds the dense terms to the scores of the blocks that each query opens."""
        for block in np.flatnonzero(opened.any(axis=0)):
            who = np.flatnonzero(opened[:, block])
            scores[who, block] += asked[who] @ self.dense[block * BLOCK:(block + 1) * BLOCK].T


def spread(begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The whole numbers of all ranges, one after the other, and the range of each."""
    lengths = end - begin
    owner = np.repeat(np.arange(len(begin)), lengths)
    return np.arange(lengths.sum()) + (begin - (np.cumsum(lengths) - lengths))[owner], owner


class Model:
    """Terms with weights, the index, the examples' ids and labels, and the calibration."""

    def __init__(self, ids: list[int], labels: np.ndarray, counts: list[tuple[bytes, bytes]], names: list[bytes],
                 weights: np.ndarray, share: float):
        """`counts` has term numbers and their counts of each example as packed 32-bit numbers; `names` are sorted."""
        self.ids, self.labels = np.array(ids, np.int64), labels
        self.terms = {t: i for i, t in enumerate(names)}
        self.weights = weights
        lengths = [len(t) // 4 for t, _ in counts]
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), lengths)
        term, n = (np.frombuffer(b"".join(c[side] for c in counts), np.int32) for side in (0, 1))
        owner, term, weight = self._unit(owner, term, n, len(counts))
        self.index = BlockMaxIndex.of_entries(owner, term, weight, len(counts), len(names))
        self.none = (share * 0.5 + 0.25) / 2
        self.slope, self.shift = 1.0, 0.0
        self._calibrate(owner, term, weight, share)

    def _unit(self, owner: np.ndarray, term: np.ndarray, n: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries (row, term, weight) of vectors of length 1; terms without weight are left out."""
        weight = (1 + np.log(n)) * self.weights[term]
        kept = weight > 0
        owner, term, weight = owner[kept], term[kept], weight[kept]
        length = np.sqrt(np.bincount(owner, weight * weight, rows))
        return owner, term, weight / length[owner]

    def _entries(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Entries of the vectors of texts."""
        get, each = self.terms.get, []
        for text in texts:
            found = Counter(words(text))
            each.append(np.array([(t, n) for t, n in ((get(w, -1), n) for w, n in found.items()) if t >= 0], np.int64).reshape(-1, 2))
        both = np.concatenate(each) if each else np.zeros((0, 2), np.int64)
        return self._unit(np.repeat(np.arange(len(texts)), [len(e) for e in each]), both[:, 0], both[:, 1], len(texts))

    def _votes(self, found: np.ndarray, sims: np.ndarray) -> float:
        """Log odds of the weighted votes, one vote of doubt on either side."""
        weights = 1 / (1.05 - np.minimum(sims, 1.0))
        toxic = weights[self.labels[found] == 1].sum()
        return math.log((toxic + 1) / (weights.sum() - toxic + 1))

    def _calibrate(self, owner: np.ndarray, term: np.ndarray, weight: np.ndarray, share: float) -> None:
        """Class weights make the examples as frequent as their class among all labelled rows."""
        ones = max(1, int(self.labels.sum()))
        balance = np.where(self.labels == 1, share / ones, (1 - share) / max(1, len(self.labels) - ones))
        votes, with_votes, bare = [], [], []
        for low in range(0, len(self.labels), LOT):
            here = slice(*np.searchsorted(owner, [low, low + LOT]))
            n = min(LOT, len(self.labels) - low)
            answers, _ = self.index.nearest_of(n, owner[here] - low, term[here], weight[here], NEIGHBOURS, range(low, low + n))
            for e, (found, sims) in enumerate(answers, low):
                (with_votes if len(found) else bare).append(e)
                if len(found):
                    votes.append(self._votes(found, sims))
        if bare:
            spread = balance[bare] * len(self.labels)
            self.none = float((spread[self.labels[bare] == 1].sum() + 0.1) / (spread.sum() + 1))
        if len(set(self.labels[with_votes])) < 2:
            return
        x, y, w = np.array(votes), self.labels[with_votes], balance[with_votes] / balance[with_votes].sum()
        a, b = 1.0, 0.0
        for _ in range(60):  # Newton, with a slight pull to slope 1
            p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
            g = np.array([(w * (p - y) * x).sum() + 1e-3 * (a - 1), (w * (p - y)).sum() + 1e-3 * b])
            v = w * p * (1 - p)
            h = np.array([[(v * x * x).sum() + 1e-3, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-3]])
            step = np.linalg.solve(h, g)
            a, b = a - step[0], b - step[1]
        self.slope, self.shift = max(float(a), 0.0), float(b)

    def score_all(self, texts: list[str]) -> list[tuple[float, list[int], list[float]]]:
        out = []
        for low in range(0, len(texts), LOT):
            some = texts[low:low + LOT]
            answers, _ = self.index.nearest_of(len(some), *self._entries(some), NEIGHBOURS)
            for found, sims in answers:
                odds = self.slope * self._votes(found, sims) + self.shift if len(found) else 0.0
                score = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))) if len(found) else self.none
                out.append((score, self.ids[found[:3]].tolist(), sims[:3].tolist()))
        return out

    def score(self, text: str) -> tuple[float, list[int], list[float]]:
        return self.score_all([text])[0]


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, id_column: str = "doc_id", text_column: str = "text",
        per_class: int = PER_CLASS, characters: int = CHARACTERS) -> Model:
    """A model from at most `per_class` labelled rows of each class, as long as they have no more than `characters`, and all their words.

    Both bounds hold for every class, so the examples, which come to the driver and go to each worker, are bounded in bytes. Document
    frequencies of their words count all rows of `docs`. Null texts are empty; equal texts of a class are one example; rows without an id are
    no examples. Without labelled rows every text gets the same score.
    """
    sample = labelled_sample(docs, labels, label, learn, per_class, id_column, text_column)
    sample = sample.groupBy("text", "y").agg(F.min("id").alias("id"))  # copies are one example
    upto = Window.partitionBy("y").orderBy(F.xxhash64("id"), "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # bounded by `per_class`
    sample = stage(sample.withColumn("size_", F.sum(F.length("text")).over(upto)).filter(F.col("size_") <= characters).drop("size_"), "examples")
    shares = labels.filter(F.col(label).isin(0, 1)).agg(F.count("*").alias("n"), F.sum(label).alias("toxic")).first()
    share = ((shares.toxic or 0) + 1) / (shares.n + 4)

    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many examples of each class hold a word."""
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for part in parts:
            for y, text in zip(part["y"].to_pylist(), part["text"].to_pylist()):
                seen[y].update(set(words(text)))
        for y, found in seen.items():
            yield from _batches({"term": list(found), "y": [y] * len(found), "n": list(found.values())}, COUNTED)

    counts = sample.select("y", "text").mapInArrow(count, "term binary, y int, n long")
    listed = counts.groupBy("term").agg(F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("a"),
                                        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("b")).toArrow().sort_by("term")
    names = listed["term"].to_pylist()
    a, b = (listed[c].to_numpy().astype(float) for c in ("a", "b"))
    totals = {r.y: r.n for r in sample.groupBy("y").agg(F.count("*").alias("n")).collect()}
    n0, n1 = totals.get(0, 0), totals.get(1, 0)
    shared = sample.sparkSession.sparkContext.broadcast(names)

    def frequency(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """How many documents of the partition hold a word of the examples."""
        known, seen = frozenset(shared.value), Counter()
        for part in parts:
            for text in part["text"].to_pylist():
                seen.update(known.intersection(words(text)))
        yield from _batches({"term": list(seen), "n": list(seen.values())}, FREQUENCY)

    texts = docs.select(F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    held = texts.mapInArrow(frequency, "term binary, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow().combine_chunks()
    documents = np.zeros(len(names))
    documents[pc.index_in(held["term"].combine_chunks(), value_set=listed["term"].combine_chunks()).to_numpy(zero_copy_only=False)] = held["n"].to_numpy()
    idf = np.log((docs.count() + 1) / (documents + 1))
    with np.errstate(divide="ignore", invalid="ignore"):
        association = (a * (n0 - b) - b * (n1 - a)) ** 2 / ((a + b) * (n0 + n1 - a - b) * float(n0) * n1)
    weights = np.maximum(idf, 0) * (LEAST + np.nan_to_num(association, posinf=0))
    del held, listed, a, b, documents, idf, association

    def keep(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = {t: i for i, t in enumerate(shared.value)}
        for part in parts:
            found = [Counter(numbers[w] for w in words(t)) for t in part["text"].to_pylist()]
            yield pa.RecordBatch.from_pydict({"id": part["id"].to_pylist(), "y": part["y"].to_pylist(), "terms": [np.array(list(f), np.int32).tobytes() for f in found],
                                              "ns": [np.array(list(f.values()), np.int32).tobytes() for f in found]}, KEPT)

    kept = sample.mapInArrow(keep, "id long, y int, terms binary, ns binary").toArrow().sort_by("id")
    ids, y, counts = kept["id"].to_pylist(), kept["y"].to_numpy().astype(np.int64), list(zip(kept["terms"].to_pylist(), kept["ns"].to_pylist()))
    del kept
    return Model(ids, y, counts, names, weights, share)


COUNTED = pa.schema([("term", pa.binary()), ("y", pa.int32()), ("n", pa.int64())])
FREQUENCY = pa.schema([("term", pa.binary()), ("n", pa.int64())])
KEPT = pa.schema([("id", pa.int64()), ("y", pa.int32()), ("terms", pa.binary()), ("ns", pa.binary())])


def _batches(columns: dict[str, list], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    return iter(pa.Table.from_pydict(columns, schema).to_batches(max_chunksize=50_000))


def scored(docs: DataFrame, model: Model, text_column: str = "text", to: str = "toxicity") -> DataFrame:
    """The rows with a struct (score, neighbours, similarities): calibrated probability, and the ids of the three nearest examples.

    Null and empty texts, and texts without a word of the examples, get the frequency of the label among such examples. Equal texts get
    equal scores; ids are not read; an empty table stays empty. `to` must not be a column of the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            yield pd.DataFrame(shared.value.score_all(part.tolist()), columns=["score", "neighbours", "similarities"])

    return docs.withColumn(to, of(F.coalesce(F.col(text_column), F.lit(""))))
