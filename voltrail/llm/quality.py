"""Quality by random indexing and a small network.

A text is a stream of terms: per word its shape (case, digits and punctuation, runs cut at two), the word itself if it is one of
a bounded list, and a mark where a word repeats the one before. Every term has a fixed sparse vector of a few +1 and -1, drawn
from its hash; the vector of a term is the sum of the fixed vectors of the terms around it over a bounded sample of
labelled texts (whole numbers, so the order of adding does not matter). A document pools the unit vectors of its
terms into a mean. A two-layer network in numpy is fitted to these means, and its logits are divided
by a temperature fitted on rows that were kept apart, so that the score is a probability.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voltrail.llm.common import labelled_sample
from voltrail.session import stage

PER_CLASS = 4000
TERMS = 20_000
WORD_DOCS = 20
SIZE, ONES = 96, 8
REACH = 2
HIDDEN, EPOCHS, RATE, DECAY = 48, 60, 3e-3, 1e-4
CACHE_WORDS = 500_000
SAME = "\x00same"


def shape(word: str) -> str:
    """Case, digits and punctuation of a word: `Tion,` is Xx, and `ERTI!!` is XX!!."""
    drawn = "".join("X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c for c in word[:200])
    return "\x01" + re.sub(r"(.)\1+", r"\1\1", re.sub("xx+", "x", re.sub("99+", "9", drawn)))[:24]


def core(word: str) -> str:
    return word.strip(".,;:!?\"'()[]").lower()


def index_vector(term: str) -> np.ndarray:
    """The fixed vector of a term: ONES places of +1 and -1."""
    import xxhash

    rng = np.random.default_rng(xxhash.xxh64_intdigest(term.encode("utf-8", "surrogatepass")))
    vector = np.zeros(SIZE, np.int64)
    vector[rng.choice(SIZE, ONES, replace=False)] = rng.choice((-1, 1), ONES)
    return vector


class Terms:
    """Term numbers of texts; -1 for a shape or word that is not listed."""

    def __init__(self, terms: list[str]):
        self.number = {t: i for i, t in enumerate(terms)}
        self.words: dict[str, int] = {}
        self.shapes: list[int] = []
        self.cores: list[int] = []

    def __getstate__(self):
        return list(self.number)

    def __setstate__(self, terms):
        self.__init__(terms)

    def _word(self, word: str) -> int:
        place = self.words[word] = len(self.shapes)
        self.shapes.append(self.number.get(shape(word), -1))
        self.cores.append(self.number.get(core(word), -1))
        return place

    def __call__(self, text: str) -> np.ndarray:
        """Shape (words, 3): shape, word, repeat mark."""
        if len(self.words) > CACHE_WORDS:
            self.words, self.shapes, self.cores = {}, [], []
        words = text.split()
        known = self.words
        places = np.array([known[w] if w in known else self._word(w) for w in words], np.int64)
        same = np.array([False, *map(operator.eq, words, words[1:])][:len(words)], bool)
        return np.column_stack((self._take(self.shapes, places), self._take(self.cores, places),
                                np.where(same, self.number.get(SAME, -1), -1))) if words else np.zeros((0, 3), np.int64)

    @staticmethod
    def _take(values: list[int], places: np.ndarray) -> np.ndarray:
        used, back = np.unique(places, return_inverse=True)
        return np.array([values[p] for p in used], np.int64)[back]


def pooled(terms: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of the listed terms; zeros without any."""
    flat = terms[terms >= 0]
    if not len(flat):
        return np.zeros(vectors.shape[1])
    used, counts = np.unique(flat, return_counts=True)
    return counts @ vectors[used] / counts.sum()


class Network:
    """Two layers, tanh and a logit; temperature-calibrated."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        self.w1, self.b1 = rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN)
        self.w2, self.b2 = rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), 0.0
        self.temperature = 1.0
        apart = rng.random(len(x)) < 0.2
        self._fit(x[~apart], y[~apart], weight[~apart], rng)
        if apart.any():
            logit = self._logit(x[apart])
            loss = [np.average(np.logaddexp(0, np.where(y[apart] == 1, -logit, logit) / t), weights=weight[apart]) for t in TEMPERATURES]
            self.temperature = TEMPERATURES[int(np.argmin(loss))]

    def _logit(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self._logit(x) / self.temperature, -30, 30)))

    def _fit(self, x, y, weight, rng) -> None:
        x = (x - self.mean) / self.scale
        values = [self.w1, self.b1, self.w2, np.array(self.b2)]
        first, second, step = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values], 0
        for _ in range(EPOCHS):
            for rows in np.array_split(rng.permutation(len(x)), max(1, len(x) // 128)):
                if not len(rows):
                    continue
                w1, b1, w2, b2 = values
                hidden = np.tanh(x[rows] @ w1 + b1)
                p = 1 / (1 + np.exp(-np.clip(hidden @ w2 + b2, -30, 30)))
                error = (p - y[rows]) * weight[rows] / len(rows)
                back = np.outer(error, w2) * (1 - hidden ** 2)
                grads = [x[rows].T @ back + DECAY * w1, back.sum(axis=0), hidden.T @ error + DECAY * w2, error.sum()]
                step += 1
                for i, g in enumerate(grads):
                    first[i] = 0.9 * first[i] + 0.1 * g
                    second[i] = 0.999 * second[i] + 0.001 * g * g
                    values[i] = values[i] - RATE * (first[i] / (1 - 0.9 ** step)) / (np.sqrt(second[i] / (1 - 0.999 ** step)) + 1e-8)
        self.w1, self.b1, self.w2, self.b2 = values[0], values[1], values[2], float(values[3])


TEMPERATURES = np.exp(np.linspace(np.log(0.25), np.log(8), 60))


class Model:
    def __init__(self, terms: list[str], vectors: np.ndarray, network: Network | None, share: float):
        self.terms, self.vectors, self.network, self.share = Terms(terms), vectors, network, share

    def score(self, texts) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.share)
        return self.network(np.array([pooled(self.terms(t), self.vectors) for t in texts]).reshape(len(texts), -1))


def fit(docs: DataFrame, labels: DataFrame, label: str, learn: Column, id_column: str = "doc_id", text_column: str = "text",
        per_class: int = PER_CLASS) -> Model:
    """A model from at most `per_class` labelled rows of each class; without both classes every text gets the labels' share of ones."""
    sample = labelled_sample(docs, labels, label, learn, per_class, id_column, text_column)
    shares = labels.filter(F.col(label).isin(0, 1)).agg(F.count("*").alias("n"), F.sum(label).alias("ones")).first()
    share = ((shares.ones or 0) + 1) / (shares.n + 2)

    def names(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for text in part.text:
                words = set(text.split())
                yield pd.DataFrame({"term": sorted({shape(w) for w in words} | {core(w) for w in words} - {""}), "one": 1})

    docs_with = sample.mapInPandas(names, "term string, one int").groupBy("term").agg(F.sum("one").alias("n"))
    often = docs_with.filter((F.col("n") >= WORD_DOCS) | F.col("term").startswith("\x01") & (F.col("n") >= 2))
    terms = [SAME, *(r.term for r in often.orderBy(F.desc("n"), "term").limit(TERMS - 1).collect())]
    fixed = np.stack([index_vector(t) for t in terms] + [np.zeros(SIZE, np.int64)])
    shared = sample.sparkSession.sparkContext.broadcast((terms, fixed))

    def around(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, fixed = shared.value
        numbers, total = Terms(names), np.zeros((len(names) + 1, SIZE), np.int64)
        for part in parts:
            for text in part.text:
                rows = numbers(text)
                here = fixed[rows].sum(axis=1)
                near = np.zeros_like(here)
                for reach in range(1, REACH + 1):
                    near[reach:] += here[:-reach]
                    near[:-reach] += here[reach:]
                for column in rows.T:
                    np.add.at(total, column, near)
        used = np.flatnonzero(total[:-1].any(axis=1))
        if len(used):
            yield pd.DataFrame({"term": used, "v": list(total[used])})

    sums = sample.mapInPandas(around, "term long, v array<long>").groupBy("term").agg(
        F.array(*[F.sum(F.col("v")[i]) for i in range(SIZE)]).alias("v"))
    vectors = np.zeros((len(terms), SIZE))
    for row in sums.collect():
        vectors[row.term] = row.v
    vectors += fixed[:-1]
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    meant = sample.sparkSession.sparkContext.broadcast(vectors)

    def pool(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers = Terms(shared.value[0])
        for part in parts:
            yield pd.DataFrame({"id": part.id, "y": part.y, "x": [pooled(numbers(t), meant.value) for t in part.text]})

    rows = sorted(stage(sample.mapInPandas(pool, "id long, y int, x array<double>"), "pooled").collect(), key=lambda r: r.id)
    y = np.array([r.y for r in rows], float)
    if len(set(y)) < 2:
        return Model(terms, vectors, None, share)
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(terms, vectors, Network(np.array([r.x for r in rows]), y, weight), share)


def scored(docs: DataFrame, model: Model, text_column: str = "text", to: str = "quality_score") -> DataFrame:
    """The rows with the probability of label 1. Null and blank texts pool to zeros and get the network's answer for those.

    Ids are not read, equal texts get equal scores, an empty table stays empty. `to` must not be a column of the input.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(shared.value.score(part.tolist()))

    return docs.withColumn(to, of(F.coalesce(F.col(text_column), F.lit(""))))
