"""Language of texts and of the spans of mixed texts.

Every word gets a score per language: the log likelihood of its character n-grams under that language's counts, learnt from a
bounded sample of texts per language. The word's script narrows the candidates to languages that use it. Viterbi
over the words of a text, with a penalty for each switch, labels spans; the language of the text
is the one whose spans hold the most letters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voltrail.llm.common import bounded_sample

PER_LANGUAGE = 1500
BUCKETS = 1 << 14
GRAMS = (1, 2, 3, 4)
SWITCH, FOREIGN = 12.0, 50.0
SCRIPT_SHARE = 0.02
DOCS_AT_ONCE = 1000
UNKNOWN = "und"

#: First code point, last code point, script: fixed values of the Unicode standard (main blocks).
SCRIPTS = (
    (0x0041, 0x024F, "Latin"), (0x0370, 0x03FF, "Greek"), (0x0400, 0x052F, "Cyrillic"), (0x0530, 0x058F, "Armenian"),
    (0x0590, 0x05FF, "Hebrew"), (0x0600, 0x06FF, "Arabic"), (0x0750, 0x077F, "Arabic"), (0x0900, 0x097F, "Devanagari"),
    (0x0980, 0x09FF, "Bengali"), (0x0A00, 0x0A7F, "Gurmukhi"), (0x0A80, 0x0AFF, "Gujarati"), (0x0B80, 0x0BFF, "Tamil"),
    (0x0C00, 0x0C7F, "Telugu"), (0x0C80, 0x0CFF, "Kannada"), (0x0D00, 0x0D7F, "Malayalam"), (0x0E00, 0x0E7F, "Thai"),
    (0x10A0, 0x10FF, "Georgian"), (0x1200, 0x137F, "Ethiopic"), (0x1E00, 0x1EFF, "Latin"), (0x1F00, 0x1FFF, "Greek"),
    (0x3040, 0x30FF, "Kana"), (0x3400, 0x9FFF, "Han"), (0xAC00, 0xD7AF, "Hangul"),
)
NAMES = sorted({name for *_, name in SCRIPTS}) + ["Other"]

RESULT = "lang string, score double, spans array<struct<lang: string, first: int, last: int>>"


LOWS, HIGHS = np.array([low for low, *_ in SCRIPTS]), np.array([high for _, high, _ in SCRIPTS])
NAMED = np.array([NAMES.index(name) for *_, name in SCRIPTS])


def script(codes: np.ndarray) -> np.ndarray:
    """Place of each letter's script in NAMES."""
    block = np.searchsorted(LOWS, codes, "right") - 1
    return np.where((block >= 0) & (codes <= HIGHS[block]), NAMED[block], len(NAMES) - 1)


class Letters:
    """The letters of many words at once: n-gram buckets and scripts, with the number of the word of each."""

    def __init__(self, words: list[str]):
        text = "".join([c for c in "\n".join(["", *words, ""]).lower() if c == "\n" or c.isalpha()])
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        ends = codes == 10
        number = np.cumsum(ends) - 1
        self.words = len(words)
        self.letter_word, self.scripts = number[~ends], script(codes[~ends])
        self.sizes = np.bincount(self.letter_word, minlength=len(words))
        self.gram_word: list[np.ndarray] = []
        self.buckets: list[np.ndarray] = []
        for g, n in enumerate(GRAMS):  # ends of words count as a symbol at either end of a gram, never within
            last = len(codes) - n + 1
            hashed, inside = np.zeros(max(0, last), np.uint64), np.ones(max(0, last), bool)
            for k in range(n):
                hashed = (hashed ^ codes[k:last + k].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                hashed ^= hashed >> np.uint64(29)
                if 0 < k < n - 1:
                    inside &= ~ends[k:last + k]
            inside &= ~(ends[:last] & ends[n - 1:]) if last > 0 else inside
            self.gram_word.append(number[:max(0, last)][inside])
            self.buckets.append((hashed[inside] % np.uint64(BUCKETS)).astype(np.int64) + BUCKETS * g)

    def word_scripts(self) -> np.ndarray:
        """The most frequent script of each word."""
        found = np.bincount(self.letter_word * len(NAMES) + self.scripts, minlength=self.words * len(NAMES))
        return found.reshape(self.words, len(NAMES)).argmax(axis=1)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Counts of n-gram buckets and of scripts in a text."""
    words = Counter(text.split())
    letters, n = Letters(list(words)), np.array(list(words.values()), float)
    if not words:
        return np.zeros(len(GRAMS) * BUCKETS), np.zeros(len(NAMES))
    grams = sum(np.bincount(b, n[w], len(GRAMS) * BUCKETS) for b, w in zip(letters.buckets, letters.gram_word))
    return grams, np.bincount(letters.scripts, n[letters.letter_word], len(NAMES))


class Model:
    """Languages, log likelihoods per n-gram bucket and the scripts of each language."""

    def __init__(self, langs: list[str], counts: np.ndarray, scripts: np.ndarray):
        self.langs = langs
        table = counts.reshape(len(langs), len(GRAMS), BUCKETS)
        table = np.log((table + 0.5) / (table.sum(axis=2, keepdims=True) + 0.5 * BUCKETS)) / len(GRAMS)
        self.logs = table.reshape(len(langs), len(GRAMS) * BUCKETS).T.copy()
        share = scripts / np.maximum(scripts.sum(axis=1, keepdims=True), 1)
        self.uses = share >= SCRIPT_SHARE

    def scores(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words by language, and their numbers of letters."""
        letters = Letters(words)
        rows = np.zeros((len(words), len(self.langs)))
        for buckets, word in zip(letters.buckets, letters.gram_word):
            for k in range(len(self.langs)):
                rows[:, k] += np.bincount(word, self.logs[buckets, k], len(words))
        candidates = self.uses[:, letters.word_scripts()].T
        rows -= FOREIGN * (~candidates & candidates.any(axis=1, keepdims=True))
        rows[letters.sizes == 0] = 0
        return rows, letters.sizes

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """Language, share of the letters in its spans, and spans (language, first word, last word) of each text."""
        split = [(t or "").split() for t in texts]
        lengths = np.array([len(w) for w in split], np.int64)
        number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(split)))}
        back = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int32, lengths.sum())
        rows, sizes = self.scores(list(number))
        del split, number
        ends = np.cumsum(lengths)
        states = viterbi(rows, back, lengths, SWITCH) if self.langs else np.zeros(len(back), np.int64)
        out = []
        for low, high in zip(ends - lengths, ends):
            size = sizes[back[low:high]]
            total = int(size.sum())
            if not total or not self.langs:
                out.append((UNKNOWN, 0.0, []))
                continue
            here = states[low:high]
            shares = np.bincount(here, size, len(self.langs))
            best = int(shares.argmax())
            cuts = np.flatnonzero(np.diff(here)) + 1
            spans = [(self.langs[here[a]], int(a), int(b) - 1) for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(here)])]
            out.append((self.langs[best], float(shares[best] / total), spans))
        return out


def viterbi(rows: np.ndarray, words: np.ndarray, lengths: np.ndarray, switch: float) -> np.ndarray:
    """Best state of every word of all texts; texts walk side by side, longest first.

    rows: scores per distinct word and state; words: row of each word, texts one after another.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    active = np.searchsorted(-lengths[order], -np.arange(lengths.max(initial=0)), side="left")
    n_states = rows.shape[1]
    value = np.zeros((len(lengths), n_states))
    switched = np.zeros((len(words), n_states), bool)
    origin = np.zeros(len(words), np.int16)
    for t, n in enumerate(active):
        at = starts[:n] + t
        here = value[:n]
        if t:
            origin[at] = here.argmax(axis=1)
            jump = here.max(axis=1, keepdims=True) - switch
            switched[at] = jump > here
            here = np.maximum(here, jump)
        value[:n] = here + rows[words[at]]
    state = value.argmax(axis=1)
    out = np.zeros(len(words), np.int64)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = starts[:n] + t
        out[at] = state[:n]
        state[:n] = np.where(switched[at, state[:n]], origin[at], state[:n])
    return out


def fit(docs: DataFrame, learn: Column, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang",
        per_language: int = PER_LANGUAGE) -> Model:
    """A model from at most `per_language` texts of each language (in order of a hash of the id)."""
    usable = docs.filter(learn & F.col(id_column).isNotNull() & F.col(text_column).isNotNull() & F.col(lang_column).isNotNull())
    chosen = F.broadcast(bounded_sample(usable.select(id_column, lang_column).distinct(), lang_column, id_column, per_language))
    sample = usable.select(id_column, text_column, lang_column).join(chosen, [id_column, lang_column], "left_semi").select(
        F.col(lang_column).alias("lang"), F.col(text_column).alias("text"))

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, scripts = {}, {}
        for part in parts:
            for lang, text in zip(part.lang, part.text):
                for totals, found in zip((grams, scripts), counted(text)):
                    totals[lang] = totals.get(lang, 0) + found
        for lang in grams:
            both = np.concatenate((scripts[lang][::-1], grams[lang]))  # scripts under negative keys
            used = np.flatnonzero(both)
            yield pd.DataFrame({"lang": lang, "key": used - len(NAMES), "n": both[used].astype(np.int64)})

    rows = sample.mapInPandas(count, "lang string, key int, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r.lang for r in rows})
    place = {lang: i for i, lang in enumerate(langs)}
    counts, scripts = np.zeros((len(langs), len(GRAMS) * BUCKETS)), np.zeros((len(langs), len(NAMES)))
    for r in rows:
        (counts if r.key >= 0 else scripts)[place[r.lang], r.key if r.key >= 0 else -1 - r.key] = r.n
    return Model(langs, counts, scripts)


def labelled(docs: DataFrame, model: Model, text_column: str = "text", to: str = "language") -> DataFrame:
    """The rows with a struct (lang, score, spans). Null texts and texts without a letter are `und`, score 0, no spans;
    so is every text if the model has no language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(RESULT)
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in texts:
            rows = part.tolist()
            found = [x for at in range(0, len(rows), DOCS_AT_ONCE) for x in shared.value.label(rows[at:at + DOCS_AT_ONCE])]
            yield pd.DataFrame(found, columns=["lang", "score", "spans"])

    return docs.withColumn(to, of(F.col(text_column)))
