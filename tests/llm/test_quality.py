"""Context sums and pooling of the quality operator against plain loops, and odd tables."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltrail.llm import quality

SCHEMA = "doc_id long, text string, quality_score string"


def corpus(n=80):
    rng = np.random.default_rng(6)
    words = ["Alpha", "beta,", "GAMMA!!", "delta", "x9", "epsilon."]
    rows = []
    for i in range(n):
        text = list(rng.choice(words, rng.integers(4, 20)))
        rows.append((i, " ".join(text + text[-1:] * int(i % 2) * 5)))
    return rows


def test_context_sums_and_pooling_match_plain_loops(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "s") for r in rows], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    model = quality.fit(docs, labels, "quality", F.lit(True))
    number = model.terms.number
    held = Counter(t for _, text in rows for t in {quality.shape(w) for w in text.split()} | {quality.core(w) for w in text.split()} - {""})
    listed = {t for t, n in held.items() if n >= quality.WORD_DOCS or t.startswith("\x01") and n >= 2}
    assert set(number) == listed | {quality.SAME} and len(listed) > 8
    zero = np.zeros(quality.SIZE, int)
    fixed = {t: quality.index_vector(t) for t in number}
    sums = {t: v.copy() for t, v in fixed.items()}

    def terms(text):
        words = text.split()
        return [(quality.shape(w), quality.core(w), quality.SAME if i and words[i - 1] == w else None) for i, w in enumerate(words)]

    for _, text in rows:
        each = terms(text)
        here = [sum((fixed.get(t, zero) for t in ts), zero) for ts in each]
        for i, ts in enumerate(each):
            near = sum((here[j] for j in range(max(0, i - quality.REACH), min(len(here), i + quality.REACH + 1)) if j != i), zero)
            for t in ts:
                if t in sums:
                    sums[t] = sums[t] + near
    for t, v in sums.items():
        assert model.vectors[number[t]] == pytest.approx(v / np.linalg.norm(v))
    for _, text in rows[:10]:
        flat = [number[t] for ts in terms(text) for t in ts if t in number]
        assert quality.pooled(model.terms(text), model.vectors) == pytest.approx(model.vectors[flat].mean(axis=0))
    right = [(r.quality_score > 0.5) == (r.doc_id % 2) for r in quality.scored(docs.drop("quality_score"), model).collect()]
    assert np.mean(right) > 0.9


def test_empty_tables(spark):
    docs = spark.createDataFrame([(*r, "s") for r in corpus(12)], SCHEMA).drop("quality_score")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    blank = quality.fit(docs, labels.limit(0), "quality", F.lit(True))
    assert {r.quality_score for r in quality.scored(docs, blank).collect()} == {0.5}
    assert quality.scored(docs.limit(0), blank).count() == 0
    none = quality.fit(docs.limit(0), labels, "quality", F.lit(True))
    assert {r.quality_score for r in quality.scored(docs, none).collect()} == {0.5}
