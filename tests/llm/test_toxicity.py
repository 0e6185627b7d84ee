"""Scores of the toxicity operator against plain dictionaries, blocks that stay closed, and odd tables."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from voltrail.llm import toxicity

SCHEMA = "doc_id long, text string, score string, y int"


def corpus():
    rng = np.random.default_rng(3)
    plain = [f"word{i}" for i in range(60)]
    rows = []
    for i in range(220):
        text = list(rng.choice(plain, rng.integers(3, 30)))
        if i % 4 == 0:
            text += list(rng.choice(["awful", "vile"], rng.integers(1, 4)))
        rows.append((i, " ".join(text), int(i % 4 == 0) if i % 3 else None))
    return rows + [(1000, None, 0), (1001, "", 1), (None, "word1 vile", 1), (1002, "every " + "long " * 30000, 0)] + rows[:3]


def test_scores_match_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "s", 5) for d, t, _ in rows], SCHEMA)
    labels = spark.createDataFrame(sorted({(d, y) for d, _, y in rows if y is not None and d is not None}), "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, "toxic", F.lit(True))
    known = {d: (t or "", y) for d, t, y in rows if d is not None and y is not None}
    examples = {}
    for d, (t, y) in sorted(known.items()):
        examples.setdefault((t, y), d)
    examples = sorted((d, t, y) for (t, y), d in examples.items())
    n1 = sum(y for *_, y in examples)
    n0 = len(examples) - n1
    held = Counter(w for _, t, _ in rows for w in set(toxicity.words(t or "")))
    a, b = (Counter(w for _, t, z in examples for w in set(toxicity.words(t)) if z == y) for y in (1, 0))

    def weight(w):
        n = n0 + n1
        both = a[w] + b[w]
        r = (a[w] * (n0 - b[w]) - b[w] * (n1 - a[w])) ** 2 / (both * (n - both) * n0 * n1) if both < n else 0
        return max(0, math.log((len(rows) + 1) / (held[w] + 1))) * (0.01 + r)

    def vector(t):
        raw = {w: (1 + math.log(n)) * weight(w) for w, n in Counter(toxicity.words(t)).items() if a[w] + b[w]}
        length = math.sqrt(sum(x * x for x in raw.values()))
        return {w: x / length for w, x in raw.items()} if length else {}

    vectors = [(d, y, vector(t)) for d, t, y in examples]
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows)
    for r in got:
        q = vector(r.text or "")
        sims = sorted(((-sum(x * v.get(w, 0) for w, x in q.items()), d, y) for d, y, v in vectors))
        best = [s for s in sims if s[0] < 0][:15]
        votes = [(1 / (1.05 - min(1, -s)), y) for s, _, y in best]
        odds = math.log((sum(v for v, y in votes if y) + 1) / (sum(v for v, y in votes if not y) + 1))
        want = 1 / (1 + math.exp(-(model.slope * odds + model.shift))) if best else model.none
        assert r.toxicity.score == pytest.approx(want, abs=1e-6)
        assert r.toxicity.similarities == pytest.approx([-s for s, *_ in best[:3]])
    assert all((r.toxicity.score > 0.5) == ("vile" in r.text or "awful" in r.text) for r in got if r.text and r.text.count(" ") < 100)


def test_blocks_of_other_kinds_stay_closed():
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(3000):  # forty kinds, each with a strong term of its own, in mixed order, and weak common terms
        kind, weak = int(rng.integers(40)), rng.choice(np.arange(40, 400), 20, replace=False)
        raw = {kind: 3.0, **{int(t): float(rng.random()) for t in weak}}
        length = math.sqrt(sum(x * x for x in raw.values()))
        rows.append({t: x / length for t, x in raw.items()})
    index = toxicity.BlockMaxIndex(rows, 400)
    asked = rows[:64]
    entries = [(i, t, w) for i, row in enumerate(asked) for t, w in row.items()]
    owner, term = (np.array([e[j] for e in entries]) for j in (0, 1))
    answers, opened = index.nearest_of(64, owner, term, np.array([e[2] for e in entries]), 15, range(64))
    assert opened < 0.3 * 64 * index.blocks
    dense = np.zeros((3000, 400))
    for e, row in enumerate(rows):
        dense[e, list(row)] = list(row.values())
    for i, (found, sims) in enumerate(answers):
        exact = dense @ dense[i]
        exact[i] = 0
        best = np.lexsort((np.arange(3000), -exact.round(12)))[:15]
        assert found.tolist() == best.tolist() and sims == pytest.approx(exact[best])


def test_empty_tables_and_bounds(spark):
    docs = spark.createDataFrame([(d, t, "s", 5) for d, t, _ in corpus()], SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    model = toxicity.fit(docs.limit(0), labels, "toxic", F.lit(True))
    assert len({r.toxicity.score for r in toxicity.scored(docs, model).collect()}) == 1
    assert toxicity.scored(docs.limit(0), model).count() == 0
    small = toxicity.fit(docs, labels, "toxic", F.lit(True), per_class=5, characters=400)
    assert 2 <= len(small.ids) <= 10
