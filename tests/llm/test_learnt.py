"""Operators that learn or search: held-out accuracy, recall and defined results for odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voltrail.llm import covering_simhash, hnsw, language_spans, quality, queries, secret_ledger, toxicity
from voltrail.llm.common import held_out

FOLDER = "/root/testdata/sf0.001"
ODD = [(100001, None), (100002, ""), (100003, " \n"), (None, "text"), (100004, "x " * 60000), (100004, "x " * 60000)]


def documents(spark, folder=FOLDER):
    """The table with odd rows and columns that operators use names of."""
    rows = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(d, t, None, None, None) for d, t in ODD], rows.schema)
    return rows.unionByName(odd).withColumns({"score": F.lit("s"), "id": F.lit("i"), "y": F.lit(1), "label": F.lit(2), "rank": F.lit(3)})


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(700):
        terms = rng.choice(40, rng.integers(1, 8), replace=False)
        weights = rng.integers(1, 4, len(terms)).astype(float)
        rows.append(dict(zip(terms.tolist(), (weights / np.linalg.norm(weights)).tolist())))
    rows += rows[:50]
    index = toxicity.BlockMaxIndex(rows, 40)
    dense = np.zeros((len(rows), 40))
    for e, row in enumerate(rows):
        dense[e, list(row)] = list(row.values())
    for e in range(0, 700, 7):
        found, sims = index.nearest(rows[e], 15, e)
        exact = dense @ dense[e]
        exact[e] = 0
        best = np.lexsort((np.arange(len(rows)), -np.round(exact, 9)))[:15]
        assert np.allclose(sims, exact[best]) and np.allclose(np.sort(exact[found]), np.sort(exact[best]))


def test_toxicity_on_rows_kept_apart(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    model = toxicity.fit(docs, labels, "toxic", ~held_out("doc_id", 5, 0))
    insults = [t for t in model.terms if b"idiot" in t]
    assert insults
    rows = toxicity.scored(docs, model).join(labels, "doc_id").filter(held_out("doc_id", 5, 0)).collect()
    right = np.mean([(r.toxicity.score >= 0.5) == r.toxic for r in rows])
    assert right > 0.93
    odd = toxicity.scored(documents(spark), model)
    assert odd.columns[:-1] == documents(spark).columns
    assert {round(r.toxicity.score, 9) for r in odd.filter("doc_id >= 100001 or doc_id is null").collect()} == {round(model.none, 9)}
    empty = toxicity.fit(docs, labels.limit(0), "toxic", ~held_out("doc_id", 5, 0))
    assert 0 <= empty.score("idiot")[0] < 0.5


def test_a_text_with_any_shared_word_has_neighbours(spark):
    """Every word is in one example only: none of them tells the classes apart."""
    rows = [(i, f"rare{i} the", i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int"), "toxic", F.lit(True))
    asked = spark.createDataFrame([(100 + i, f"Rare{i}! unseen") for i in range(60)] + [(300, "the unseen")], "doc_id long, text string")
    got = {r.doc_id: r.toxicity for r in toxicity.scored(asked, model).collect()}
    assert all(got[100 + i].neighbours == [i] and got[100 + i].similarities[0] == pytest.approx(1) for i in range(60))
    assert got[300].neighbours == [] and got[300].score == pytest.approx(model.none)


def test_quality_on_rows_kept_apart(spark):
    folder = FOLDER.replace("0.001", "0.01")
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{folder}/labels.parquet")
    model = quality.fit(docs, labels, "quality", ~held_out("doc_id", 4, 2))
    rows = quality.scored(docs, model).join(labels, "doc_id").filter(held_out("doc_id", 4, 2)).collect()
    assert np.mean([(r.quality_score >= 0.7) == r.quality for r in rows]) > 0.9
    odd = quality.scored(documents(spark), model)
    assert odd.columns[:-1] == documents(spark).columns
    assert all(0 <= r.quality_score <= 1 for r in odd.collect())
    single = quality.fit(docs, labels.filter("quality = 1"), "quality", ~held_out("doc_id", 4, 2))
    assert 0 <= single.score(["a"])[0] <= 1


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(2)
    rows, lengths = rng.normal(0, 3, (30, 3)), np.array([0, 5, 1, 7, 5])
    words = rng.integers(0, 30, lengths.sum())
    got = language_spans.viterbi(rows, words, lengths, 2.5)
    import itertools
    ends = np.cumsum(lengths)
    cost = lambda at, p: sum(rows[w, s] for w, s in zip(words[at], p)) - 2.5 * sum(a != b for a, b in zip(p, p[1:]))
    for low, high in zip(ends - lengths, ends):
        at = slice(low, high)
        best = max((cost(at, p) for p in itertools.product(range(3), repeat=high - low)), default=0)
        assert cost(at, got[at].tolist()) == pytest.approx(best)


def test_language_of_texts_and_spans(spark):
    docs = documents(spark)
    model = language_spans.fit(docs, ~held_out("doc_id", 5, 0))
    rows = language_spans.labelled(docs, model).filter(held_out("doc_id", 5, 0) & F.col("lang").isNotNull()).collect()
    assert np.mean([r.language.lang == r.lang for r in rows]) > 0.93
    odd = {r.doc_id: r.language for r in language_spans.labelled(docs, model).filter("doc_id in (100001, 100002, 100003)").collect()}
    assert {(x.lang, x.score) for x in odd.values()} == {("und", 0.0)}
    texts = {lang: docs.filter(f"lang = '{lang}' and length(text) > 300").orderBy("doc_id").first().text for lang in ("en", "de")}
    mixed = " ".join(texts["en"].split()[:40] + texts["de"].split()[:40])
    (lang, score, spans), = model.label([mixed])
    assert {s[0] for s in spans} == {"en", "de"} and spans[0][1] == 0 and spans[-1][2] == 79
    assert language_spans.fit(docs.limit(0), ~held_out("doc_id", 5, 0)).label(["a", None]) == [("und", 0.0, [])] * 2


def test_script_narrows_candidates():
    counts, scripts = np.ones((2, len(language_spans.GRAMS) * language_spans.BUCKETS)), np.zeros((2, len(language_spans.NAMES)))
    scripts[0, language_spans.NAMES.index("Greek")] = scripts[1, language_spans.NAMES.index("Cyrillic")] = 100
    model = language_spans.Model(["el", "ru"], counts, scripts)
    assert [x[0] for x in model.label(["λόγος", "слово", "123"])] == ["el", "ru", "und"]


def test_recall_and_ties(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").select("vec_id", "embedding", F.lit(1).alias("dim"), F.lit(2).alias("shard"))
    odd = [(9001, None), (9002, [0.0] * 64), (9003, [float("nan")] * 64), (9004, [1.0] * 63 + [None]), (9020, []), (None, [1.0] * 64),
           *[(9100 + i, [0.25] * 64) for i in range(60)], (9200, [1.0, 2.0])]
    rows = rows.unionByName(spark.createDataFrame([(a, b, 1, 2) for a, b in odd], rows.schema))
    rows = rows.unionByName(rows.filter("vec_id < 5"))
    index = hnsw.build_index(rows, shard_rows=150)
    assert index.count() > 3
    got = hnsw.search(index, rows.filter("vec_id % 20 = 0")).collect()
    every = {r.vec_id: np.array(r.embedding, float) for r in rows.collect()
             if r.vec_id is not None and r.embedding and len(r.embedding) == 64 and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)}
    found = {}
    for r in got:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {q for q in every if q % 20 == 0}  # 9200 has two components and no other vector to meet
    hits = 0
    for q, answers in found.items():
        exact = sorted(((-float(every[v] @ every[q]), v) for v in every if v != q))[:20]
        assert [a[0] for a in sorted(answers)] == list(range(1, 21)) and q not in [a[1] for a in answers]
        assert all(abs(a[2] - every[a[1]] @ every[q]) < 1e-9 for a in answers)
        hits += len({v for _, v in exact} & {a[1] for a in answers})
    assert hits / (20 * len(found)) > 0.97
    assert sorted(v for _, v, _ in found[9100])[:20] == list(range(9101, 9121))
    assert hnsw.search(hnsw.build_index(rows.limit(0)), rows).count() == 0


def test_stages_of_the_pipeline(spark, tmp_path):
    docs = documents(spark).drop("score", "id", "y", "label", "rank")
    secret = spark.createDataFrame([(100010, "A clean line with token=abcdef123456 inside.", "en", "src0", 44),
                                    (100011, "A clean line with token=abcdef123456 inside.", "en", "src0", 44)], docs.schema)
    docs = docs.unionByName(secret)
    kept, counts = docs, [docs.count()]
    for name, function in corpus_pipeline.STAGES[:-1]:
        before, kept = kept, corpus_pipeline.stage(function(spark, kept, FOLDER))
        assert kept.columns == docs.columns
        counts.append(kept.count())
        if name == "near duplicates":
            groups = covering_simhash.near_duplicates(before).filter("component_id is not null")
            assert kept.filter("doc_id is not null").count() == groups.select("component_id").distinct().count()
    assert counts == sorted(counts, reverse=True) and counts[3] == counts[4]
    ids = {r.doc_id: r for r in kept.collect()}
    assert 100010 in ids and 100011 not in ids and ids[100010].text == "A clean line with [SECRET] inside." and ids[100010].n_chars == 34
    assert secret_ledger.by_path(kept, secret_ledger.scan(kept)).filter("size(findings) > 0").count() == 0
    packed = corpus_pipeline.packed(spark, kept, FOLDER)
    assert packed.select("doc_id").distinct().count() == kept.select("doc_id").distinct().count()
    assert corpus_pipeline.STAGES[1][1](spark, docs.limit(0), FOLDER).count() == 0


def test_queries_return_one_row_per_document(spark):
    n = spark.read.parquet(f"{FOLDER}/documents.parquet").count()
    for name in ("op1_toxicity", "op4_language_model", "op5_windows", "op6_language", "op7_secrets", "op9_simhash", "op10_quality"):
        assert queries.all_queries()[name](spark, FOLDER).count() == n, name
