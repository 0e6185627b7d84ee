"""Stages of the pipeline on odd tables: repeated ids, clashing column names, nothing at all."""

import pytest

import corpus_pipeline
from voltrail.llm import secret_ledger

FOLDER = "/root/testdata/sf0.001"
CLASHING = ("findings", "findings_", "blob", "row", "of", "key", "key_", "found_", "kept_", "toxicity", "fp", "root", "score")
SECRET = "A line with token=abcdef123456 inside."


def odd(spark):
    rows = [(1, "one two three four five six seven", 33), (1, "entirely other words stand in this text here", 44), (2, "one two three four five six seven", 33),
            (3, None, None), (3, "", 0), (None, "one two three four five six seven", 33), (None, "nobody has an id for this text", 30), (None, "nobody has an id for this text", 30),
            (7, SECRET, len(SECRET)), (7, SECRET, len(SECRET)), (8, "x " * 50000, 100000)]
    table = spark.createDataFrame([(d, t, "en", "s", n, *("v" + c for c in CLASHING)) for d, t, n in rows],
                                  "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING))
    return table


@pytest.mark.parametrize("at", range(4))
def test_stages_keep_the_columns_whatever_their_names(spark, at):
    docs = odd(spark)
    name, function = corpus_pipeline.STAGES[at]
    got = function(spark, docs, FOLDER)
    assert got.columns == docs.columns
    rows = got.collect()
    assert all(r[c] == "v" + c for r in rows for c in CLASHING)
    assert function(spark, docs.limit(0), FOLDER).count() == 0
    if name == "near duplicates":
        assert sorted(((r.doc_id, r.text) for r in rows), key=str) == sorted(
            [(1, "one two three four five six seven"), (1, "entirely other words stand in this text here"), (3, None), (None, "nobody has an id for this text"),
             (7, SECRET), (8, "x " * 50000)], key=str)
    else:
        assert len(rows) == docs.count()
    if name == "secrets":
        assert {r.text for r in rows if r.doc_id == 7} == {"A line with [SECRET] inside."}
        assert all(r.n_chars == len(r.text) for r in rows if r.doc_id == 7)


def test_findings_give_way_or_take_another_name(spark):
    docs = odd(spark)
    ledger = secret_ledger.scan(docs)
    plain = secret_ledger.by_path(docs, ledger)
    assert plain.columns == [c for c in docs.columns if c != "findings"] + ["findings"]
    named = secret_ledger.by_path(docs, ledger, to="spans")
    assert named.columns == docs.columns + ["spans"]
    assert [len(r.spans) for r in named.collect() if r.doc_id == 7] == [1, 1]
