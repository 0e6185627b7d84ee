"""The Merkle manifest against a brute-force tree in plain Python."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from voltrail.llm import merkle_manifest
from voltrail.llm.common import LOWER, UPPER, remainder

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, place string, path string, root string, id string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(doc_id, source, lang, n_chars, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def lowered(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def climb(nodes):
    """Levels of a tree from its leaves to its top."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def sides(levels, at):
    found = []
    for nodes in levels[:-1]:
        begin = at - at % 16
        found.append((nodes[begin:at], nodes[at + 1:begin + 16]))
        at //= 16
    return found


def brute(rows):
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        shown = lowered(text) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 else text
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, leaf_of(doc_id, source, lang, n_chars, text),
                                              leaf_of(doc_id, source, lang, n_chars, shown), doc_id))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([r[2] for r in sorted(groups[s], key=lambda r: r[:4])]) for s in order}
    upper = climb([trees[s][-1][0] for s in order])
    want = []
    for i, s in enumerate(order):
        for at, row in enumerate(sorted(groups[s], key=lambda r: r[:4])):
            path = sides(trees[s], at) + sides(upper, i)
            node = row[3]
            for before, after in path:
                node = sha("".join(before) + node + "".join(after))
            proof = sha("".join("".join(b) + "".join(a) for b, a in path))
            want.append((row[4], row[2], trees[s][-1][0], upper[-1][0], proof, node, node == upper[-1][0]))
    return want


def proved(docs):
    tampered = F.when(remainder("doc_id", 5) == 0, F.translate("text", UPPER, LOWER)).otherwise(F.col("text"))
    rows = merkle_manifest.proofs(merkle_manifest.build(docs, shown={"text": tampered})).collect()
    return [(r.id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified) for r in rows]


def many():
    """Sources of every shape: one row, a full run, one over a run, several superblocks with a last run of one; more than 16 sources."""
    sizes = {"a": 1, "b": 16, "ü": 17, "c": 256, "d": 257, "e": 4096, "f": 4097, "g": 70000 // 8, None: 40, "": 3, **{f"s{i}": 1 + i % 3 for i in range(20)}}
    rows, at = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            rows.append((at * 7 % 1_000_003, f"Text {at} ÄB" if at % 11 else None, "en" if at % 3 else None, source, at if at % 5 else None))
            at += 1
    return rows + [(None, None, None, None, None), (None, "", "x", "a", 0), rows[5], rows[5], (rows[5][0], "other", None, rows[5][3], 1), (-3, "Long " * 50000, "en", "b", 9)]


@pytest.mark.parametrize("rows", [many(), many()[:1], many()[17:60], [(1, "A", None, None, 1), (2, "B", None, "x", 1)]], ids=["many", "one", "few", "two"])
def test_manifest_matches_brute_force(spark, rows):
    docs = spark.createDataFrame([(*r, "t", "p", "q", "r", "i") for r in rows], SCHEMA)
    got, want = proved(docs), brute(rows)
    key = lambda r: (str(r[0]), *r[1:])
    assert sorted(got, key=key) == sorted(want, key=key)
    assert len({r[3] for r in got}) == 1


def test_an_empty_table_has_no_root(spark):
    manifest = merkle_manifest.build(spark.createDataFrame([], SCHEMA))
    assert merkle_manifest.proofs(manifest).count() == 0 == manifest.outer.count()


def test_untouched_rows_verify_and_any_change_shows(spark):
    docs = spark.createDataFrame([(i, f"text {i}", "en", f"s{i % 3}", i) for i in range(300)], "doc_id long, text string, lang string, source string, n_chars long")
    assert merkle_manifest.proofs(merkle_manifest.build(docs)).filter("verified").count() == 300
    changed = merkle_manifest.build(docs, shown={"n_chars": F.when(F.col("doc_id") == 7, 0).otherwise(F.col("n_chars"))})
    assert [r.id for r in merkle_manifest.proofs(changed).filter("not verified").collect()] == [7]
