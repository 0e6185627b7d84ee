"""Operators with an exact meaning, against brute force on small tables with nulls, ties, repeats and empties."""

import hashlib
import itertools
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voltrail.llm import covering_simhash, decontaminate, packing, partial_matching, secret_ledger, window_dedup
from voltrail.llm.common import components

SCHEMA = "doc_id long, text string, key string, id string, count long, findings string"


def frame(spark, rows):
    """Documents with extra columns whose names operators use themselves."""
    return spark.createDataFrame([(d, t, "k", "i", 7, "f") for d, t in rows], SCHEMA)


def words(n, seed):
    rng = np.random.default_rng(seed)
    return " ".join("".join(rng.choice(list("abcdef"), 4)) for _ in range(n))


BASE = words(160, 1)
EDITED = " ".join(BASE.split()[:60] + ["zz"] + BASE.split()[61:])
ODD = [(1, BASE), (2, EDITED), (3, BASE), (3, BASE), (4, None), (5, ""), (6, " \n\t "), (None, BASE), (None, None), (7, "one"),
       (8, words(8000, 3)), (9, "Straße ÄÖ   x"), (10, words(70, 4) + " " + " ".join(BASE.split()[20:90])), (11, "one  two"), (12, "ONE two")]


def test_windows_match_brute_force(spark):
    got = sorted(map(tuple, window_dedup.deduplicated(frame(spark, ODD)).select("doc_id", "n_words", "n_removed", "kept_sha256", "kept").collect()), key=str)
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in ODD]
    for d, w in split:
        for i in range(len(w) - 49) if d is not None else ():
            gram = tuple(w[i:i + 50])
            first[gram] = min(d, first.get(gram, d))
    want = []
    for d, w in split:
        gone = set()
        for i in range(len(w) - 49) if d is not None else ():
            if first[tuple(w[i:i + 50])] < d:
                gone.update(range(i, i + 50))
        body = b" ".join(x for i, x in enumerate(w) if i not in gone)
        want.append((d, len(w), len(gone), hashlib.sha256(body).hexdigest(), body.decode()))
    assert got == sorted(want, key=str)
    assert sum(r[2] for r in want) > 300


def test_anchor_of_equal_windows_is_equal():
    a = np.random.default_rng(1).integers(0, 2 ** 63, 300).astype(np.uint64)
    b = np.concatenate((a[77:200], a[:40]))
    left, right = window_dedup.anchors(a, 50, 8), window_dedup.anchors(b, 50, 8)
    assert (left[77:77 + 74] == right[:74]).all()
    x = np.random.default_rng(2).integers(0, 99, 200).astype(np.uint64)
    assert [min(x[i:i + 43]) for i in range(158)] == window_dedup.sliding_least(x, 43).tolist()


def test_fingerprints_and_components(spark):
    def brute(text):
        w = (text or "").encode().lower().split()
        if not w:
            return 0
        k = min(3, len(w))
        hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + k]), 42) for i in range(len(w) - k + 1)]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    rows = covering_simhash.near_duplicates(frame(spark, ODD)).collect()
    prints = [brute(t) for _, t in ODD]
    assert sorted(r.fingerprint for r in rows) == sorted(f"{p:016x}" for p in prints)
    reach = list(range(len(ODD)))
    for i, j in itertools.product(range(len(ODD)), repeat=2):
        if bin(prints[i] ^ prints[j]).count("1") <= 2:
            a, b = reach[i], reach[j]
            reach = [min(a, b) if r in (a, b) else r for r in reach]
    least = {}
    for (d, _), r in zip(ODD, reach):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    want = sorted(((d, least.get(r)) for (d, _), r in zip(ODD, reach)), key=str)
    assert sorted(((r.doc_id, r.component_id) for r in rows), key=str) == want


def test_every_pair_within_two_bits_is_linked(spark):
    rng = np.random.default_rng(5)
    points = [int(x) for x in rng.integers(-2 ** 63, 2 ** 63, 40)]
    points += [covering_simhash.signed((p ^ 1 << int(a) ^ 1 << int(b)) & (1 << 64) - 1) for p in points[:30] for a, b in [rng.choice(64, 2, replace=False)]]
    points += [covering_simhash.signed((points[0] ^ 7 << 20) & (1 << 64) - 1), 0]
    points = sorted(set(points))
    for a, b in itertools.combinations(points, 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
            assert any(a & m == b & m for m in covering_simhash.masks())
    rooted = components(covering_simhash.links(spark.createDataFrame([(p,) for p in points], "fp long")))
    got = {r.node: r.root for r in rooted.collect()}
    root = {p: p for p in points}
    for a, b in itertools.combinations(points, 2):
        if bin((a ^ b) & (1 << 64) - 1).count("1") <= 2:
            x, y = root[a], root[b]
            root = {p: min(x, y) if r in (x, y) else r for p, r in root.items()}
    assert all(got.get(p, p) == r for p, r in root.items())


@pytest.mark.parametrize("changes", [(), (5, 10, 15), (3, 7, 11, 15, 19)])
def test_substitutions_do_not_hide_a_passage(spark, changes):
    item = words(24, 8).split()
    copied = [("other" if i in changes else w) for i, w in enumerate(item)]
    docs = frame(spark, [(1, words(300, 9) + " " + " ".join(copied).upper() + "! " + words(40, 10)), (2, words(400, 11)), (3, None), (3, ""),
                         (None, " ".join(item)), (4, " ".join(item[:7]))])
    items = spark.createDataFrame([(1, " ".join(item), "x"), (1, " ".join(item), "x"), (2, None, "x"), (3, "too short", "x")], "item_id long, text string, doc_id string")
    found = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs, items).collect()}
    assert set(found) == {(1, 1), (None, 1)}
    assert found[1, 1].equal_words == 24 - len(changes) and found[1, 1].start == 300
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == [2, 3, 3, 4]
    assert decontaminate.contaminated(docs.limit(0), items).count() == 0 == decontaminate.contaminated(docs, items.limit(0)).count()


def test_masks_meet_every_pattern_that_the_threshold_accepts():
    """Over all patterns that no mask meets, the best (equal) - (different) of each length, by dynamic programming over the last words."""
    span = max(max(m) for m in decontaminate.MASKS) + 1
    met = [sum(1 << p + span - 1 - max(m) for p in m) for m in decontaminate.MASKS]
    best, top = {0: 0}, 0
    for n in range(1, 400):
        step = {}
        for last, score in best.items():
            for equal in (0, 1):
                now = last >> 1 | equal << span - 1
                if not any(now & m == m for m in met):
                    step[now] = max(score + (1 if equal else -1), step.get(now, -n))
        best, top = step, max(top, *step.values())
        assert n < decontaminate.SEEDED or top < min(decontaminate.MIN_WORDS, decontaminate.MIN_SHARE * n), n


def test_short_items_and_every_accepted_pattern_of_them(spark):
    """All patterns of equal and replaced words of items of 7 and 8 words, and copies of items of 1 to 6 words."""
    docs, items, want = [], [], set()
    for n in range(1, 9):
        item = [f"w{n}x{i}" for i in range(n)]
        items.append((n, " ".join(item)))
        for k, pattern in enumerate(itertools.product((0, 1), repeat=n)):
            scores = [2 * sum(pattern[a:b]) - (b - a) for a in range(n) for b in range(a + 1, n + 1)]
            docs.append((1000 * n + k, " ".join(["before", *[w if p else "other" for w, p in zip(item, pattern)], "after"])))
            if max(scores) >= 0.6 * n if n >= 7 else all(pattern):
                want.add((docs[-1][0], n))
    found = decontaminate.contaminated(frame(spark, docs), spark.createDataFrame([*items, (90, ""), (91, None)], "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in found.collect()} == want and len(want) > 40


SECRETS = [(1, 'Password = "abcdef1" x'), (2, "token: secret=abcdefgh api_key='AKIA" + "A" * 20 + "'"), (3, "password: token: abcdef123"), (4, None), (4, ""),
           (5, "ü🙂 " + "0" * 24 + " und " + "a" * 23), (None, "x AKIA" + "Z" * 16), (6, "-----BEGIN RSA PRIVATE KEY-----\nab\n-----END RSA PRIVATE KEY-----"),
           (7, 'Password = "abcdef1" x'), (8, ("passwd=" + "q" * 9 + " ") * 300)]


def brute_spans(text):
    text, spans = text or "", []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
        if len(m[2]) >= 6:
            spans.append((m.start(), 0, m.end(), "assign"))
    spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_secrets_and_redaction(spark):
    docs = frame(spark, SECRETS).drop("findings")
    ledger = secret_ledger.scan(docs)
    rows = secret_ledger.by_path(docs, ledger).withColumn("masked", secret_ledger.redact("text", "findings")).collect()
    assert len(rows) == len(SECRETS)
    for row in rows:
        base = [tuple(f) for f in row.findings if f.rule in secret_ledger.BASE]
        assert base == brute_spans(row.text)
        assert row.text is None or (row.masked == row.text) == (not row.findings)
        assert not brute_spans(row.masked)
    assert [f.rule for r in rows if r.doc_id == 6 for f in r.findings] == ["private_key"]


def test_the_ledger_is_read_before_a_text_is_scanned_again(spark):
    docs, more = frame(spark, SECRETS), frame(spark, [(20, "a new one: token=zzzzzzz"), (21, SECRETS[0][1])])
    ledger = spark.createDataFrame(secret_ledger.scan(docs).collect(), secret_ledger.LEDGER_SCHEMA)
    assert ledger.count() == len({t or "" for _, t in SECRETS})
    assert secret_ledger.scan(docs, ledger).count() == 0
    assert secret_ledger.scan(docs.unionByName(more), ledger).count() == 1
    newer = tuple(r._replace(version=2) if r.name == "hex" else r for r in secret_ledger.RULES)
    again = secret_ledger.scan(docs, ledger, rules=newer).collect()
    assert len(again) == ledger.count() and {tuple(r.scanned) for r in again} == {("hex:2",)}
    both = secret_ledger.by_path(docs.drop("findings"), ledger.unionByName(spark.createDataFrame(again, secret_ledger.LEDGER_SCHEMA)))
    assert all([tuple(f) for f in r.findings if f.rule in secret_ledger.BASE] == brute_spans(r.text) for r in both.collect())
    assert secret_ledger.scan(docs.limit(0)).count() == 0


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer
    import public_tokenizers

    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    texts = [t or "" for _, t in ODD] + ["a  b", "a   b", "a \n b ", "x\n\n  y z  ", " lead", "tail ", "don't <|endoftext|> 12 345", "  ", "    q", "é" * 40]
    encode = packing.Encoder("byte_bpe_50k.json")
    for text, ids in zip(texts, encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == exact.encode(text, add_special_tokens=False).ids, repr(text)
    rows = packing.pack(frame(spark, ODD), capacity=64).collect()
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    total, sequences = Counter(), defaultdict(list)
    for r in rows:
        total[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    want = Counter()
    for d, t in ODD:
        want[d] += len(exact.encode(t or "", add_special_tokens=False).ids) + 1
    assert total == want
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert packing.pack(frame(spark, ODD).limit(0)).count() == 0


def test_costs_are_balanced():
    lengths = np.random.default_rng(3).integers(1, 400, 500).tolist()
    placed = packing.plan(lengths, 1024, 1.0, 1 / 1024)
    assert sum(n for _, _, n, _, _ in placed) == sum(lengths)
    used, cost = Counter(), Counter()
    for _, _, n, s, _ in placed:
        used[s] += n
        cost[s] += n + n * n / 1024
    assert sum(1024 - n for n in used.values()) < 1024
    assert max(cost.values()) < 1.25 * np.median(list(cost.values()))


def learn():
    return F.col("doc_id") % 2 == 0


def test_partial_matching_matches_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(["abab", "ABAC ab", None, "", "the cat the hat", "the cat", "zq ö", "the hat", words(200, 2), words(90, 2)])] + [(4, "x"), (None, "the cat")]
    table, counts = [defaultdict(Counter) for _ in range(6)], Counter()
    for d, t in rows:
        if d is not None and d % 2 == 0:
            text = (t or "").encode().lower()
            counts.update([*text.split(), "end"])
            s = [257] * 5 + list(text) + [256]
            for i in range(5, len(s)):
                for k in range(6):
                    table[k][tuple(s[i - k:i])][s[i]] += 1
    total = sum(counts.values())

    def probability(context, x):
        p, gone = 1.0, set()
        for k in range(5, -1, -1):
            seen = {y: c for y, c in table[k].get(tuple(context[5 - k:]), {}).items() if y not in gone}
            if not seen:
                continue
            n = sum(seen.values())
            if x in seen:
                return p * (seen[x] - 0.5) / n
            p *= 0.5 * len(seen) / n
            gone |= set(seen)
        return p / (257 - len(gone))

    assert sum(probability([257, 257] + list(b"the"), x) for x in range(257)) == pytest.approx(1)
    got = partial_matching.score(frame(spark, rows), learn()).collect()
    assert len(got) == len(rows)
    want = []
    for d, t in rows:
        text = (t or "").encode().lower()
        s = [257] * 5 + list(text) + [256]
        tokens = [*text.split(), "end"]
        want.append((d, len(tokens), sum(counts[w] > 0 for w in tokens), total,
                     sum(math.log10((counts[w] + 1) / (total + len(counts) + 1)) for w in tokens),
                     sum(math.log10(probability(s[i - 5:i], s[i])) for i in range(5, len(s)))))
    order = lambda r: (str(r[0]), r[1], r[5])
    have = sorted([(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got], key=order)
    for a, b in zip(have, sorted(want, key=order)):
        assert a[:4] == b[:4] and a[4:] == pytest.approx(b[4:], rel=1e-6)


def test_partial_matching_without_training_rows(spark):
    got = partial_matching.score(frame(spark, [(1, "ab"), (3, None)]), learn()).collect()
    assert {r.doc_id: round(r.score, 6) for r in got} == {1: round(-3 * math.log10(257), 6), 3: round(-math.log10(257), 6)}
    assert partial_matching.score(frame(spark, []), learn()).count() == 0
