"""Cover trees and hard negatives against brute force."""

from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from voltrail.llm import cover_tree

SCHEMA = "id long, label int, v array<bigint>, anchor string, shard string, score string, dim string"


def clustered(n, dim, seed):
    """Points in clusters of clusters, of different lengths, with copies."""
    rng = np.random.default_rng(seed)
    near = rng.normal(0, 300, (6, dim))[rng.integers(0, 6, n)] + rng.normal(0, 60, (40, dim))[rng.integers(0, 40, n)]
    points = np.floor(near + rng.normal(0, 15, (n, dim))).astype(np.int64)
    points[n // 2:n // 2 + n // 5] = points[0]
    points[-1] = 0
    return points


def test_covering_angles_hold_and_every_point_is_in_one_leaf():
    points = clustered(1500, 12, 1)
    ids, labels = np.arange(1500), np.arange(1500) % 4
    tree = cover_tree.grow(points, ids, labels, leaf=24)
    assert sorted(tree.ids.tolist()) == ids.tolist() and (points[tree.ids] == tree.vectors).all()
    assert len(tree.centre) > 40
    square = np.einsum("nd,nd->n", tree.vectors, tree.vectors)
    unit = np.column_stack((tree.vectors, np.sqrt(np.maximum(tree.length ** 2 - square, 0)))) / tree.length

    def members(node):
        own = list(range(tree.point_from[node], tree.point_to[node]))
        return own + [p for c in range(tree.child_from[node], tree.child_to[node]) for p in members(c)]

    assert sorted(members(0)) == list(range(1500))
    for node in range(len(tree.centre)):
        at = np.append(tree.centre[node], np.sqrt(max(tree.length ** 2 - tree.centre[node] @ tree.centre[node], 0))) / tree.length
        inside = members(node)
        assert np.arccos(np.clip(unit[inside] @ at, -1, 1)).max() <= tree.angle[node] + 1e-6
        assert tree.label_low[node] == tree.labels[inside].min() and tree.label_high[node] == tree.labels[inside].max()


def test_best_in_windows_is_exact_and_skips_nodes(monkeypatch):
    points = clustered(3000, 10, 2)
    ids, labels = np.random.default_rng(3).permutation(3000), np.arange(3000) % 3
    tree = cover_tree.grow(points, ids, labels, leaf=24)
    opened, real = Counter(), cover_tree.heapq.heappop
    monkeypatch.setattr(cover_tree.heapq, "heappop", lambda heap: opened.update(n=1) or real(heap))
    for q in range(0, 3000, 60):
        top = float((points @ points[q]).max())
        cover_tree.best(tree, points[q], ids[q], labels[q], True, np.array([-np.inf]), np.array([np.inf]), 5)
        cover_tree.best(tree, points[q], ids[q], labels[q], False, np.array([0.3 * top]), np.array([0.9 * top]), 10)
    assert opened["n"] < 0.35 * 100 * len(tree.centre)
    for q in range(0, 3000, 60):
        exact = points @ points[q]
        top = float(exact.max())
        low, high = np.array([-np.inf, 0.3 * top, 0.5 * top, 5.0]), np.array([np.inf, 0.9 * top, 0.52 * top, 2.0])
        for same in (True, False):
            got = cover_tree.best(tree, points[q], ids[q], labels[q], same, low, high, 10)
            for w, (scores, found) in enumerate(got):
                fits = ((labels == labels[q]) == same) & (ids != ids[q]) & (exact >= low[w]) & (exact <= high[w])
                want = sorted(((-s, i) for s, i in zip(exact[fits], ids[fits])))[:10]
                assert [(-s, i) for s, i in zip(scores, found)] == want


def brute(rows):
    good = sorted({(i, l, tuple(v)) for i, l, v in rows if i is not None and l is not None and v and None not in v and max(map(abs, v)) <= cover_tree.LARGEST})
    out = []
    for a, label, v in good:
        if a % 100:
            continue
        met = [(-sum(x * y for x, y in zip(v, w)), i, m == label) for i, m, w in good if i != a and len(w) == len(v)]
        for s, p, _ in sorted(x for x in met if x[2])[:5]:
            fits = sorted(x for x in met if not x[2] and 30 * -s <= 100 * -x[0] <= 90 * -s)[:10]
            out += [(a, p, rank, n, -s, -m) for rank, (m, n, _) in enumerate(fits, 1)]
    return out


def test_mining_matches_brute_force(spark):
    points = clustered(700, 6, 4)
    rows = [(i if i else -100, int(i * 7 % 5), p.tolist()) for i, p in enumerate(points)]
    rows += [(1000, None, [1] * 6), (1100, 1, None), (1200, 1, [1, None, 1, 1, 1, 1]), (None, 1, [1] * 6), (1300, 1, []), (1400, 2, [1 << 26] * 6), (1500, 1, [0] * 6),
             rows[3], rows[100], (100, 9, rows[101][2]), (200, rows[200][1], rows[7][2]), (1600, 3, [4, 5]), (1601, 3, [9, 9]), (1602, 4, [5, 3]), (1700, 1, [1 << 25] * 6), (1701, 1, [1 << 24] * 6),
             (1702, 2, [1 << 23] * 6)]
    table = spark.createDataFrame([(*r, "a", "s", "c", "d") for r in rows], SCHEMA)
    for shard_rows in (90, 4096):
        got = cover_tree.mine(table, F.col("id") % 100 == 0, shard_rows=shard_rows).collect()
        assert Counter(map(tuple, got)) == Counter(brute(rows))
    assert len(got) > 200 and {r.anchor_id for r in got} >= {-100, 1600, 1700}
    assert cover_tree.mine(table.limit(0), F.col("id") % 100 == 0).count() == 0
    assert cover_tree.mine(table, F.lit(False)).count() == 0
