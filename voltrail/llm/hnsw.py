"""Approximate nearest neighbours by inner product: one hierarchical navigable small-world graph per shard.

Equal vectors are indexed once, with their smallest ids. Distinct vectors are dealt by hash into shards of about
`shard_rows`; each shard is one task, its graph is a row of flat arrays in a written table. A query
visits every shard of its dimension, in blocks of queries, and the shards' nearest are merged.

Largest inner product becomes nearest neighbour by one more component that gives all vectors of a
shard the same length. Points are inserted and queries are searched many at a time: each step takes, for all of them,
the best candidate not yet visited, so that numpy works on whole blocks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.session import stage

LINKS = 16
BUILD_WIDTH = 96
SEARCH_WIDTH = 128
SHARD_ROWS = 8192
QUERY_ROWS = 2048
AT_ONCE = 256
FEW = 256


def beam(points: np.ndarray, neighbours: np.ndarray, queries: np.ndarray, entries: np.ndarray, width: int,
         together: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Ids and similarities of the `width` nearest found for each query, best first; -1 where there are fewer."""
    n_queries, step = len(queries), neighbours.shape[1] * together
    ids = np.full((n_queries, width), -1, np.int32)
    sims = np.full((n_queries, width), -np.inf, np.float32)
    done = np.ones((n_queries, width), bool)
    ids[:, 0] = entries
    sims[:, 0] = np.einsum("qd,qd->q", points[entries], queries)
    done[:, 0] = False
    seen = np.full((n_queries, len(points)), -1, np.int16)
    seen[np.arange(n_queries), entries] = step
    rows = np.arange(n_queries)
    marks = np.arange(step, dtype=np.int16)
    while True:
        rows = rows[~done[rows].all(axis=1)]
        if not len(rows):
            return ids, sims
        order = np.argsort(done[rows], axis=1, kind="stable")[:, :together]
        fresh = ~np.take_along_axis(done[rows], order, 1)
        chosen = np.where(fresh, np.take_along_axis(ids[rows], order, 1), -1)
        done[rows[:, None], order] = True
        near = np.where((chosen >= 0)[:, :, None], neighbours[chosen], -1).reshape(len(rows), -1)
        new = (near >= 0) & (seen[rows[:, None], near] < 0)
        r, c = np.nonzero(new)
        seen[rows[r], near[r, c]] = marks[c]
        first = seen[rows[r], near[r, c]] == marks[c]  # of repeats in one step only the last counts
        r, c = r[first], c[first]
        found = np.full(near.shape, -np.inf, np.float32)
        found[r, c] = np.einsum("kd,kd->k", points[near[r, c]], queries[rows[r]])
        all_sims = np.concatenate((sims[rows], found), axis=1)
        best = np.argsort(-all_sims, axis=1, kind="stable")[:, :width]
        ids[rows] = np.take_along_axis(np.concatenate((ids[rows], near), axis=1), best, 1)
        sims[rows] = np.take_along_axis(all_sims, best, 1)
        done[rows] = np.take_along_axis(np.concatenate((done[rows], np.zeros(near.shape, bool)), axis=1), best, 1) | np.isneginf(sims[rows])


def choose(points: np.ndarray, ids: np.ndarray, sims: np.ndarray, most: int) -> np.ndarray:
    """Up to `most` of each row's candidates (best first, -1 for none): first those that are closer to the row's point
    than to any chosen before them, then the nearest of the rest."""
    vectors = points[ids]
    between = np.matmul(vectors, vectors.transpose(0, 2, 1))
    closest = np.full(ids.shape, -np.inf, np.float32)
    taken = np.zeros(ids.shape, bool)
    room = np.full(len(ids), most)
    for j in range(ids.shape[1]):
        take = (ids[:, j] >= 0) & (sims[:, j] > closest[:, j]) & (room > 0)
        taken[:, j] = take
        room -= take
        closest[take] = np.maximum(closest[take], between[take, j])
    rank = np.where(taken, 0, np.where(ids >= 0, 1, 2))
    order = np.argsort(rank, axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(rank, order, 1) < 2, np.take_along_axis(ids, order, 1), -1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1).astype(np.int32)


def _link(points, neighbours, new, ids, sims):
    """Links of new points, and back to them from their neighbours."""
    most = neighbours.shape[1]
    neighbours[new] = choose(points, ids, sims, most)
    row, col = np.nonzero(neighbours[new] >= 0)
    source, target = new[row], neighbours[new][row, col]
    likeness = np.einsum("kd,kd->k", points[source], points[target])
    order = np.lexsort((-likeness, target))
    source, target, likeness = source[order], target[order], likeness[order]
    first = np.flatnonzero(np.r_[True, target[1:] != target[:-1]])
    rank = np.arange(len(target)) - np.repeat(first, np.diff(np.r_[first, len(target)]))
    keep = rank < most
    nodes, at = np.unique(target, return_inverse=True)
    added = np.full((len(nodes), most), -1, np.int32)
    added[at[keep], rank[keep]] = source[keep]
    for low in range(0, len(nodes), AT_ONCE):
        some = nodes[low:low + AT_ONCE]
        old, more = neighbours[some], added[low:low + AT_ONCE].copy()
        more[(more[:, :, None] == old[:, None, :]).any(axis=2)] = -1
        both = np.concatenate((old, more), axis=1)
        like = np.where(both >= 0, np.einsum("rcd,rd->rc", points[both], points[some]), -np.inf).astype(np.float32)
        order = np.argsort(-like, axis=1, kind="stable")
        neighbours[some] = choose(points, np.take_along_axis(both, order, 1), np.take_along_axis(like, order, 1), most)


def build(points: np.ndarray, seed: int = 0) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from the lowest: (members, neighbours); members are sorted by arrival, neighbours are places among them.

    The members of the level above come first, compared with each other without a graph; then every
    batch searches the graph so far and itself.
    """
    n = len(points)
    rng = np.random.default_rng(seed)
    level = np.minimum((-np.log(1 - rng.random(n)) / np.log(LINKS)).astype(int), 8)
    order = np.lexsort((np.arange(n), -level))
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for height in range(level.max(), -1, -1):
        members = order[: int((level >= height).sum())]
        here = points[members]
        neighbours = np.full((len(members), LINKS * (2 if height == 0 else 1)), -1, np.int32)
        begin = 0
        while begin < len(members):
            size = max(FEW, len(levels[0][0]) if levels else 0) if begin == 0 else min(begin, 2 * AT_ONCE)
            new = np.arange(begin, min(begin + size, len(members)))
            batch = here[new] @ here[new].T
            np.fill_diagonal(batch, -np.inf)
            near = np.argsort(-batch, axis=1, kind="stable")[:, :BUILD_WIDTH]
            ids, sims = (near + begin).astype(np.int32), np.take_along_axis(batch, near, 1).astype(np.float32)
            ids[np.isneginf(sims)] = -1
            if begin:
                entries = descend(points, levels, here[new])
                found = beam(here, neighbours[:begin], here[new], entries, BUILD_WIDTH)
                ids, sims = np.concatenate((found[0], ids), axis=1), np.concatenate((found[1], sims), axis=1)
                best = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_WIDTH]
                ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            _link(here, neighbours, new, ids, sims)
            begin += len(new)
        levels.insert(0, (members, neighbours))
    return levels


def descend(points: np.ndarray, levels: list, queries: np.ndarray) -> np.ndarray:
    """Where to enter the level below `levels`: the members of a level are the first of the level below, so places carry over."""
    at = np.zeros(len(queries), np.int32)
    for members, neighbours in reversed(levels):
        at = beam(points[members], neighbours, queries, at, 1, 1)[0][:, 0]
    return at


def nearest(points: np.ndarray, levels: list, queries: np.ndarray, width: int) -> np.ndarray:
    """Ids of the nearest points found, -1 where there are fewer."""
    members, neighbours = levels[0]
    here, out = points[members], []
    for low in range(0, len(queries), AT_ONCE):
        some = queries[low:low + AT_ONCE]
        found = beam(here, neighbours, some, descend(points, levels[1:], some), width)[0]
        out.append(np.where(found >= 0, members[found], -1))
    return np.concatenate(out)


def valid(vector: str) -> Column:
    """Not null, not zero, every component finite."""
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _same_length(vectors: np.ndarray) -> np.ndarray:
    """float32 vectors scaled into reach, with a component more that gives all the same length."""
    scaled = vectors / max(np.abs(vectors).max(), 1e-300)
    square = np.einsum("nd,nd->n", scaled, scaled)
    return np.column_stack((scaled, np.sqrt(np.maximum(square.max() - square, 0)))).astype(np.float32)


def build_index(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", members: int = 21,
                shard_rows: int = SHARD_ROWS) -> DataFrame:
    """The index as a written table: one row per shard with vectors, ids and flat neighbour arrays.

    Of rows with equal vectors the `members` smallest ids are kept: no answer of fewer than that many
    can hold another. Rows with a null id take no part; a repeated row counts once.
    """
    every = rows.filter(F.col(id_column).isNotNull()).filter(valid(vector_column)).select(
        F.col(id_column).cast("long").alias("id"), F.transform(vector_column, lambda x: x.cast("double") + F.lit(0.0)).alias("v")).distinct()
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    points = stage(every.withColumn("rank", rank).filter(F.col("rank") <= members).groupBy("v").agg(
        F.sort_array(F.collect_list("id")).alias("ids")).withColumn("dim", F.size("v")), "points")
    counts = points.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    placed = points.join(counts, "dim").withColumn("shard", F.pmod(F.xxhash64("v"), F.col("shards")).cast("int"))

    def make(part: pd.DataFrame) -> pd.DataFrame:
        part = part.assign(least=part.ids.str[0]).sort_values("least")
        vectors = np.stack(part.v.to_numpy()).astype("<f8")
        levels = build(_same_length(vectors))
        return pd.DataFrame({
            "dim": [part.dim.iloc[0]], "shard": [part.shard.iloc[0]], "shards": [part.shards.iloc[0]], "vectors": [vectors.tobytes()],
            "ids": [np.concatenate(part.ids.to_numpy()).astype("<i8").tobytes()],
            "counts": [part.ids.str.len().to_numpy("<i4").tobytes()],
            "sizes": [[len(m) for m, _ in levels]], "members": [b"".join(m.astype("<i4").tobytes() for m, _ in levels)],
            "neighbours": [b"".join(x.astype("<i4").tobytes() for _, x in levels)]})

    schema = ("dim int, shard int, shards int, vectors binary, ids binary, counts binary, sizes array<int>, members binary, neighbours binary")
    total = counts.agg(F.sum("shards")).first()[0] or 1  # a task per graph; small partitions would be put together
    return stage(placed.repartition(min(total, 20_000), "dim", "shard").groupBy("dim", "shard").applyInPandas(make, schema), "graphs")


def _levels(row) -> list[tuple[np.ndarray, np.ndarray]]:
    members, links = np.frombuffer(row.members, "<i4"), np.frombuffer(row.neighbours, "<i4")
    out, m, x = [], 0, 0
    for height, size in enumerate(row.sizes):
        wide = LINKS * (2 if height == 0 else 1)
        out.append((members[m:m + size], links[x:x + size * wide].reshape(size, wide)))
        m, x = m + size, x + size * wide
    return out


def search(index: DataFrame, queries: DataFrame, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding",
           width: int = SEARCH_WIDTH) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found, by inner product in double precision, without the query's own id.

    Invalid query vectors and null ids give no rows; a query meets vectors of its own dimension only. Ties go to
    the smaller id. `k` must be less than the `members` of the index.
    """
    asked = queries.filter(F.col(id_column).isNotNull()).filter(valid(vector_column)).select(
        F.col(id_column).cast("long").alias("query_id"), F.transform(vector_column, lambda x: x.cast("double")).alias("v"),
        F.size(vector_column).alias("dim")).distinct()
    blocks = max(1, -(-asked.count() // QUERY_ROWS))
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")
    shards = index.groupBy("dim").agg(F.max("shards").alias("shards"))
    left = asked.join(shards, "dim").select("query_id", "v", "dim", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))
    right = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))

    def run(asked: pd.DataFrame, graphs: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(graphs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        row = graphs.iloc[0]
        vectors = np.frombuffer(row.vectors, "<f8").reshape(-1, row.dim)
        counts = np.frombuffer(row.counts, "<i4")
        ids, starts = np.frombuffer(row.ids, "<i8"), np.cumsum(counts) - counts
        wanted = np.stack(asked.v.to_numpy())
        scaled = wanted / np.abs(wanted).max(axis=1, keepdims=True)
        found = nearest(_same_length(vectors), _levels(row), np.column_stack((scaled, np.zeros(len(scaled)))).astype(np.float32), width)
        out = []
        for query, vector, near in zip(asked.query_id.to_numpy(), wanted, found):
            near = near[near >= 0]
            score = vectors[near] @ vector
            best = np.lexsort((ids[starts[near]], -score))[:k + 1]
            owner = np.repeat(best, counts[near[best]])
            candidates = np.concatenate([ids[starts[i]:starts[i] + counts[i]] for i in near[best]])
            score, keep = score[owner], candidates != query
            candidates, score = candidates[keep], score[keep]
            best = np.lexsort((candidates, -score))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": candidates[best], "score": score[best]}))
        return pd.concat(out)

    keys = ("dim", "shard", "block")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", rank).filter(
        F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
