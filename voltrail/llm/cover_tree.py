"""Hard negatives by exact inner-product search in cover trees.

Candidates are dealt by hash into shards; each shard is one task and keeps its tree as flat arrays in one row of a written
table. Every vector of a shard gets one component more, so that all have the same length: they lie on a sphere, where a covering
radius is an angle, and the angle from a query to a node's centre bounds the inner products of everything below it from both sides.
A node's children are a net of its members: centres further apart than the level's radius, every member within it of
its centre, each child with the radius that its own members need.

A query descends best first, by the largest product that a node may hold within the query's windows; nodes wholly outside
all windows, or below what has been found already, are skipped, and the points of a leaf are multiplied exactly. Rows of a partition
are sorted so that a shard's tree comes first and its queries stream past it: a tree is read once, whatever the queries' number.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.llm.common import ship
from voltrail.session import stage

SHARD_ROWS = 8192
#: Members up to which a node is a leaf.
LEAF = 512
#: By how much a level's radius shrinks: the first that needs few children. Vectors without any structure need the last ones.
SHRINK = (2.0, 1.5, 1.25, 1.12, 1.05)
#: Integer components beyond this are out of reach of exact products.
LARGEST = 1 << 25
PARTITIONS = 20_000


class Tree(NamedTuple):
    """Points in the order of the nodes, and per node its centre, covering angle, children, direct points and span of labels."""

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    length: float
    centre: np.ndarray
    angle: np.ndarray
    child_from: np.ndarray
    child_to: np.ndarray
    point_from: np.ndarray
    point_to: np.ndarray
    label_low: np.ndarray
    label_high: np.ndarray


def _exact(vectors: np.ndarray) -> np.ndarray:
    """Floating point where products stay exact in it, which is faster; else 64-bit integers."""
    most = float(np.abs(vectors).max(initial=0))
    return vectors.astype(np.float64) if vectors.shape[1] * most * LARGEST < 2 ** 53 or vectors.shape[1] * most * most < 2 ** 50 else vectors


def grow(vectors: np.ndarray, ids: np.ndarray, labels: np.ndarray, leaf: int = LEAF) -> Tree:
    """The tree of one shard, level by level. A node's own points are those of its children that need no node of their own."""
    square = np.einsum("nd,nd->n", vectors.astype(float), vectors.astype(float))
    length = float(np.sqrt(square.max(initial=0)))
    unit = np.column_stack((vectors, np.sqrt(np.maximum(length ** 2 - square, 0)))) / (length or 1.0)
    centre, angle, child_from, child_to, point_from, point_to, low, high, order = ([] for _ in range(9))

    def node(at: int, members: np.ndarray) -> np.ndarray:
        distance = np.linalg.norm(unit[members] - unit[at], axis=1)
        centre.append(at)
        angle.append(2 * np.arcsin(min(1.0, distance.max() / 2)))
        low.append(labels[members].min())
        high.append(labels[members].max())
        return members

    first = int(np.argmax(unit @ unit.sum(axis=0)))
    waiting = [node(first, np.arange(len(ids)))]
    at = 0
    while at < len(waiting):
        members, span = waiting[at], 2 * np.sin(angle[at] / 2)
        child_from.append(len(waiting))
        point_from.append(len(order))
        if len(members) <= leaf or span < 1e-12:
            order.extend(members.tolist())
        else:
            for child in _children(unit, members, centre[at], span, 2 * len(members) // leaf):
                if len(child) <= leaf // 4:
                    order.extend(child.tolist())
                else:
                    waiting.append(node(int(child[0]), child))
        child_to.append(len(waiting))
        point_to.append(len(order))
        at += 1
    order = np.array(order, int)
    numbers = [np.array(x, np.int64) for x in (child_from, child_to, point_from, point_to, low, high)]
    return Tree(_exact(vectors[order]), ids[order], labels[order], length, _exact(vectors[np.array(centre, int)]), np.array(angle), *numbers)


def _children(unit: np.ndarray, members: np.ndarray, first: int, span: float, few: int) -> list[np.ndarray]:
    """The net of the next level, by the largest shrinking that has few enough centres, else by the least."""
    for shrink in SHRINK[:-1]:
        lists = _net(unit, members, first, span / shrink, few)
        if lists:
            return lists
    return _net(unit, members, first, span / SHRINK[-1], len(members))


def _net(unit: np.ndarray, members: np.ndarray, first: int, radius: float, most: int) -> list[np.ndarray]:
    """The members by centre, each list led by its centre: centres are further apart than `radius`, members within it of theirs.

    Empty if there are more centres than `most`.
    """
    rest, lists, at, extra = members[members != first], [], first, np.array([first])
    while len(lists) < most:
        near = unit[rest] @ unit[at] >= 1 - radius ** 2 / 2  # on the unit sphere
        lists.append(np.concatenate((extra, rest[near])))
        rest = rest[~near]
        if not len(rest):
            return lists
        at, extra, rest = rest[0], rest[:1], rest[1:]
    return []


def best(tree: Tree, query: np.ndarray, ident: int, label: int, same: bool, low: np.ndarray, high: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per window [low, high] the scores and ids of its k best points, best first, ties by smaller id.

    Points have the query's label (`same`) or another one, and another id than the query.
    """
    length = float(np.sqrt((query.astype(float) ** 2).sum()))
    scale, slack = length * tree.length, 1e-9 * length * tree.length + 1e-6
    exact = query.astype(tree.vectors.dtype)
    highest = high.max(initial=-np.inf)
    least = np.where(low > high, np.inf, -np.inf)  # a product must reach this; nothing fits a window turned about
    found = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in low]

    def bounds(nodes: slice) -> tuple[np.ndarray, np.ndarray]:
        if scale == 0:
            return np.zeros(nodes.stop - nodes.start), np.zeros(nodes.stop - nodes.start)
        turn = np.arccos(np.clip((tree.centre[nodes] @ exact).astype(float) / scale, -1, 1))
        top = scale * np.cos(np.maximum(turn - tree.angle[nodes] - 1e-7, 0)) + slack
        return top, scale * np.cos(np.minimum(turn + tree.angle[nodes] + 1e-7, np.pi)) - slack

    def push(nodes: slice) -> None:
        top, bottom = bounds(nodes)
        some = (tree.label_low[nodes] <= label) & (label <= tree.label_high[nodes]) if same else (tree.label_low[nodes] != label) | (tree.label_high[nodes] != label)
        reach = np.minimum(top[:, None], high)
        wanted = some[:, None] & (top[:, None] >= low) & (bottom[:, None] <= high) & (reach >= least)
        for i in np.flatnonzero(wanted.any(axis=1)):
            heapq.heappush(heap, (-reach[i][wanted[i]].max(), nodes.start + int(i), top[i], bottom[i]))

    heap: list[tuple[float, int, float, float]] = []
    push(slice(0, 1))
    while heap:
        reach, node, top, bottom = heapq.heappop(heap)
        if -reach < least.min():
            break
        if not ((top >= low) & (bottom <= high) & (np.minimum(top, high) >= least)).any():
            continue
        points = slice(tree.point_from[node], tree.point_to[node])
        if points.stop > points.start:
            score = tree.vectors[points] @ exact
            floor = np.maximum(low, least)
            some = np.flatnonzero((score >= floor.min()) & (score <= highest))
            some = some[((tree.labels[points][some] == label) == same) & (tree.ids[points][some] != ident)]
            if len(some):
                scores, ids = score[some].astype(np.int64), tree.ids[points][some]
                most, fewest = scores.max(), scores.min()
                for w in range(len(low)):
                    if most >= floor[w] and fewest <= high[w]:
                        found[w], least[w] = _merged(*found[w], scores, ids, floor[w], high[w], k)
        if tree.child_to[node] > tree.child_from[node]:
            push(slice(tree.child_from[node], tree.child_to[node]))
    return found


def _merged(scores: np.ndarray, ids: np.ndarray, more: np.ndarray, whose: np.ndarray, low: float, high: float, k: int):
    """The k best of what a window has and of new points, and the score that the next ones must reach."""
    good = (more >= low) & (more <= high)
    scores, ids = np.concatenate((scores, more[good])), np.concatenate((ids, whose[good]))
    if len(scores) > 4 * k:
        good = scores >= np.partition(scores, -k)[-k]
        scores, ids = scores[good], ids[good]
    first = np.lexsort((ids, -scores))[:k]
    return (scores[first], ids[first]), scores[first[-1]] if len(first) == k else low


def usable(vector: Column) -> Column:
    """Not null, not empty, and every component a number within reach."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) <= LARGEST)) & (F.size(vector) > 0), F.lit(False))


INDEX = "dim int, shard int, size int, length double, vectors binary, ids binary, labels binary, centre binary, angle binary, links binary"


def build_index(rows: DataFrame, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """A written table with one tree per row. `rows` are (id, label, v), v integer components.

    Rows with a null id, label or vector, a null component or one beyond `LARGEST` take no part; a row repeated in all three counts once, rows
    that share only the id are rows of their own. Vectors meet those of their dimension. Shards are even by a hash of the whole row.
    """
    ship(rows.sparkSession)
    good = rows.select(F.col("id").cast("long"), F.col("label").cast("long"), F.col("v").cast("array<bigint>")).filter(
        F.col("id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).distinct()
    good = stage(good.withColumn("dim", F.size("v")), "candidates")
    counts = good.groupBy("dim").agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("shards"))
    first = F.sum("shards").over(Window.orderBy("dim").rowsBetween(Window.unboundedPreceding, -1))  # one row per dimension
    counts = stage(counts.withColumn("first", F.coalesce(first, F.lit(0)).cast("int")), "shards")
    placed = good.join(counts, "dim").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("id", "label", "v"), F.col("shards")).cast("int"))
    total = counts.agg(F.sum("shards")).first()[0] or 1
    dealt = placed.select("dim", "shard", "id", "label", "v").repartitionById(min(total, PARTITIONS), F.col("shard"))
    return stage(dealt.groupBy("dim", "shard").applyInPandas(_packed, INDEX), "trees")


def _packed(part: pd.DataFrame) -> pd.DataFrame:
    part = part.sort_values("id", kind="stable")
    tree = grow(np.stack(part.v.to_numpy()).astype(np.int64), part.id.to_numpy(np.int64), part.label.to_numpy(np.int64))
    links = np.stack((tree.child_from, tree.child_to, tree.point_from, tree.point_to, tree.label_low, tree.label_high))
    raw = lambda x: x.astype("<i8").tobytes()
    return pd.DataFrame({"dim": [part.dim.iloc[0]], "shard": [part.shard.iloc[0]], "size": [len(part)], "length": [tree.length], "vectors": [raw(tree.vectors)],
                         "ids": [raw(tree.ids)], "labels": [raw(tree.labels)], "centre": [raw(tree.centre)], "angle": [tree.angle.astype("<f8").tobytes()],
                         "links": [raw(links)]})


def unpacked(row) -> Tree:
    numbers = lambda raw: np.frombuffer(raw, "<i8")
    return Tree(_exact(numbers(row.vectors).reshape(-1, row.dim)), numbers(row.ids), numbers(row.labels), row.length, _exact(numbers(row.centre).reshape(-1, row.dim)),
                np.frombuffer(row.angle, "<f8"), *numbers(row.links).reshape(6, -1))


def _search(index: DataFrame, asked: DataFrame, same: bool, k: int) -> DataFrame:
    """(anchor, twin, window, score, id): the k best of every window and shard. `asked` are (anchor, twin, label, v, dim, low, high), the last two arrays."""
    shards = stage(index.groupBy("dim").agg(F.min("shard").alias("first"), F.max("shard").alias("last")), "shards")
    parts = min(max(index.count(), 1), PARTITIONS)
    queries = asked.join(shards, "dim").withColumns({"kind": F.lit(1), "shard": F.explode(F.sequence("first", "last"))}).drop("first", "last")
    zero = F.lit(0).cast("long")  # a null would turn the ids of its batch into floating point
    trees = index.withColumns({"kind": F.lit(0), "anchor": zero, "twin": zero, "label": zero})
    rows = trees.unionByName(queries, allowMissingColumns=True).repartitionById(parts, F.col("shard")).sortWithinPartitions("shard", "kind")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, shard = None, None
        for batch in batches:
            out = []
            for row in batch.itertuples():
                if row.kind == 0:
                    tree, shard = unpacked(row), row.shard
                elif shard == row.shard:
                    windows = best(tree, np.asarray(row.v, np.int64), row.anchor, row.label, same, np.asarray(row.low), np.asarray(row.high), k)
                    out += [(row.anchor, row.twin, w, int(s), int(i)) for w, (scores, ids) in enumerate(windows) for s, i in zip(scores, ids)]
            yield pd.DataFrame(out, columns=["anchor", "twin", "window", "score", "id"])

    return rows.mapInPandas(run, "anchor long, twin long, window int, score long, id long")


def mine(rows: DataFrame, anchors: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, index: DataFrame | None = None,
         shard_rows: int = SHARD_ROWS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: hard negatives of every anchor and positive.

    `rows` are (id, label, v) as in :func:`build_index`; `anchors` chooses among them. An anchor's positives are its best rows of the same label, its
    negatives for one of them the best rows of other labels with a product between `low` and `high` percent of the positive's; both ends count.
    Rows of the anchor's own id are neither. Ties go to the smaller id. An anchor without a positive, or a positive without a negative, has no row.
    """
    ship(rows.sparkSession)
    index = build_index(rows, shard_rows) if index is None else index
    chosen = rows.filter(anchors).select(F.col("id").cast("long").alias("anchor"), F.col("label").cast("long"), F.col("v").cast("array<bigint>"))
    chosen = chosen.filter(F.col("anchor").isNotNull() & F.col("label").isNotNull() & usable(F.col("v"))).distinct()
    chosen = stage(chosen.withColumns({"twin": F.xxhash64("label", "v"), "dim": F.size("v")}), "anchors")
    all_scores = {"low": F.array(F.lit(float("-inf"))), "high": F.array(F.lit(float("inf")))}
    first = _search(index, chosen.withColumns(all_scores), True, positives)
    place = lambda keys: F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "id"))
    who = ["anchor", "twin"]
    first = first.withColumn("place", place(who)).filter(F.col("place") <= positives)
    listed = F.array_sort(F.collect_list(F.struct("place", "score", "id")))
    pairs = chosen.join(first.groupBy(*who).agg(listed.alias("pairs")), who)
    share = lambda percent: F.transform("pairs", lambda p: p["score"] * F.lit(percent) / F.lit(100.0))
    pairs = stage(pairs.withColumns({"low": share(low), "high": share(high)}), "positives")
    second = _search(index, pairs.drop("pairs"), False, negatives).withColumn("rank", place([*who, "window"])).filter(F.col("rank") <= negatives)
    known = pairs.select(*who, F.posexplode("pairs").alias("window", "pair"))
    return second.join(known, [*who, "window"]).select(F.col("anchor").alias("anchor_id"), F.col("pair")["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"),
                                                       F.col("pair")["score"].alias("positive_score"), F.col("score").alias("negative_score"))
