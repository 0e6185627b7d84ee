"""A Merkle manifest of a dataset: one tree per source, one tree over the sources, a proof per row.

Rows are ranked within their source by a parallel sort. Every `BLOCK` consecutive leaves of a source form a
superblock, whose tops are reduced level by level to the source's top (its subroot); the subroots, in order of
the sources, are reduced alike to the root. From the root down, every node hands its children the nodes that
stand beside it, so each superblock gets the outer nodes that its proofs need, and no more. Leaves
and outer nodes are then cogrouped by superblock: one call finishes the local levels, joins the proofs and folds them.

No task holds more than one superblock of leaves (4,096) and its path, however large a source is, and there may
be any number of sources.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from voltrail.llm.common import ship
from voltrail.session import stage

#: Consecutive nodes that become one node of the next level.
RUN = 16
#: Levels within a superblock, and its leaves.
LOCAL = 3
BLOCK = RUN ** LOCAL


class Manifest(NamedTuple):
    #: Written rows: (id, source, tree, place, block, leaves, leaf, shown). `tree` sorts the sources; `leaves` counts those of the tree.
    leaves: DataFrame
    #: Written rows, one per superblock: (tree, block, subroot, root, path). `path` lists (place, nodes) from the superblock's top to the root.
    outer: DataFrame


def field(value: Column) -> Column:
    """A value as it enters a leaf: `-` for null, else its UTF-8 byte count, a colon and itself."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(fields: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(f) for f in fields]).cast("binary"), 256)


def build(docs: DataFrame, fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_column: str = "doc_id",
          by: str = "source", shown: Mapping[str, Column] | None = None) -> Manifest:
    """The manifest of all rows of `docs`; other columns than `fields`, `id_column` and `by` are not read.

    Leaves of a source ascend by id, null ids first; rows of one id are ordered by their leaves, so equal rows may change
    places without a trace. A null source is a source of its own, before all others. `shown` gives columns as somebody presents
    them later (over the columns of `docs`): the leaf of a row so presented is kept beside the true one, to be proved against
    the manifest. An empty table has no leaf, no root and no rows.
    """
    ship(docs.sparkSession)
    original = [F.col(f) for f in fields]
    presented = [(shown or {}).get(f, F.col(f)) for f in fields]
    source = F.col(by).cast("string")
    rows = docs.select(F.col(id_column).alias("id"), source.alias("source"), F.when(source.isNull(), "-").otherwise(F.concat(F.lit("="), source)).alias("tree"),
                       digest(original).alias("leaf"), *([digest(presented).alias("shown")] if shown else []))
    rows = stage(rows if shown else rows.withColumn("shown", F.col("leaf")), "hashed")  # the sort below samples its input
    leaves = ranked(rows, ["tree"], ["id", "leaf", "shown"], "place", "leaves").withColumn("block", F.floor(F.col("place") / BLOCK))
    leaves = stage(leaves, "leaves")
    return Manifest(leaves, stage(_outer(_tops(leaves)), "outer"))


def ranked(df: DataFrame, keys: list[str], order: list[str], place: str, total: str) -> DataFrame:
    """Adds each row's place from 0 among the rows of its keys, and their number.

    Rows are sorted in parallel; a place is the place in the partition and the group's rows in the partitions before, of
    which there is one row per partition and group. A group of any size spreads over many tasks.
    """
    columns = [*keys, *order]
    sorted_ = df.repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("at_", F.monotonically_increasing_id())
    sorted_ = stage(sorted_.withColumn("slot_", F.shiftright("at_", 33)), "sorted")
    parts = sorted_.groupBy(*keys, "slot_").agg(F.count("*").alias("n_"), F.min("at_").alias("first_"))
    whole = Window.partitionBy(*(keys or [F.lit(0)]))
    before = whole.orderBy("slot_").rowsBetween(Window.unboundedPreceding, -1)
    parts = stage(parts.select(*keys, "slot_", (F.coalesce(F.sum("n_").over(before), F.lit(0)) - F.col("first_")).alias("shift_"),
                               F.sum("n_").over(whole).alias(total)), "parts")
    return sorted_.join(parts, [*keys, "slot_"]).withColumn(place, F.col("at_") + F.col("shift_")).drop("at_", "slot_", "shift_")


def _parent(nodes: Column) -> Column:
    return F.sha2(F.array_join(nodes, "").cast("binary"), 256)


def _parents(nodes: Column) -> Column:
    """Every run of consecutive nodes as its hash."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / RUN).cast("int"))
    return F.transform(runs, lambda i: _parent(F.slice(nodes, i * RUN + 1, F.lit(RUN))))


def _tops(leaves: DataFrame) -> DataFrame:
    """(tree, at, node): the top of each superblock. A tree of one superblock ends at its first single node; in a larger one
    every superblock is reduced by all local levels, the last one too."""
    listed = F.array_sort(F.collect_list(F.struct("place", "leaf")))
    blocks = leaves.groupBy("tree", "block").agg(F.transform(listed, lambda x: x["leaf"]).alias("nodes"), F.max("leaves").alias("leaves"))
    for _ in range(LOCAL):
        single = (F.size("nodes") == 1) & (F.col("leaves") <= BLOCK)
        blocks = blocks.withColumn("nodes", F.when(single, F.col("nodes")).otherwise(_parents(F.col("nodes"))))
    return stage(blocks.select("tree", F.col("block").alias("at"), F.col("nodes")[0].alias("node")), "tops")


def _climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, lowest first, as written tables (tree, run, nodes, parent), and the top (tree, node) of each tree.

    A tree leaves as soon as it has one node. Each level has a sixteenth of the rows of the one below, so there are few levels.
    """
    levels, tops = [], []
    while True:
        last = nodes.groupBy("tree").agg(F.max("at").alias("last"))
        nodes = stage(nodes.join(last, "tree"), "nodes")
        tops.append(nodes.filter("last = 0").select("tree", "node"))
        rising = nodes.filter("last > 0")
        if rising.isEmpty():
            break
        listed = F.transform(F.array_sort(F.collect_list(F.struct("at", "node"))), lambda x: x["node"])
        runs = rising.groupBy("tree", F.floor(F.col("at") / RUN).alias("run")).agg(listed.alias("nodes"))
        levels.append(stage(runs.withColumn("parent", _parent(F.col("nodes"))), "runs"))
        nodes = levels[-1].select("tree", F.col("run").alias("at"), F.col("parent").alias("node"))
    top = tops[0]
    for more in tops[1:]:
        top = top.unionByName(more)
    return levels, top


PATH = "array<struct<place:int,nodes:array<string>>>"


def _descend(levels: list[DataFrame], top: DataFrame, bottom: DataFrame) -> DataFrame:
    """`bottom` (tree, at) with the path of each node and what its tree's top brings: `top` (tree, rest..., path).

    Paths are handed from a run to its at most sixteen children, so no node meets more rows than that.
    """
    rest = [c for c in top.columns if c not in ("tree", "path")]

    def below(children: DataFrame, parents: DataFrame) -> DataFrame:
        """Children (tree, at) of runs (tree, run, nodes, path, rest...)."""
        step = F.struct((F.col("at") % RUN).cast("int").alias("place"), F.col("nodes"))
        met = children.withColumn("run", F.floor(F.col("at") / RUN)).join(parents, ["tree", "run"])
        return met.select("tree", "at", *rest, F.concat(F.array(step), F.col("path")).cast(PATH).alias("path"))

    at_top = top.withColumn("at", F.lit(0).cast("long"))
    reached = None
    for level in reversed(levels):
        runs = level.select("tree", F.col("run").alias("at"), "nodes")
        last = runs.groupBy("tree").agg(F.max("at").alias("last")).filter("last = 0").select("tree")  # trees that end above this run
        ended = runs.join(last, "tree", "left_semi").join(at_top.drop("at"), "tree")
        found = ended if reached is None else ended.unionByName(below(runs.select("tree", "at"), reached).join(runs, ["tree", "at"]))
        reached = stage(found.withColumnRenamed("at", "run"), "paths")
    single = bottom.groupBy("tree").agg(F.max("at").alias("last")).filter("last = 0").select("tree")
    alone = single.join(at_top, "tree").select("tree", "at", *rest, "path")
    return alone if reached is None else alone.unionByName(below(bottom.select("tree", "at"), reached))


def _outer(tops: DataFrame) -> DataFrame:
    """(tree, block, subroot, root, path) of each superblock."""
    levels, subroots = _climb(tops)
    subroots = stage(subroots, "subroots")
    sources = ranked(subroots, [], ["tree"], "at", "n").select(F.lit("").alias("tree"), "at", "node", F.col("tree").alias("source"))
    sources = stage(sources, "sources")
    upper, root = _climb(sources.drop("source"))
    empty = F.array().cast(PATH)
    root = root.select("tree", F.col("node").alias("root"), empty.alias("path"))
    paths = _descend(upper, root, sources).select("at", "root", "path")
    tree_tops = stage(sources.join(paths, "at").select(F.col("source").alias("tree"), F.col("node").alias("subroot"), "root", "path"), "tree-tops")
    return _descend(levels, tree_tops, tops).select("tree", F.col("at").alias("block"), "subroot", "root", "path")


PROVED = "id {}, source string, place long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, siblings int"


def proofs(manifest: Manifest) -> DataFrame:
    """One row per leaf: its proof (as the hash of the siblings, lowest level first, left to right, and their number), and the root
    that the presented leaf folds to with the true siblings. `verified` says that this is the root of the manifest."""
    kind = manifest.leaves.schema["id"].dataType.simpleString()
    left = manifest.leaves.select("tree", "block", "id", "source", "place", "leaves", "leaf", "shown").groupBy("tree", "block")
    return left.cogroup(manifest.outer.groupBy("tree", "block")).applyInPandas(_prove, PROVED.format(kind))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _reduce(nodes: list[str], whole: bool) -> list[list[str]]:
    """The levels of a superblock from its leaves up, its top not included; `whole` if its tree has no other superblock."""
    levels = []
    while len(levels) < LOCAL and not (whole and len(nodes) == 1):
        levels.append(nodes)
        nodes = [_sha("".join(nodes[i:i + RUN])) for i in range(0, len(nodes), RUN)]
    return levels


def _beside(nodes: Sequence[str], at: int) -> tuple[str, str]:
    """The run's nodes before and after the one at a place."""
    begin = at - at % RUN
    return "".join(nodes[begin:at]), "".join(nodes[at + 1:begin + RUN])


def _prove(leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    leaves = leaves.sort_values("place", kind="stable")
    known = outer.iloc[0]
    levels = _reduce(leaves.leaf.tolist(), int(leaves.leaves.iloc[0]) <= BLOCK)
    above = [_beside(list(step["nodes"]), int(step["place"])) for step in known.path]
    shared, folds = "".join(a + b for a, b in above), {}

    def fold_outer(node: str) -> str:
        """Few different tops reach this: one, and one more for each altered leaf."""
        if node not in folds:
            top = node
            for a, b in above:
                top = _sha(a + top + b)
            folds[node] = top
        return folds[node]

    proof, folded, counts = [], [], []
    for at, shown in enumerate(leaves.shown):
        sides, node = [], shown
        for nodes in levels:
            before, after = _beside(nodes, at)
            sides += before, after
            node = _sha(before + node + after)
            at //= RUN
        sides = "".join(sides) + shared
        proof.append(_sha(sides))
        counts.append(len(sides) // 64)
        folded.append(fold_outer(node))
    found = leaves[["id", "source", "place", "leaf"]].assign(subroot=known.subroot, root=known.root, proof_sha256=proof, folded_root=folded)
    return found.assign(verified=np.array(folded, object) == known.root, siblings=counts)
