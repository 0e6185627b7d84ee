"""SimHash fingerprints linked by covering locality-sensitive hashing.

Bits of a fingerprint are mapped to the vectors of GF(2)^(radius+1); table v, one per nonzero vector v,
keeps the bits whose vector has an odd product with v and hides the others. Any `radius` bits are
hidden together by some v, as `radius` equations in `radius + 1` unknowns have a nonzero solution:
two fingerprints within the radius therefore share their key in some table, without exception.

Fingerprints that share a key are linked without listing pairs: every one of them names the points
one flipped bit away and itself, and all who name the same point are within two bits of each other
(and any two within two bits name a common point). The smallest one that names a point stands for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voltrail.llm.common import broadcast_if_small, components, row_key, text_bytes, whole_row
from voltrail.session import stage

BITS, RADIUS = 64, 2
SHINGLE = 3
SEED = 42


def masks() -> list[int]:
    """The kept bits of each table, as signed 64-bit numbers."""
    vectors = 2 ** (RADIUS + 1) - 1
    kept = [sum(1 << i for i in range(BITS) if bin((i % vectors + 1) & v).count("1") % 2) for v in range(1, vectors + 1)]
    return [signed(m) for m in kept]


def signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """SimHash of a text's word shingles as a signed 64-bit number; without words it is zero."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    spans = zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(words) - k + 1)
    counts = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, text_column: str = "text", to: str = "fp") -> DataFrame:
    """The rows with the fingerprint of their text; a null text is empty."""

    @F.pandas_udf("long")
    def of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([fingerprint(t) for t in part], dtype="int64")

    return docs.withColumn(to, of(text_bytes(text_column)))


def links(points: DataFrame, fp: str = "fp") -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within two bits: stars, not pairs."""
    kept = F.array(*[F.lit(m) for m in masks()])
    keyed = points.select(fp, F.posexplode(kept).alias("table", "mask")).select(
        fp, "table", F.col(fp).bitwiseAND(F.col("mask")).alias("key"))
    shared = keyed.groupBy("table", "key").agg(F.min(fp).alias("low"), F.max(fp).alias("high")).filter("low <> high")
    close = keyed.join(shared.select("table", "key"), ["table", "key"], "left_semi").select(fp).distinct()
    flips = F.array(F.lit(0).cast("long"), *[F.lit(signed(1 << i)) for i in range(BITS)])
    named = close.select(fp, F.explode(flips).alias("flip")).select(fp, F.col(fp).bitwiseXOR(F.col("flip")).alias("point"))
    stars = named.groupBy("point").agg(F.min(fp).alias("low"), F.max(fp).alias("high")).filter("low <> high")
    return named.join(stars.select("point", "low"), "point").filter(F.col(fp) != F.col("low")).select(
        F.col(fp).alias("a"), F.col("low").alias("b")).distinct()


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", key: Column | None = None) -> DataFrame:
    """One row per document: doc_id, fp (signed), fingerprint (16 hex digits), component_id, root, and `key` if one is given.

    component_id is the smallest id reachable over fingerprints within two bits; root is a fingerprint that names the component. Rows with a null id are linked
    by their text like all others, but never name a component (it is null if no member has an id).
    Repeated rows stay; an empty table gives no rows; other columns are read by `key` alone.
    """
    more = [] if key is None else [key.alias("key")]
    rows = fingerprints(docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"), *more)).drop("text")
    rows = stage(rows, "fingerprints")
    points = stage(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "points")
    roots = components(links(points.select("fp")))
    classes = points.join(roots, points.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    names = classes.groupBy("root").agg(F.min("least").alias("component_id"))
    of = classes.join(names, "root").select("fp", "component_id", "root")
    return rows.join(of, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "root", *(["key"] if more else []))


def representatives(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of each component, all columns: one with the smallest id, of several of those the one with the smallest hash of its text.

    A component in which no row has an id keeps one row. Rows with one id and texts that are not linked are in different components,
    and each of those keeps its own. Names of columns do not matter; an empty table stays empty.
    """
    of = row_key(id_column, text_column)
    found = near_duplicates(docs, id_column, text_column, of)
    kept = found.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root").agg(F.min("key").alias("key"))
    kept = broadcast_if_small(kept.select("key"), 200_000, "kept")
    rows = docs.select(whole_row(docs).alias("row"), of.alias("of"))
    met = rows.join(kept, rows["of"].eqNullSafe(kept["key"]), "left_semi")
    return met.dropDuplicates(["of"]).select("row.*")
