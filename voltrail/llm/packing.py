"""Cost-balanced packing of tokenised documents into fixed-length sequences.

Every input partition is packed on its own, in groups of a few million tokens, so nothing is shuffled
and a repeated task gives the same sequences. Within a group the documents are cut into pieces of at
most `capacity` tokens; a piece costs `linear * n + quadratic * n^2` (attention is quadratic in the
piece). Pieces are taken in descending order of cost, and each goes to the sequence with the lowest
cost that still has room; what exceeds the room is cut off and queued again. A group of T tokens
uses ceil(T / capacity) sequences, so under one capacity of padding is lost per group.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

CAPACITY = 1024
GROUP_TOKENS = 1 << 22
DOCS_AT_ONCE = 500

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, piece_cost double")


class Encoder:
    """Token ids of texts, as the `tokenizers` file says.

    A byte-level file whose merges are numbered in their order is the same thing as a table of ranks, which tiktoken merges several
    times faster; tests compare both over all kinds of text. Any other file is run by tokenizers itself.
    """

    def __init__(self, name: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        path = name if "/" in name else public_tokenizers.path(name)
        ranks = merge_ranks(path)
        self.ranked = ranks and tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        if not ranks:
            self.tokenizer = Tokenizer.from_file(str(path))
            self.tokenizer.encode_special_tokens = True

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.ranked:
            return [np.array(self.ranked.encode_ordinary(t), "<u4").tobytes() for t in texts]
        return [np.asarray(e.ids, "<u4").tobytes() for t in texts for e in self.tokenizer.encode_batch([t], add_special_tokens=False)]


def merge_ranks(path: str) -> dict[bytes, int] | None:
    """Bytes of each token with its id, if the file merges bytes in the order of the ids and cuts texts by the public pattern; else None."""
    import json

    with open(path, encoding="utf-8") as file:
        whole = json.load(file)
    model, cut = whole["model"], whole["pre_tokenizer"] or {}
    plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if model["type"] != "BPE" or not plain or whole["normalizer"] or whole["post_processor"] or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") \
            or not cut.get("use_regex", True):
        return None
    vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    if [vocabulary.get(a + b) for a, b in merges] != list(range(256, 256 + len(merges))):
        return None
    named = {token["content"] for token in whole["added_tokens"]}
    shown = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c]  # bytes that a byte-level file writes as themselves
    hidden = [c for c in range(256) if c not in shown]
    byte = {**{chr(c): c for c in shown}, **{chr(256 + i): c for i, c in enumerate(hidden)}}
    return {bytes(byte[c] for c in token): at for token, at in vocabulary.items() if token not in named}


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """The encoder of this Python worker, kept from task to task."""
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def plan(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of the given lengths."""
    sequences = -(-sum(lengths) // capacity)
    rooms = [capacity] * sequences
    costs = [(0.0, s) for s in range(sequences)]
    pieces = [(-min(capacity, n - at), d, at) for d, n in enumerate(lengths) for at in range(0, n, capacity)]
    heapq.heapify(pieces)
    placed = []
    while pieces:
        size, d, at = heapq.heappop(pieces)
        cost, s = heapq.heappop(costs)
        take = min(-size, rooms[s])
        placed.append((d, at, take, s, capacity - rooms[s]))
        rooms[s] -= take
        if rooms[s]:
            heapq.heappush(costs, (cost + linear * take + quadratic * take * take, s))
        if take < -size:
            heapq.heappush(pieces, (size + take, d, at + take))
    return placed


def pack(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", tokenizer: str = "byte_bpe_50k.json",
         capacity: int = CAPACITY, end_id: int = 0, linear: float = 1.0, quadratic: float = 1 / 1024) -> DataFrame:
    """One row per piece: which ids of a document lie where in which sequence, with the piece's estimated cost.

    A null text is empty and consists of the end id alone. Repeated rows are packed as often as they
    occur, a null id stays null, an empty table gives no pieces. Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = encoder(tokenizer), TaskContext.get().partitionId() << 36
        end = np.asarray([end_id], "<u4").tobytes()
        ids: list[int] = []
        tokens: list[bytes] = []
        size = 0

        def packed() -> pa.RecordBatch:
            nonlocal base, size, ids, tokens
            lengths = [len(t) // 4 for t in tokens]
            rows = plan(lengths, capacity, linear, quadratic)
            out = pa.RecordBatch.from_pydict({
                "doc_id": pa.array([ids[d] for d, *_ in rows], pa.int64()),
                "start": [at for _, at, *_ in rows],
                "length": [n for _, _, n, *_ in rows],
                "ids_crc32": [zlib.crc32(tokens[d][4 * at:4 * (at + n)]) for d, at, n, *_ in rows],
                "doc_tokens": [lengths[d] for d, *_ in rows],
                "sequence_id": [base + s for *_, s, _ in rows],
                "offset": [o for *_, o in rows],
                "piece_cost": [linear * n + quadratic * n * n for _, _, n, *_ in rows]})
            base += -(-sum(lengths) // capacity)
            ids, tokens, size = [], [], 0
            return out

        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                ids += part.column(0).to_pylist()
                for encoded in encode(part.column(1).to_pylist()):
                    tokens.append(encoded + end)
                    size += len(encoded) // 4 + 1
                if size >= GROUP_TOKENS:
                    yield packed()
        if ids:
            yield packed()

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    return rows.mapInArrow(run, SCHEMA)
