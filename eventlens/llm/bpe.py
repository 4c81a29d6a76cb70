"""Byte-level BPE encoding and decoding with a fixed rank file.

Each match of the split pattern is merged alone. A segment tree over the byte positions holds, for
every live token, the rank of the pair it forms with its right neighbour; the root is the leftmost
pair of least rank. A merge touches three leaves (the token, the neighbour it swallowed and the
token to its left), so a match of n bytes takes O(n log n) however long it is. A node has WIDTH
children, so that the tree of a usual word is its root and leaves.

Null and empty texts have no tokens; decoding them gives empty bytes. Rows are independent, so ties,
repeated rows and other columns don't matter: results hold the id column and the new columns only.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from eventlens.llm.common import ship

_END = 1 << 62
#: Children of a node of the segment tree.
WIDTH = 16
#: Most distinct matches that a worker keeps encoded, twice.
CACHE = 250_000


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one match: leftmost pair of least rank first, until no pair has a rank."""
    n = len(piece)
    if n < 2:
        return [ranks[piece]] if n else []
    get = ranks.get
    leaves = [_END if (rank := get(piece[i : i + 2])) is None else rank * n + i for i in range(n - 1)]
    levels, above = [leaves], n - 1
    while above > WIDTH:
        low = levels[-1]
        levels.append([min(low[k : k + WIDTH]) for k in range(0, above, WIDTH)])
        above = len(levels[-1])
    root = levels.pop()
    tall = levels + [root] if levels else None
    end = list(range(1, n + 1))
    left = list(range(-1, n - 1))
    while (top := min(root)) < _END:
        i = top % n
        j = end[i]
        end[i] = k = end[j]
        before = left[i]
        if k < n:
            left[k] = i
            rank = get(piece[i : end[k]])
            leaves[i] = _END if rank is None else rank * n + i
            leaves[j] = _END
        else:
            leaves[i] = _END
        if before >= 0:
            rank = get(piece[before:k])
            leaves[before] = _END if rank is None else rank * n + before
        if tall is None:
            continue
        # The leaves stand; from each the way up ends where a node keeps its value.
        for k in (before, i, j):
            if 0 <= k < n - 1:
                for low, high in pairwise(tall):
                    k //= WIDTH
                    least = min(low[k * WIDTH : k * WIDTH + WIDTH])
                    if high[k] == least:
                        break
                    high[k] = least
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder:
    """Encodes texts to packed ids (little-endian unsigned 32-bit) with two bounded generations of cache."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        packed = self.old.get(piece)
        if packed is None:
            raw = piece.encode()
            rank = self.ranks.get(raw)
            ids = [rank] if rank is not None else merge(raw, self.ranks)
            packed = struct.pack(f"<{len(ids)}I", *ids)
        if len(piece) <= 64:
            self.new[piece] = packed
        return packed

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if len(self.new) > CACHE:
            self.old, self.new = self.new, {}
        get, make = self.new.get, self._piece
        return b"".join([get(p) or make(p) for p in self.find(text)])


_ENCODERS: dict[object, Encoder] = {}


def _share(spark: SparkSession, path: str):
    """The ranks reach executors by broadcast: one vocabulary file, whose size doesn't depend on the data."""
    ship(spark)
    return spark.sparkContext.broadcast(load_ranks(path))


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ids (packed little-endian unsigned 32-bit) and n_tokens of every whole text."""
    shared, key = _share(df.sparkSession, path), (path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _ENCODERS:
            _ENCODERS[key] = Encoder(shared.value, pattern)
        coder = _ENCODERS[key]
        for batch in batches:
            ids = [coder.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())],
                [id_col, "ids", "n_tokens"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, n_tokens bigint")


def decode(df: DataFrame, path: str, id_col: str = "doc_id") -> DataFrame:
    """Of rows with packed ids: id, ids, n_tokens and decoded, the bytes the ids stand for. Null ids are empty."""
    shared = _share(df.sparkSession, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = {rank: token for token, rank in shared.value.items()}.__getitem__
        for batch in batches:
            out = [b"".join(map(token, np.frombuffer(x or b"", "<u4").tolist())) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [id_col, "ids", "n_tokens", "decoded"])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, "ids", "n_tokens").mapInArrow(run, f"`{id_col}` {kind}, ids binary, n_tokens bigint, decoded binary")
