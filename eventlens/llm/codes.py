"""Vector code compression: one codebook a part position, nearest entries found in kd-trees.

Components become integers floor(SCALE * x); a vector is cut into PARTS equal parts. The codebook of each position starts as that part of the ENTRIES vectors
of smallest id (ties: smaller vector; null ids last). A round broadcasts a kd-tree a codebook, assigns every part to its nearest entry and replaces
each entry that has parts by the floor of their mean; finally all parts are assigned once more. A vector's code is its entries' numbers.

A tree's nodes have boxes of whole numbers. A search first goes down to the leaf that a part falls into, then visits the tree from its root and
leaves out nodes whose box is farther than the best so far; boxes that are just as far are visited, so of equally near entries the lowest number
wins, as in a comparison with all entries. A whole piece of rows is searched together, node by node, in exact integers.

Tasks hand back counts and sums per entry (PARTS * ENTRIES rows times the part's width, whatever they read), which Spark adds up; the driver sees those sums and the codebooks.

Rows whose vector is null or holds a null or non-finite component are left out. All vectors have the length that most kept vectors have (ties: the shorter one) and
that PARTS divides; others are left out too, as their parts have no codebook. With fewer than ENTRIES vectors codebooks have fewer entries; an empty table gives no rows. Rows with a
repeated id are judged one by one. Scaled components beyond 2^62 count as 2^62; what is too large for exact longs is compared in Python's integers, and
an error or sum beyond a long is the largest long. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import cut, lookup, ship
from eventlens.llm.vectors import LONG, Sums, finite, limit, long_sum, matrices, pairwise, quoted, scaled, total

#: Parts of a vector, entries of a codebook, rounds, scale of the components; entries in a leaf.
PARTS, ENTRIES, ROUNDS, SCALE, LEAF = 16, 64, 2, 256, 4

Codebooks = list[list[list[int]]]


class Tree:
    """A kd-tree over a codebook's entries. dims: components of a whole vector, whose distances must fit a long."""

    def __init__(self, entries: list[list[int]], dims: int):
        self.points = np.array(entries, np.int64)
        self.wide = int(np.abs(self.points).max()) > limit(dims) if self.points.size else False
        self.safe = limit(dims)
        self.low: list[np.ndarray] = []
        self.high: list[np.ndarray] = []
        self.axis: list[int] = []
        self.value: list[int] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.leaf: list[np.ndarray | None] = []
        self._build(np.arange(len(self.points)))
        self._axis, self._value = np.array(self.axis), np.array(self.value, np.int64)
        self._left, self._right = np.array(self.left), np.array(self.right)

    def _build(self, own: np.ndarray) -> int:
        """Adds the node of these entries (ascending numbers) and all below it."""
        node, p = len(self.axis), self.points[own]
        low, high = p.min(axis=0), p.max(axis=0)
        for store, x in ((self.low, low), (self.high, high), (self.axis, 0), (self.value, 0), (self.left, node), (self.right, node), (self.leaf, own)):
            store.append(x)
        if len(own) <= LEAF or (low == high).all():
            return node
        # Halves of the axis with the widest range (ranges as Python integers, which can't overflow); equal values stay on the left.
        axis = max(range(p.shape[1]), key=lambda a: int(high[a]) - int(low[a]))
        value = int(np.sort(p[:, axis])[(len(own) - 1) // 2])
        if value == high[axis]:
            value = int(p[p[:, axis] < value, axis].max())
        below = p[:, axis] <= value
        self.axis[node], self.value[node], self.leaf[node] = axis, value, None
        self.left[node] = self._build(own[below])
        self.right[node] = self._build(own[~below])
        return node

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lowest-numbered nearest entry of every row and its squared distance."""
        if self.wide or (q.size and int(np.abs(q).max()) > self.safe):
            d = pairwise(q.astype(object), self.points.astype(object))
            at = np.argmin(d, axis=1).astype(np.int64)
            return at, d[np.arange(len(q)), at]
        best, at = np.full(len(q), LONG, np.int64), np.full(len(q), len(self.points), np.int64)
        node = np.zeros(len(q), np.int64)
        while True:
            down = np.where(q[np.arange(len(q)), self._axis[node]] <= self._value[node], self._left[node], self._right[node])
            if (down == node).all():
                break
            node = down

        def consider(leaf: int, rows: np.ndarray) -> None:
            own = self.leaf[leaf]
            d = ((q[rows, None, :] - self.points[own]) ** 2).sum(axis=2)
            k = d.argmin(axis=1)
            d, k = d[np.arange(len(rows)), k], own[k]
            better = (d < best[rows]) | ((d == best[rows]) & (k < at[rows]))
            best[rows[better]], at[rows[better]] = d[better], k[better]

        def visit(n: int, rows: np.ndarray) -> None:
            x = q[rows]
            far = np.maximum(np.maximum(self.low[n] - x, x - self.high[n]), 0)
            rows = rows[(far * far).sum(axis=1) <= best[rows]]
            if self.leaf[n] is not None:
                rows = rows[node[rows] != n]
                if len(rows):
                    consider(n, rows)
            elif len(rows):
                visit(self.left[n], rows)
                visit(self.right[n], rows)

        for n in np.unique(node):
            consider(int(n), np.flatnonzero(node == n))
        visit(0, np.arange(len(q)))
        return at, best


def vectors(df: DataFrame, parts: int = PARTS, id_col: str = "vec_id", vec_col: str = "embedding", keep: list[str] | None = None) -> tuple[DataFrame, int]:
    """id, v and the kept columns of the rows that are coded, and their length (0: none)."""
    rows = finite(df.select(quoted(id_col).alias("id"), quoted(vec_col).alias("v"), *(quoted(c).alias(f"keep_{k}") for k, c in enumerate(keep or []))), "v")
    sizes = rows.where((F.size("v") > 0) & (F.size("v") % parts == 0)).groupBy(F.size("v").alias("dims")).count()
    first = sizes.orderBy(F.desc("count"), "dims").first()
    dims = first.dims if first else 0
    return rows.where(F.size("v") == dims) if dims else rows.where("false"), dims


def first_codebooks(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> Codebooks:
    """The parts of the vectors of smallest id: a top-k per task, so no more than `entries` rows reach the driver."""
    top = rows.select("id", "v").orderBy(F.asc_nulls_last("id"), "v").limit(entries).collect()
    width = dims // parts
    whole = [scaled(np.array(r.v, np.float64), scale).tolist() for r in top]
    return [[v[p * width : (p + 1) * width] for v in whole] for p in range(parts)] if whole else []


def improve(rows: DataFrame, books: Codebooks, scale: int = SCALE) -> Codebooks:
    """One round: the floor of the mean of each entry's parts; an entry without parts stays."""
    if not books:
        return []
    parts, entries, width = len(books), len(books[0]), len(books[0][0])
    shared = rows.sparkSession.sparkContext.broadcast([Tree(b, parts * width) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, sums = shared.value, Sums(parts * entries, width)
        for batch in batches:
            for _, x in matrices(batch.column(0), parts * width, scale):
                for p, tree in enumerate(trees):
                    q = x[:, p * width : (p + 1) * width]
                    sums.add(q, p * entries + tree.nearest(q)[0])
        own = np.flatnonzero(sums.n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a) for a in (np.repeat(own, width), np.tile(np.arange(width), len(own)), np.repeat(sums.n[own], width), sums.high[own].ravel(), sums.low[own].ravel())],
            ["entry", "place", "n", "high", "low"],
        )

    sums = rows.select("v").mapInArrow(run, "entry long, place long, n long, high long, low long")
    new = [[list(e) for e in b] for b in books]
    for r in sums.groupBy("entry", "place").agg(total("n"), total("high"), total("low")).collect():
        new[r.entry // entries][r.entry % entries][r.place] = ((int(r.high) << 32) + int(r.low)) // int(r.n)
    return new


def fit(rows: DataFrame, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> Codebooks:
    """The codebooks after all rounds, of vectors()."""
    ship(rows.sparkSession)
    books = first_codebooks(rows, dims, parts, entries, scale)
    for _ in range(rounds):
        books = improve(rows, books, scale)
    return books


def encode(rows: DataFrame, books: Codebooks, scale: int = SCALE) -> DataFrame:
    """The rows of vectors() with codes (the entries' numbers by part) and error (squared distance) instead of v."""
    ship(rows.sparkSession)
    rest = [f for f in rows.schema.fields if f.name != "v"]
    kind = T.StructType([*rest, T.StructField("codes", T.ArrayType(T.IntegerType())), T.StructField("error", T.LongType())])
    if not books:
        return rows.sparkSession.createDataFrame([], kind)
    parts, width, names = len(books), len(books[0][0]), kind.fieldNames()
    shared = rows.sparkSession.sparkContext.broadcast([Tree(b, parts * width) for b in books])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = shared.value
        for batch in batches:
            for at, x in matrices(batch.column(len(rest)), parts * width, scale):
                found = [tree.nearest(x[:, p * width : (p + 1) * width]) for p, tree in enumerate(trees)]
                error = sum(d for _, d in found)
                error = np.minimum(error, LONG).astype(np.int64) if error.dtype == object else error
                flat = pa.array(np.stack([k for k, _ in found], axis=1).astype(np.int32).ravel())
                codes = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * parts + 1, parts, dtype=np.int32)), flat)
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(at, len(x)) for k in range(len(rest))), codes, pa.array(error)], names)

    return rows.select(*(f.name for f in rest), "v").mapInArrow(run, kind)


def decode(codes: list[int], books: Codebooks, scale: int = SCALE) -> list[float]:
    """The vector that a code stands for: the lower corners of its entries' cells."""
    return [x / scale for p, k in enumerate(codes) for x in books[p][k]]


def digest(books: Codebooks) -> str:
    """SHA-256 of all entries' components as decimal text, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def compress(df: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, Codebooks]:
    """id, codes, error, label_error (errors summed over rows of equal label, nulls together) of every coded vector; and the codebooks."""
    rows, dims = vectors(df, parts, id_col, vec_col, [label_col])
    books = fit(rows, dims, parts, entries, rounds, scale) if dims else []
    # Labels are met as text, so that nulls have a key of their own.
    key = F.when(F.col("keep_0").isNull(), "").otherwise(F.concat(F.lit("="), F.col("keep_0").cast("string")))
    coded = cut(encode(rows, books, scale).withColumn("key", key).drop("keep_0"))
    sums = coded.groupBy("key").agg(long_sum("error").alias("label_error"))
    return lookup(coded, cut(sums), "key").select(F.col("id").alias(id_col), "codes", "error", "label_error"), books
