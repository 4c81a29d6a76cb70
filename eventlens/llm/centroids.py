"""Centroid clustering of integer vectors: float32 screening with error intervals, exact integers where they overlap.

Vectors of exactly DIMS finite components become integers floor(SCALE * x). The first K centroids are the vectors whose
`seed:<id>` has the smallest hex SHA-256 (ties: smaller id, then smaller vector). A round assigns every vector to its nearest centroid and
moves each centroid that has vectors to the floor of their mean; then vectors are assigned once more.

Nearest centroids come from one float32 matrix product for a piece of rows. |c|^2 - 2 x.c orders the centroids of a row as their distances
do. The product's error is at most g |x| |c|, with g = m u / (1 - m u), u = 2^-24 and m the components and a few more roundings, in whatever order the
terms are added. So each centroid has an interval that holds its true value; those whose interval reaches below the least upper end
are the shortlist. A shortlist of one decides; longer ones are compared in whole numbers, the lower number winning ties.

Tasks hand back counts and sums per centroid (K * DIMS rows a task whatever they read), which Spark adds up exactly; the driver sees
K * DIMS sums and K centroids.

Rows whose vector is null, of another length, or with a null or non-finite component are left out. A null id counts after all others when the first
centroids are chosen. With fewer than K vectors there are fewer centroids; an empty table gives no rows. Rows with a repeated id are judged one by one. Scaled components beyond
2^62 count as 2^62; rows with components too large for exact longs are compared in Python's integers, and a distance or sum beyond a long is
the largest long. Only the id and the vector are read, so other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import cut, ship
from eventlens.llm.vectors import LONG, Sums, finite, limit, long_sum, matrices, pairwise, quoted, scaled, total

#: Centroids, rounds, scale of the components, their number.
K, ROUNDS, SCALE, DIMS = 16, 3, 64, 64
_U = 2.0**-24


class Screen:
    """Nearest of a few centroids."""

    def __init__(self, centroids: list[list[int]]):
        self.c = np.array(centroids, np.int64).reshape(len(centroids), -1)
        self.wide = bool(self.c.size) and int(np.abs(self.c).max()) > limit(self.c.shape[1])
        self.c32 = self.c.astype(np.float32).T.copy()
        f = self.c.astype(np.float64)
        self.square = (f * f).sum(axis=1)
        self.norm = np.sqrt(self.square) * (1 + 1e-9)

    def shortlist(self, x: np.ndarray) -> np.ndarray:
        """Which centroids may be the nearest, by row. Components are within limit()."""
        f = x.astype(np.float64)
        m = (x.shape[1] + 4) * _U
        dot = (x.astype(np.float32) @ self.c32).astype(np.float64)
        # Twice the product's error, and the roundings of the doubles around it.
        error = 2 * (m / (1 - m)) * (np.sqrt((f * f).sum(axis=1)) * (1 + 1e-9))[:, None] * self.norm
        error += 1e-14 * (self.square + 2 * np.abs(dot)) + 1e-14 * error
        value = self.square - 2 * dot
        return value - error <= (value + error).min(axis=1)[:, None]

    def nearest(self, x: np.ndarray) -> np.ndarray:
        """The lowest-numbered nearest centroid of every row."""
        out = np.zeros(len(x), np.int64)
        if not len(x):
            return out
        big = np.abs(x).max(axis=1) > limit(x.shape[1]) if not self.wide else np.ones(len(x), bool)
        for rows in np.array_split(np.flatnonzero(big), max(1, int(big.sum()) // 1024)):
            if len(rows):
                out[rows] = np.argmin(pairwise(x[rows], self.c), axis=1)
        rest = np.flatnonzero(~big)
        if len(rest):
            may = self.shortlist(x[rest])
            out[rest] = may.argmax(axis=1)
            open_ = np.flatnonzero(may.sum(axis=1) > 1)
            if len(open_):
                at, who = np.nonzero(may[open_])
                d = ((x[rest[open_[at]]] - self.c[who]) ** 2).sum(axis=1)
                first = np.searchsorted(at, np.arange(len(open_)))
                hit = np.flatnonzero(d == np.minimum.reduceat(d, first)[at])
                out[rest[open_]] = who[hit[np.searchsorted(at[hit], np.arange(len(open_)))]]
        return out

    def distance(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Exact squared distance of every row to its centroid, at most a long."""
        c = self.c[own]
        if len(x) and max(int(np.abs(x).max()), int(np.abs(c).max())) > limit(x.shape[1]):
            d = ((x.astype(object) - c.astype(object)) ** 2).sum(axis=1)
            return np.minimum(d, LONG).astype(np.int64)
        return ((x - c) ** 2).sum(axis=1)


def vectors(df: DataFrame, dims: int = DIMS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and v of the rows that are clustered."""
    kept = finite(df.select(quoted(id_col).alias("id"), quoted(vec_col).alias("v")), "v")
    return kept.where(F.size("v") == dims)


def first_centroids(rows: DataFrame, k: int = K, seed: int = 1, scale: int = SCALE) -> list[list[int]]:
    """The k vectors of smallest hash: a top-k per task, k rows reach the driver."""
    key = F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), "UTF-8"), 256)
    top = rows.orderBy(F.asc_nulls_last(key), "id", "v").limit(k).collect()
    return [scaled(np.array(r.v, np.float64), scale).tolist() for r in top]


def move(rows: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> list[list[int]]:
    """One round: the floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    if not centroids:
        return []
    k, dims = len(centroids), len(centroids[0])
    shared = rows.sparkSession.sparkContext.broadcast(Screen(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen, sums = shared.value, Sums(k, dims)
        for batch in batches:
            for _, x in matrices(batch.column(0), dims, scale):
                sums.add(x, screen.nearest(x))
        own = np.flatnonzero(sums.n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(a) for a in (np.repeat(own, dims), np.tile(np.arange(dims), len(own)), np.repeat(sums.n[own], dims), sums.high[own].ravel(), sums.low[own].ravel())],
            ["cluster", "place", "n", "high", "low"],
        )

    parts = rows.select("v").mapInArrow(run, "cluster long, place long, n long, high long, low long")
    moved = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "place").agg(total("n"), total("high"), total("low")).collect():
        moved[r.cluster][r.place] = ((int(r.high) << 32) + int(r.low)) // int(r.n)
    return moved


def fit(rows: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 1, scale: int = SCALE) -> list[list[int]]:
    """The centroids after all rounds, of vectors()."""
    ship(rows.sparkSession)
    centroids = first_centroids(rows, k, seed, scale)
    for _ in range(rounds):
        centroids = move(rows, centroids, scale)
    return centroids


def assign(rows: DataFrame, centroids: list[list[int]], scale: int = SCALE) -> DataFrame:
    """id, cluster, distance of vectors()."""
    ship(rows.sparkSession)
    kind = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("cluster", T.IntegerType()), T.StructField("distance", T.LongType())])
    if not centroids:
        return rows.sparkSession.createDataFrame([], kind)
    dims = len(centroids[0])
    shared = rows.sparkSession.sparkContext.broadcast(Screen(centroids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = shared.value
        for batch in batches:
            for at, x in matrices(batch.column(1), dims, scale):
                own = screen.nearest(x)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(x)), pa.array(own.astype(np.int32)), pa.array(screen.distance(x, own))], ["id", "cluster", "distance"])

    return rows.select("id", "v").mapInArrow(run, kind)


def cluster(df: DataFrame, k: int = K, rounds: int = ROUNDS, seed: int = 1, scale: int = SCALE, dims: int = DIMS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id, cluster, distance, cluster_inertia, inertia, centroid (its components as text, comma-joined) and centroid_sha256 of every vector that is clustered."""
    rows = vectors(df, dims, id_col, vec_col)
    centroids = fit(rows, k, rounds, seed, scale)
    found = cut(assign(rows, centroids, scale))
    per = {r.cluster: r.s for r in found.groupBy("cluster").agg(long_sum("distance").alias("s")).collect()}
    inertia, texts = min(LONG, sum(per.values())), [",".join(map(str, c)) for c in centroids]
    small = [(n, s, inertia, texts[n], hashlib.sha256(texts[n].encode()).hexdigest()) for n, s in sorted(per.items())]
    book = df.sparkSession.createDataFrame(small, "cluster int, cluster_inertia long, inertia long, centroid string, centroid_sha256 string")
    return found.join(F.broadcast(book), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")
