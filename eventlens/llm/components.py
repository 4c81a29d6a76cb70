"""Connected components by contraction, as joins and aggregates between rounds and as stars within a task."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import cut, lookup, ship

#: Edges that a task contracts at a time; so many or fewer in all are finished by one task.
HELD = 1 << 17


def _ranked(node: str) -> Column:
    """Nodes in a scattered order, so that a chain in order of id isn't followed link by link."""
    return F.struct(F.xxhash64(node).alias("rank"), F.col(node).alias("node"))


def stars(edges: list[tuple[int, int, int, int]]) -> list[tuple[int, int]]:
    """(first, member) edges that join the same nodes as edges (u, v, rank of u, rank of v); first is the least of its group by (rank, node)."""
    top: dict[int, int] = {}
    rank: dict[int, int] = {}

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    for u, v, ru, rv in edges:
        rank[u], rank[v] = ru, rv
        a, b = find(top.setdefault(u, u)), find(top.setdefault(v, v))
        if a != b:
            a, b = sorted((a, b), key=lambda x: (rank[x], x))
            top[b] = a
    return [(find(x), x) for x in top if top[x] != x]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that join the same nodes: every HELD edges of a task become stars, so that fewer rounds are needed."""
    ship(edges.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, int, int]] = []

        def flush() -> pa.RecordBatch:
            made = stars(held)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([e[k] for e in made], pa.int64()) for k in (0, 1)], ["u", "v"])

        for batch in batches:
            held.extend(zip(*(c.to_pylist() for c in batch.columns)))
            if len(held) >= HELD:
                yield flush()
        if held:
            yield flush()

    ranked = edges.select("u", "v", F.xxhash64("u").alias("ru"), F.xxhash64("v").alias("rv"))
    return ranked.mapInArrow(run, "u bigint, v bigint")


def connected_components(edges: DataFrame) -> DataFrame:
    """node, label (the least node of its component) for every node of edges (u, v), both longs.

    Every task contracts the edges it holds, in pieces of a fixed size, to stars around their first nodes. While more than HELD
    edges are left, a round moves every node to its first neighbour's first neighbour (by rank, itself included); edges follow, loops
    go and tasks contract again. Nodes that come before all their neighbours stay, so each component ends as one of its nodes. As the
    order is scattered, a round leaves a fraction of the nodes and rounds grow with the logarithm of their number. The last edges, HELD
    at most, become stars in one task. What moved in each round is kept and composed at the end. Loops, repeated edges and an
    empty table are fine.
    """
    live = cut(contracted(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u <> v").distinct()))
    left = live.count()
    if not left:
        return live.select(F.col("u").alias("node"), F.col("v").alias("label"))
    moves = []
    while left > HELD:
        both = live.unionByName(live.select(F.col("v").alias("u"), F.col("u").alias("v")))
        step = both.groupBy("u").agg(F.min(_ranked("v")).alias("m")).select(F.col("u").alias("node"), F.least(_ranked("u"), F.col("m"))["node"].alias("to"))
        step = cut(step)
        step = cut(step.join(step.select(F.col("node").alias("to"), F.col("to").alias("further")), "to").select("node", F.col("further").alias("to")))
        moves.append(step)
        at = step.select(F.col("node").alias("u"), F.col("to").alias("u2"))
        bt = step.select(F.col("node").alias("v"), F.col("to").alias("v2"))
        moved = live.join(at, "u").join(bt, "v").where("u2 <> v2").select(F.col("u2").alias("u"), F.col("v2").alias("v")).distinct()
        live = cut(contracted(moved))
        left = live.count()
    if left:
        ends = contracted(live.repartition(1))
        moves.append(cut(ends.select(F.explode(F.array(F.struct(F.col("v").alias("node"), F.col("u").alias("to")), F.struct(F.col("u").alias("node"), F.col("u").alias("to")))).alias("m")).select("m.*").distinct()))
    labels = moves[0].select("node", F.col("to").alias("label"))
    for step in moves[1:]:
        labels = labels.join(step.select(F.col("node").alias("label"), "to"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    labels = cut(labels)
    least = cut(labels.groupBy("label").agg(F.min("node").alias("least")))
    return lookup(labels, least, "label").select("node", F.col("least").alias("label"))
