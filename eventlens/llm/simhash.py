"""SimHash near-duplicate groups by tiled exact comparison.

Fingerprints: every shingle of n words votes with the bits of its hash (XXH64, further words of 64
bits with the next seeds); a bit is 1 if more than half of the shingles have it. Texts of fewer
words have one shingle, the whole sequence; null texts and those without words have fingerprint zero.

Links: distinct fingerprints are laid out in tiles by their population counts. Tiles are only compared
if their counts allow a distance within the radius: two fingerprints at distance d differ by d at
most in the sum over parts of the differences in population count. A comparison of two tiles is a
numpy exclusive-or and bit count of all their pairs, so no link is lost; from each it hands on a
spanning star of every group it finds, never all pairs of a group. Copies share a fingerprint and
count once.

For near-duplicates (near_duplicates) fingerprints are those of the sets of shingles, and links only propose: a pair within the radius
counts if its exact similarity is high enough.

The work on pairs grows with the square of the distinct fingerprints times the share of tile pairs
left (for 64 bits and radius 3, under a twentieth), as the method has it. Ties: the smallest id names a
group. Repeated rows join their group. An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import cut, lookup, ship
from eventlens.llm.components import connected_components
from eventlens.llm.substring import window_hashes

#: Most fingerprints in a tile, and shingles whose bits are counted at once.
TILE, CHUNK = 4096, 1 << 15
#: Pairs of two tiles that are worked on at once.
CELLS = 1 << 16
#: Most texts of a proposed group, and shingles of theirs (8 bytes each), in a block on average; two blocks are compared in one piece.
BLOCK, HASHES = 512, 1 << 21
SEED = 42


def fingerprint(text: str | bytes | None, n: int = 3, words: int = 1) -> bytes:
    """The big-endian fingerprint of 64 * words bits."""
    tokens = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not tokens:
        return bytes(8 * words)
    joined = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens))) + np.arange(len(tokens))
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(tokens) > n:
        starts, ends = starts[: len(tokens) - n + 1], ends[n - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    total = len(starts)
    out = []
    for seed in range(SEED, SEED + words):
        votes = np.zeros(64, np.int64)
        for at in range(0, total, CHUNK):
            spans = zip(starts[at : at + CHUNK].tolist(), ends[at : at + CHUNK].tolist())
            digests = b"".join([xxhash.xxh64_digest(joined[a:b], seed) for a, b in spans])
            bits = np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64)
            votes += np.add.reduce(bits, axis=0, dtype=np.uint16 if len(bits) < 65536 else np.int64)
        out.append(np.packbits(2 * votes > total).tobytes())
    return b"".join(out)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 3, words: int = 1) -> DataFrame:
    """id and fp0, fp1, ... (signed longs with the fingerprint's bits, highest first) of every whole text."""
    ship(df.sparkSession)
    names = [f"fp{k}" for k in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = b"".join([fingerprint(t, n, words) for t in batch.column(1).to_pylist()])
            table = np.frombuffer(made, ">i8").astype(np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(table[:, k]) for k in range(words))], [id_col, *names])

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(id_col, F.encode(F.col(text_col), "UTF-8").alias("text"))
    return source.mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{x} bigint" for x in names))


def star(near: np.ndarray) -> list[tuple[int, int]]:
    """Of a boolean matrix of links (rows, columns): (root, member) edges that span its groups; columns count on after rows."""
    rows, cols = near.shape
    has_r, has_c = np.flatnonzero(near.any(axis=1)), np.flatnonzero(near.any(axis=0))
    near = near[np.ix_(has_r, has_c)]
    big = np.int32(rows + cols)
    label = has_r.astype(np.int32)
    step = max(1, CELLS // max(1, len(has_c)))
    while True:
        # Labels go from rows to columns and back, some rows of the matrix at a time.
        at_c, at_r = np.full(len(has_c), big), label.copy()
        for at in range(0, len(has_r), step):
            np.minimum(at_c, np.where(near[at : at + step], label[at : at + step, None], big).min(axis=0), out=at_c)
        for at in range(0, len(has_r), step):
            at_r[at : at + step] = np.where(near[at : at + step], at_c[None, :], big).min(axis=1)
        if (at_r == label).all():
            break
        label = at_r
    pairs = [(int(a), int(b)) for a, b in zip(label, has_r) if a != b]
    return pairs + [(int(a), rows + int(b)) for a, b in zip(at_c, has_c)]


def compare(a: np.ndarray, b: np.ndarray, radius: int, sizes: tuple[np.ndarray, np.ndarray, float] | None = None) -> np.ndarray | None:
    """Which of a's fingerprints (n, words) are within radius of which of b's; None if none are.

    sizes: the sizes of a's and b's sets and the similarity that they must allow. Only bits of the answer are held for all
    pairs, all else for CELLS pairs at a time.
    """
    near = np.zeros((len(a), len(b)), np.bool_)
    step = max(1, CELLS // max(1, len(b)))
    for at in range(0, len(a), step):
        part = a[at : at + step]
        apart = np.bitwise_count(part[:, None, 0] ^ b[None, :, 0])
        for k in range(1, a.shape[1]):
            apart += np.bitwise_count(part[:, None, k] ^ b[None, :, k])
        found = apart <= radius
        if sizes and found.any():
            found &= alike(sizes[0][at : at + step, None], sizes[1][None, :], sizes[2])
        near[at : at + step] = found
    return near if near.any() else None


def alike(a: np.ndarray, b: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets of these sizes can be that similar."""
    return np.minimum(a, b) >= similarity * np.maximum(a, b)


def links(distinct: DataFrame, radius: int, words: int = 1, similarity: float | None = None) -> DataFrame:
    """(u, v) edges between ids of distinct fingerprints (fid, fp0, ...) that span every linked group.

    similarity: distinct also has size, the number of shingles, and pairs whose sizes rule that similarity out don't link. Tiles
    are then of like size as well, and those of sizes too far apart aren't compared.
    """
    ship(distinct.sparkSession)
    names = [f"fp{k}" for k in range(words)]
    held = [*names, "size"] if similarity else names
    parts = 4 if radius <= 3 and words == 1 else 1
    width = 1 if parts == 4 else radius + 1
    if parts == 4:
        counts = [F.bit_count(F.shiftrightunsigned("fp0", s).bitwiseAND(0xFFFF)) for s in (48, 32, 16, 0)]
    else:
        counts = [sum((F.bit_count(c) for c in names[1:]), F.bit_count(names[0]))]
    base = 64 * words + 2 * radius + 2
    reach = radius if parts == 4 else 1
    near = [o for o in itertools.product(range(-reach, reach + 1), repeat=parts) if sum(map(abs, o)) <= reach and o >= (0,) * parts]
    shifts = [sum(x * base**k for k, x in enumerate(reversed(o))) for o in near]

    key = sum((F.floor(c / width).cast("long") * base**k for k, c in enumerate(reversed(counts))), F.lit(0).cast("long"))
    if similarity:
        # Sizes in one class or in neighbouring ones may be within the ratio; a class is one step of a further digit of the key.
        key = key + F.floor(F.log(F.greatest("size", F.lit(1))) / log(1 / similarity)).cast("long") * base ** len(counts)
        shifts = sorted({s + t * base ** len(counts) for s in {s * sign for s in shifts for sign in (1, -1)} for t in (0, 1) if t or s >= 0})
    keyed = distinct.where("fid is not null").select("fid", *held, key.alias("key"))
    sizes = keyed.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("chunks"))
    # Keys are tuples of population counts: at most 17 ** 4 or a few dozen rows, whatever the data.
    tiles = cut(
        keyed.join(F.broadcast(sizes), "key")
        .withColumn("chunk", F.pmod(F.xxhash64("fid"), F.col("chunks")))
        .groupBy("key", "chunk")
        .agg(F.collect_list(F.struct("fid", *held)).alias("members"))
    )
    other = tiles.select(F.explode(F.array(*(F.lit(s) for s in shifts))).alias("shift"), F.col("key").alias("key2"), F.col("chunk").alias("chunk2"), F.col("members").alias("others"))
    other = other.select((F.col("key2") + F.col("shift")).alias("key"), "key2", "shift", "chunk2", "others")
    met = "shift <> 0 or chunk <= chunk2"
    if parts == 1:
        # Few keys, many tiles each: pair the names of tiles, then fetch the tiles by name, so that pairs spread over tasks.
        names2 = tiles.select("key", "chunk").join(other.select("key", "key2", "shift", "chunk2"), "key").where(met).drop("shift")
        second = tiles.select(F.col("key").alias("key2"), F.col("chunk").alias("chunk2"), F.col("members").alias("others"))
        # Tiles grow with the data: merge joins, so that they are never collected for a broadcast.
        pairs = names2.join(tiles.hint("merge"), ["key", "chunk"]).join(second.hint("merge"), ["key2", "chunk2"]).select("members", "others")
    else:
        pairs = tiles.join(other, "key").where(met).select("members", "others")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (0, 1):
                lists = batch.column(c)
                inner = lists.values
                cols = [inner.field(k).to_numpy(zero_copy_only=False) for k in range(len(held) + 1)]
                sides.append((lists.offsets.to_numpy(), cols[0], np.stack(cols[1 : words + 1], axis=1).view(np.uint64), cols[-1]))
            us, vs = [], []
            for r in range(batch.num_rows):
                (oa, ia, fa, na), (ob, ib, fb, nb) = sides
                a, b = slice(oa[r], oa[r + 1]), slice(ob[r], ob[r + 1])
                found = compare(fa[a], fb[b], radius, (na[a], nb[b], similarity) if similarity else None)
                if found is not None:
                    ids = np.concatenate((ia[a], ib[b]))
                    for x, y in star(found):
                        if ids[x] != ids[y]:
                            us.append(int(ids[x]))
                            vs.append(int(ids[y]))
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    return pairs.mapInArrow(run, "u bigint, v bigint")


def near_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, words: int = 2, radius: int = 26) -> DataFrame:
    """id, fp0, ... and component_id, the smallest id that links lead to, of every row. Links are by fingerprint alone."""
    names = [f"fp{k}" for k in range(words)]
    prints = cut(fingerprints(df, id_col, text_col, n, words))
    distinct = cut(prints.groupBy(*names).agg(F.min(id_col).alias("fid")))
    labels = connected_components(links(distinct, radius, words))
    grouped = distinct.join(labels, distinct.fid == labels.node, "left").select(*names, F.coalesce("label", "fid").alias("component_id"))
    return lookup(prints, cut(grouped), names).select(id_col, *names, "component_id")


def shingles(text: str | bytes | None, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles of n words; fewer words are one shingle."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(window_hashes(words, n) if len(words) >= n else window_hashes([b" ".join(words)], 1))


def set_fingerprint(shingle: np.ndarray, words: int) -> bytes:
    """The big-endian fingerprint of a set of shingle hashes: each distinct shingle votes once, as similarity counts it once."""
    if not len(shingle):
        return bytes(8 * words)
    out, h = [], shingle
    for _ in range(words):
        votes = np.zeros(64, np.int64)
        for at in range(0, len(h), CHUNK):
            votes += np.unpackbits(h[at : at + CHUNK].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
        out.append(np.packbits(2 * votes > len(h)).tobytes())
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return b"".join(out)


def similarity_of(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets; of two empty ones 1."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int(np.count_nonzero(b[at] == a))
    return both / (len(a) + len(b) - both)


def confirm(prints: np.ndarray, sets: list[np.ndarray], first: int, radius: int, similarity: float) -> list[tuple[int, int]]:
    """Edges that span the groups of similar texts among those within radius, found by exact similarity.

    Texts up to `first` are compared with those from there on (first = 0: all with all). The nearest fingerprints come first; a pair that
    is already linked through confirmed ones isn't looked at.
    """
    n = len(sets)
    apart = sum(np.bitwise_count(prints[:, None, k] ^ prints[None, :, k]).astype(np.int16) for k in range(prints.shape[1]))
    size = np.array([len(x) for x in sets])
    wanted = np.triu((apart <= radius) & alike(size[:, None], size[None, :], similarity), 1)
    if first:
        wanted[:first, :first] = wanted[first:, :] = False
    us, vs = np.nonzero(wanted)
    order = np.argsort(apart[us, vs], kind="stable")
    top = list(range(n))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    out = []
    for u, v in zip(us[order].tolist(), vs[order].tolist()):
        a, b = find(u), find(v)
        if a != b and similarity_of(sets[u], sets[v]) >= similarity:
            top[b] = a
            out.append((u, v))
    return out


def similar_sets(df: DataFrame, id_col: str, text_col: str, n: int, words: int, radius: int, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(id and digest of every row; digest, id, component of every distinct set of shingles, id its smallest).

    Fingerprints within radius, of sets of like size, propose, exact similarity decides: the texts of each proposed group, in blocks of about BLOCK texts or HASHES shingles, are
    fetched as sets of shingle hashes, and every proposed pair of two blocks is confirmed unless confirmed ones link it already. Only
    texts in proposed groups travel a second time.
    """
    ship(df.sparkSession)
    names = [f"fp{k}" for k in range(words)]
    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col).alias("id"), F.encode(F.col(text_col), "UTF-8").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, digest, size = [], [], []
            for text in batch.column(1).to_pylist():
                h = shingles(text, n)
                raw.append(set_fingerprint(h, words))
                digest.append(xxhash.xxh3_128_digest(h.tobytes()))
                size.append(len(h))
            made = np.frombuffer(b"".join(raw), ">i8").astype(np.int64).reshape(-1, words)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), *(pa.array(made[:, k]) for k in range(words))], ["id", "digest", "size", *names])

    prints = cut(source.mapInArrow(run, f"id {kind}, digest binary, size bigint, " + ", ".join(f"{x} bigint" for x in names)))
    distinct = prints.groupBy("digest").agg(F.min("id").alias("id"), F.min("size").alias("size"), F.min(F.struct(*names)).alias("fp"))
    distinct = cut(distinct.select("digest", "id", "size", *(F.col(f"fp.{x}").alias(x) for x in names)).withColumn("fid", F.monotonically_increasing_id()))
    proposed = connected_components(links(distinct, radius, words, similarity))

    proposed = cut(proposed.join(distinct.hint("merge"), F.col("node") == F.col("fid")).drop("node"))
    sizes = proposed.groupBy("label").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK, F.sum("size") / HASHES)).alias("chunks"))
    members = lookup(proposed, cut(sizes), "label")
    members = cut(members.select("id", "digest", "fid", *names, "label", "chunks", F.pmod(F.xxhash64("fid"), F.col("chunks")).alias("chunk")))
    # These tables grow with the data: merge joins, so that none is collected for a broadcast.
    fetched = source.join(members.hint("merge"), "id").select("text", "digest", "fid", *names, "label", "chunks", "chunk")

    def as_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, n).tobytes() for t in batch.column(0).to_pylist()]
            right = [xxhash.xxh3_128_digest(s) == d for s, d in zip(sets, batch.column(1).to_pylist())]  # another text of a repeated id
            made = pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(sets, pa.binary())], [*batch.schema.names[2:], "members"])
            yield made.filter(pa.array(right, pa.bool_()))

    ddl = "fid bigint, " + ", ".join(f"{x} bigint" for x in names) + ", label bigint, chunks bigint, chunk bigint, members binary"
    once = fetched.mapInArrow(as_sets, ddl).groupBy("label", "chunks", "chunk", "fid").agg(F.first(F.struct("fid", *names, "members")).alias("one"))
    blocks = cut(once.groupBy("label", "chunks", "chunk").agg(F.collect_list("one").alias("members")))
    many = blocks.where("chunks > 1").select("label", "chunk", "members")
    pair = many.select("label", "chunk").join(many.select("label", F.col("chunk").alias("chunk2")), "label").where("chunk < chunk2")
    second = many.select("label", F.col("chunk").alias("chunk2"), F.col("members").alias("others"))
    apart = pair.join(many.hint("merge"), ["label", "chunk"]).join(second.hint("merge"), ["label", "chunk2"]).select("members", "others")
    nothing = F.array().cast(blocks.schema["members"].dataType)
    work = blocks.select("members", nothing.alias("others")).unionByName(apart)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            us, vs = [], []
            for a, b in zip(batch.column(0), batch.column(1)):
                rows = [*a.as_py(), *b.as_py()]
                fps = np.array([[r[x] for x in names] for r in rows], np.int64).view(np.uint64)
                sets = [np.frombuffer(r["members"], np.uint64) for r in rows]
                for u, v in confirm(fps, sets, len(a) if len(b) else 0, radius, similarity):
                    us.append(rows[u]["fid"])
                    vs.append(rows[v]["fid"])
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    labels = connected_components(work.mapInArrow(check, "u bigint, v bigint"))
    grouped = distinct.join(labels.hint("merge"), distinct.fid == labels.node, "left").select("digest", "id", F.coalesce("label", "fid").alias("component"))
    return prints.select("id", "digest"), grouped


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, words: int = 2, radius: int = 28, similarity: float = 0.8) -> DataFrame:
    """id and component_id (the smallest id of its group) of every row; groups are joined by exact similarity of shingles.

    A SimHash of b bits has cos(pi * d / b) as its estimate of the cosine; two sets of equal size and similarity 0.8 have a
    cosine of 0.889, 19 of 128 bits with a deviation of 4, so a radius of 28 is 2.2 deviations beyond; much more would chain unrelated texts into large proposed groups.
    """
    prints, grouped = similar_sets(df, id_col, text_col, n, words, radius, similarity)
    least = cut(grouped.groupBy("component").agg(F.min("id").alias("component_id")))
    named = lookup(grouped.select("digest", "component"), least, "component").select("digest", "component_id")
    return lookup(prints, cut(named), "digest").select(F.col("id").alias(id_col), "component_id")


def first_rows(df: DataFrame, id_col: str, text_col: str = "text", n: int = 5, words: int = 2, radius: int = 28, similarity: float = 0.8) -> DataFrame:
    """The smallest id of every group of near_duplicates, one row a group; ids may be of any type that has an order, such as structs."""
    _, grouped = similar_sets(df, id_col, text_col, n, words, radius, similarity)
    return grouped.groupBy("component").agg(F.min("id").alias(id_col)).select(id_col)
