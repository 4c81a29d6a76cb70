"""Quality by nearest labelled examples: exact cosines of latent-semantic vectors, votes weighted by similarity.

Terms are words (lower-cased runs of letters and digits), the shapes of tokens (letters, capitals and digits each as one mark, runs collapsed) and
marks for words that follow themselves and for lines that are repeated, by their share of the text. Terms are hashed into TERMS places.
A text's vector is (1 + log n) * idf over them, of unit length; idf comes from the document frequencies of all documents.

Learning takes at most SAMPLE labelled rows, those of least hash; their term counts, not their texts, reach the driver. The RANK leading right
singular vectors of the examples' matrix (subspace iteration over its non-zero values, started from seeded draws) span the latent space. Vectors of terms and
of examples are broadcast; their size is bounded by TERMS, SAMPLE and RANK.

A task projects its documents, and each block of them is compared with all examples in one matrix product, so the NEAREST examples
are exact. Cosines are rounded to nine digits, and equal ones go to the example that comes first in the sample, so that block sizes don't
show. The score is the share of label 1 among them, weighted by cosines above 0 and drawn by SHRINK towards the sample's share. The ids of the
nearest three are the evidence.

Null and empty texts have no term; they, and texts whose terms lie outside the latent space, get the share of label 1 among examples of that kind, drawn
towards the sample's by one count. Without any labelled row every score is 0. Labels other than 0 and 1 and null ids aren't learnt from. Only the
text is read to score; whole texts are. Rows are independent; repeated rows get equal results.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from eventlens.llm.common import ship
from eventlens.llm.vectors import quoted

#: Hashed terms; labelled rows learnt from; latent dimensions and how many more the iteration carries; its rounds; neighbours.
TERMS, SAMPLE, RANK, MORE, ROUNDS, NEAREST = 8192, 6000, 64, 16, 6, 9
#: Weight of the sample's share among the votes.
SHRINK = 0.25
#: Non-zero values, and rows, that are worked on at a time.
VALUES, BLOCK = 65_536, 256
#: Shares beyond which a repetition has a further mark, and terms of each mark.
SHARES, MARKS = (0.0, 0.05, 0.1, 0.2, 0.4), 3
_LOWER = bytes((b + 32 if 65 <= b <= 90 else b) if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_SHAPE = bytes(97 if b >= 128 or 97 <= b <= 122 else 65 if 65 <= b <= 90 else 57 if 48 <= b <= 57 else b for b in range(256))
_RUN = re.compile(rb"([^\s])\1+")


def place(term: bytes, kind: bytes) -> int:
    return zlib.crc32(term, zlib.crc32(kind)) % TERMS


def terms(text: str | None) -> Counter:
    """Counts by place of all terms of a whole text."""
    data = (text or "").encode()
    out: Counter = Counter()
    for kind, found in ((b"word", data.translate(_LOWER)), (b"shape", _RUN.sub(rb"\1", data.translate(_SHAPE)))):
        start = zlib.crc32(kind)
        for word, n in Counter(found.split()).items():
            out[zlib.crc32(word, start) % TERMS] += n
    words = data.split()
    lines = [line for line in data.split(b"\n") if line.strip()]
    runs = sum(a == b for a, b in zip(words, islice(words, 1, None)))
    for kind, n, of in ((b"run", runs, len(words)), (b"line", len(lines) - len(set(lines)), len(lines))):
        for k, share in enumerate(SHARES):
            if n > share * of:
                for m in range(MARKS):
                    out[place(b"%d/%d" % (k, m), kind)] += n
    return out


class Rows:
    """Sparse unit rows: places and weights, one row after the other."""

    def __init__(self, bags: list[Counter | dict[int, int]], idf: np.ndarray):
        parts = [(np.fromiter(b.keys(), np.int64, len(b)), np.fromiter(b.values(), np.float64, len(b))) for b in bags]
        self.n = len(parts)
        self.size = np.array([len(p) for p, _ in parts], np.int64)
        self.at = np.concatenate([p for p, _ in parts]) if parts else np.zeros(0, np.int64)
        self.w = np.concatenate([w for _, w in parts]) if parts else np.zeros(0)
        # Each row's places in ascending order, so that sums don't depend on the order of a text's words.
        row = np.repeat(np.arange(self.n), self.size)
        order = np.lexsort((self.at, row))
        self.at, self.w = self.at[order], (1 + np.log(self.w[order])) * idf[self.at[order]]
        norm = np.sqrt(np.bincount(row, weights=self.w * self.w, minlength=self.n))
        self.w = self.w / np.where(norm > 0, norm, 1)[row]

    def times(self, right: np.ndarray) -> np.ndarray:
        """This matrix times a dense one, a bounded number of values at a time."""
        return _gather(self.size, self.at, self.w, right)

    def flipped(self, right: np.ndarray) -> np.ndarray:
        """The transposed matrix times a dense one."""
        row = np.repeat(np.arange(self.n), self.size)
        order = np.argsort(self.at, kind="stable")
        return _gather(np.bincount(self.at, minlength=TERMS), row[order], self.w[order], right)


def _gather(size: np.ndarray, at: np.ndarray, w: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each row: the sum of its weights times rows of `right`."""
    out, ends = np.zeros((len(size), right.shape[1])), np.cumsum(size)
    first = 0
    while first < len(size):
        begin = ends[first] - size[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + VALUES, side="right")))
        full = first + np.flatnonzero(size[first:last])
        if len(full):
            part = slice(begin, ends[last - 1])
            out[full] = np.add.reduceat(right[at[part]] * w[part, None], ends[full] - size[full] - begin, axis=0)
        first = last
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1; rows next to zero are zero."""
    norm = np.sqrt((x * x).sum(axis=1))[:, None]
    return np.where(norm > 1e-9, x / np.where(norm > 1e-9, norm, 1), 0.0)


class Model:
    """idf of all terms, the latent space and the examples in it."""

    def __init__(self, idf: np.ndarray, examples: list[tuple[object, int, dict[int, int]]]):
        self.idf, self.ids = idf, [str(i) for i, _, _ in examples]
        self.y = np.array([y for _, y, _ in examples], np.float64)
        self.prior = float(self.y.mean()) if len(examples) else 0.0
        rows = Rows([bag for _, _, bag in examples], idf)
        rank = min(RANK, rows.n)
        basis = np.random.default_rng(0).standard_normal((TERMS, min(RANK + MORE, max(1, rows.n))))
        for _ in range(ROUNDS):
            basis = np.linalg.qr(rows.flipped(np.linalg.qr(rows.times(basis))[0]))[0] if rows.n else basis
        _, _, turn = np.linalg.svd(rows.times(basis), full_matrices=False) if rows.n else (0, 0, np.zeros((0, basis.shape[1])))
        self.space = basis @ turn[:rank].T
        self.examples = unit(rows.times(self.space))
        none = ~self.examples.any(axis=1)
        self.zero = (float(self.y[none].sum()) + self.prior) / (int(none.sum()) + 1) if rows.n else 0.0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples by falling cosine (ties: the first one) and those cosines, NEAREST a row of latent unit vectors."""
        s = np.round(x @ self.examples.T, 9)
        k = min(NEAREST, s.shape[1])
        least = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k, None]
        above, equal = s > least, s == least
        chosen = above | (equal & (np.cumsum(equal, axis=1) <= k - above.sum(axis=1)[:, None]))
        at = np.nonzero(chosen)[1].reshape(len(x), k)
        own = np.take_along_axis(s, at, axis=1)
        order = np.argsort(-own, axis=1, kind="stable")
        return np.take_along_axis(at, order, axis=1), np.take_along_axis(own, order, axis=1)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, list[list[str]]]:
        """Scores and the ids of the nearest three examples."""
        out, evidence = np.full(len(texts), self.zero), [[] for _ in texts]
        if not len(self.y):
            return out, evidence
        x = unit(Rows([terms(t) for t in texts], self.idf).times(self.space))
        some = np.flatnonzero(x.any(axis=1))
        if len(some):
            at, s = self.nearest(x[some])
            s = np.maximum(s, 0)
            out[some] = ((s * self.y[at]).sum(axis=1) + SHRINK * self.prior) / (s.sum(axis=1) + SHRINK)
            for row, near in zip(some.tolist(), at[:, :3].tolist()):
                evidence[row] = [self.ids[k] for k in near]
        return out, evidence


def frequencies(df: DataFrame, text_col: str = "text") -> np.ndarray:
    """idf of every place, from all documents. A task hands back TERMS + 1 counts whatever it reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(TERMS + 1, np.int64)
        for batch in batches:
            counts[TERMS] += batch.num_rows
            for text in batch.column(0).to_pylist():
                counts[list(terms(text))] += 1
        own = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(counts[own])], ["place", "n"])

    sums = df.select(quoted(text_col).cast("string").alias("text")).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n"))
    n = np.zeros(TERMS + 1)
    for r in sums.collect():
        n[r.place] = r.n
    return np.log((n[TERMS] + 1) / (n[:TERMS] + 1))


def learn(df: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fits on the SAMPLE labelled rows of least hash; `fold` tells of a column id whether it may be learnt from."""
    ship(df.sparkSession)
    marked = labels.select(quoted(id_col).alias("id"), quoted(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    marked = marked.where(fold).withColumn("h", F.xxhash64("id")).orderBy("h", "id", "y").limit(SAMPLE)
    texts = df.select(quoted(id_col).alias("id"), quoted(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(marked), "id").select("h", F.col("id").cast("string").alias("id"), "y", F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("d"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags = [terms(t) for t in batch.column(4).to_pylist()]
            found = [pa.array([list(f(b)) for b in bags], pa.list_(pa.int64())) for f in (dict.keys, dict.values)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(4)), *found], ["h", "id", "y", "d", "places", "counts"])

    bags = rows.mapInArrow(run, "h long, id string, y int, d string, places array<long>, counts array<long>")
    examples = [(r.id, r.y, dict(zip(r.places, r.counts))) for r in bags.orderBy("h", "id", "d", "y").limit(SAMPLE).collect()]
    return Model(frequencies(df, text_col), examples)


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and evidence of every whole text."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.ArrayType(T.StringType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                scores, evidence = own.score(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scores), pa.array(evidence, pa.list_(pa.string()))], kind.fieldNames())

    return df.select(quoted(id_col), quoted(text_col).cast("string").alias("text")).mapInArrow(run, kind)
