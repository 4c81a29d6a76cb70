"""Toxicity by nearest labelled examples under TF-IDF cosine, from a block-max inverted index.

Learning takes a bounded sample of the labelled rows (SAMPLE rows of least hash, equal texts once). The
terms are lower-cased words without outer punctuation, the first four to eight letters of longer ones, and those that
two or four different words of the text begin with. Terms whose document frequencies differ between the labels by more than chance (a chi-squared bound) are
kept, all of them; a vector is (1 + log tf) * idf over them, of unit length. Examples with no kept term aren't
indexed; they give the score of texts that have none.

The index holds, per term, postings in order of example, cut into blocks with the largest weight of each.
A query bounds every block by the sum of its term weights times the block maxima, visits blocks in
descending bound and stops when no block can reach the k-th best: the k nearest are exact.
Votes are weighted by similarity and shrunk to the sample's share of toxic rows; leave-one-out votes on the
sample calibrate them to probabilities by isotonic regression. The nearest examples' ids are the evidence.

Null and empty texts have no term. Ties in similarity go to the example that comes first in the sample. Without any
labelled row every score is 0. Only the text is read to score. The broadcast index is bounded by SAMPLE.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.llm.common import ship

#: Labelled rows learnt from; least rows with a term and chi-squared of one; neighbours; examples in a block.
SAMPLE, LEAST, CHI2, NEAREST, BLOCK = 6000, 6, 40.0, 15, 64
#: Words whose terms a worker keeps.
WORDS = 300_000
SHRINK = 0.25
_EDGE = """!"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"""


def parts(word: str) -> list[str]:
    """The terms of one word: itself and its beginnings of four to eight letters (marked)."""
    return [word, *("^" + word[:k] for k in range(4, min(9, len(word))))]


def bag(text: str | None, known: dict[str, list[str]] | None = None, vocabulary: frozenset = frozenset()) -> Counter:
    """Term counts of a whole text; a beginning that 2 or 4 different words share gives further terms.

    known: a cache of words' terms within the vocabulary; without one all terms are made.
    """
    out: Counter = Counter()
    words: Counter = Counter()
    for word, n in Counter((text or "").lower().split()).items():
        word = word.strip(_EDGE)
        if known is None:
            own = parts(word)
        elif (own := known.get(word)) is None:
            own = [t for t in parts(word) if t in vocabulary]
            if len(known) > WORDS:
                known.clear()
            known[word] = own
        for t in own:
            out[t] += n
            words[t] += 1
    for t, n in words.items():
        if n > 1:
            out["2" + t] = n
            if n > 3:
                out["4" + t] = n
    return out


class Index:
    """The examples' vectors as postings with block maxima."""

    def __init__(self, idf: dict[str, float], vectors: list[dict[str, float]], labels: np.ndarray, ids: list):
        self.idf = idf
        self.term = {t: k for k, t in enumerate(idf)}
        self.labels, self.ids, self.n = labels, ids, len(vectors)
        self.blocks = max(1, -(-self.n // BLOCK))
        by: list[list[tuple[int, float]]] = [[] for _ in idf]
        for d, v in enumerate(vectors):
            for t, w in v.items():
                by[self.term[t]].append((d, w))
        self.docs = [np.array([d for d, _ in p], np.int64) for p in by]
        self.weights = [np.array([w for _, w in p], np.float64) for p in by]
        self.cuts = [np.searchsorted(d, np.arange(self.blocks + 1) * BLOCK) for d in self.docs]
        self.most = np.zeros((len(by), self.blocks))
        for t, (d, w) in enumerate(zip(self.docs, self.weights)):
            np.maximum.at(self.most[t], d // BLOCK, w)

    def vector(self, counts: Counter) -> dict[str, float]:
        idf = self.idf
        v = {t: (1 + log(n)) * idf[t] for t, n in counts.items() if t in idf}
        size = sum(w * w for w in v.values()) ** 0.5
        return {t: w / size for t, w in v.items()}

    def nearest(self, v: dict[str, float], k: int, but: int = -1) -> list[tuple[float, int]]:
        """The k most similar examples (similarity, example), exact; `but` is left out."""
        asked = [(self.term[t], w) for t, w in v.items()]
        if not asked or not self.n:
            return []
        bound = np.array([w for _, w in asked]) @ self.most[[t for t, _ in asked]]
        found: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or len(found) == k and bound[b] < -found[-1][0] - 1e-12:
                break
            scores = np.zeros(BLOCK)
            for t, w in asked:
                a, z = self.cuts[t][b], self.cuts[t][b + 1]
                if a < z:
                    scores[self.docs[t][a:z] - b * BLOCK] += w * self.weights[t][a:z]
            hits = [(-float(scores[x]), b * BLOCK + int(x)) for x in np.flatnonzero(scores > 0) if b * BLOCK + x != but]
            found = sorted(found + hits)[:k]
        return [(-s, d) for s, d in found]


class Model:
    def __init__(self, rows: list[tuple[object, str, int]]):
        seen: dict[str, tuple] = {}
        for doc, text, label in rows:
            seen.setdefault(text, (doc, label))
        n, pos = len(seen), sum(label for _, label in seen.values())
        self.prior = pos / n if n else 0.0
        held: tuple[Counter, Counter] = (Counter(), Counter())
        for text, (_, label) in seen.items():
            held[label].update(bag(text).keys())
        kept = []
        for t in held[0].keys() | held[1].keys():
            a, b = held[1][t], held[0][t]
            if a + b >= LEAST and 0 < pos < n:
                e = (a + b) * self.prior
                chi = (a - e) ** 2 / e + (a - e) ** 2 / (a + b - e)
                if chi >= CHI2:
                    kept.append((-chi, t, a + b))
        del held
        kept.sort()
        idf = {t: log(1 + n / df) for _, t, df in kept}
        self.index = Index(idf, [], np.zeros(0), [])
        self.vocabulary = frozenset(idf) | {t[1:] for t in idf if t[0] in "24"}
        self.known: dict[str, list[str]] = {}
        vectors = [(self.index.vector(bag(text, self.known, self.vocabulary)), label, doc) for text, (doc, label) in seen.items()]
        self.known.clear()
        full = [x for x in vectors if x[0]]
        self.index = Index(idf, [v for v, _, _ in full], np.array([y for _, y, _ in full]), [d for _, _, d in full])
        none = [y for v, y, _ in vectors if not v]
        self.zero = (sum(none) + self.prior) / (len(none) + 1)
        raw = sorted((self.vote(self.index.nearest(v, NEAREST, but=k)), y) for k, (v, y, _) in enumerate(full))
        self.steps, self.values = isotonic(raw)

    def vote(self, near: list[tuple[float, int]]) -> float:
        total = sum(s for s, _ in near) + SHRINK
        return (sum(s * float(self.index.labels[d]) for s, d in near) + SHRINK * self.prior) / total

    def score(self, text: str | None) -> tuple[float, list]:
        v = self.index.vector(bag(text, self.known, self.vocabulary))
        if not v:
            return self.zero, []
        near = self.index.nearest(v, NEAREST)
        at = bisect_right(self.steps, self.vote(near) + 1e-12) - 1
        return (self.values[max(0, at)] if self.values else self.prior), [self.index.ids[d] for _, d in near[:3]]


def isotonic(raw: list[tuple[float, int]]) -> tuple[list[float], list[float]]:
    """Steps of the increasing fit (pool adjacent violators), each value shrunk by one count to its neighbours' mean."""
    pools: list[list[float]] = []
    for x, y in raw:
        if pools and pools[-1][3] == x:
            pools[-1][1] += y
            pools[-1][2] += 1
        else:
            pools.append([x, y, 1, x])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, y2, n2, last = pools.pop()
            pools[-1][1] += y2
            pools[-1][2] += n2
            pools[-1][3] = last
    return [p[0] for p in pools], [(p[1] + 0.5) / (p[2] + 1) for p in pools]


def learn(df: DataFrame, labels: DataFrame, fold: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """Fits on the SAMPLE labelled rows of least hash; a top-k per task, so no more than that reaches the driver."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)")
    marked = marked.where(fold).withColumn("h", F.xxhash64("id")).orderBy("h", "id", "y").limit(SAMPLE)
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(marked), "id").select("id", F.coalesce("text", F.lit("")).alias("text"), "y", "h").orderBy("h", "id", "text", "y").limit(SAMPLE)
    return Model([(r.id, r.text, r.y) for r in rows.collect()])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score and evidence (ids of the nearest examples, as text) of every whole text."""
    ship(df.sparkSession)
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            out = [own.score(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([s for s, _ in out], pa.float64()), pa.array([[str(d) for d in e] for _, e in out], pa.list_(pa.string()))],
                [id_col, "score", "evidence"],
            )

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` {kind}, score double, evidence array<string>")
