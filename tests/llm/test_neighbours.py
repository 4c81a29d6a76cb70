"""The quality classifier: its vectors and votes against plain Python, the latent space against a dense decomposition, held-out labels."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventlens.llm import neighbours
from eventlens.llm.common import crc_mod
from eventlens.llm.queries import QUERIES


def corpus(n, seed=1):
    rng = random.Random(seed)
    words = [f"word{k}" for k in range(60)]
    texts = []
    for k in range(n):
        body = [rng.choice(words) for _ in range(rng.randint(5, 60))]
        texts.append(" ".join(w + rng.choice(["###", "$$$"]) for w in body) if k % 5 == 0 else " ".join(body).capitalize() + ".")
    return texts


def test_terms():
    assert neighbours.terms(None) == neighbours.terms(" \n\t") == Counter()
    place = neighbours.place
    got = neighbours.terms("The the THE $$$ 1994a é")
    assert got[place(b"the", b"word")] == 3 and got[place(b"1994a", b"word")] == 1 and got["é".encode() and place("é".encode(), b"word")] == 1
    assert got[place(b"Aa", b"shape")] == 1 and got[place(b"a", b"shape")] >= 2 and got[place(b"$", b"shape")] == 1 and got[place(b"9a", b"shape")] == 1
    runs = neighbours.terms("a a a b")
    assert runs[place(b"0/0", b"run")] == runs[place(b"4/2", b"run")] == 2 and place(b"0/0", b"line") not in runs
    lines = neighbours.terms("x y\nz\nx y\n\n\n")
    assert lines[place(b"3/1", b"line")] == 1 and place(b"4/1", b"line") not in lines


def test_rows_and_space_against_dense(monkeypatch):
    monkeypatch.setattr(neighbours, "VALUES", 50)
    monkeypatch.setattr(neighbours, "RANK", 8)
    texts = [*corpus(60), "", None]
    bags = [neighbours.terms(t) for t in texts]
    idf = np.random.default_rng(1).random(neighbours.TERMS) + 0.1
    dense = np.zeros((len(bags), neighbours.TERMS))
    for k, bag in enumerate(bags):
        for t, n in bag.items():
            dense[k, t] = (1 + math.log(n)) * idf[t]
        dense[k] /= np.linalg.norm(dense[k]) or 1
    rows = neighbours.Rows(bags, idf)
    right = np.random.default_rng(2).random((neighbours.TERMS, 5))
    assert np.allclose(rows.times(right), dense @ right) and np.allclose(rows.flipped(right[: len(bags)]), dense.T @ right[: len(bags)])
    model = neighbours.Model(idf, [(k, k % 2, b) for k, b in enumerate(bags)])
    _, s, vt = np.linalg.svd(dense, full_matrices=False)
    # The share of the matrix that the space keeps is that of the leading singular vectors.
    kept = np.linalg.norm(dense @ model.space) ** 2
    assert kept == pytest.approx((s[:8] ** 2).sum(), rel=1e-3) and np.allclose(model.space.T @ model.space, np.eye(8))


def test_votes_brute_force(spark):
    texts = [*corpus(200), "", None, "word1 word2", "word1 word2", "é" * 50, "x" * 40_000, "a b " * 3000]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(3, texts[3]), (None, texts[4])], "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(k, int(k % 5 != 0)) for k in range(0, 200)] + [(201, 0), (None, 1), (7, None), (8, 5)], "doc_id long, quality int")
    model = neighbours.learn(docs, labels, crc_mod(F.col("id"), 3) != 1)
    assert all(zlib.crc32(i.encode()) % 3 != 1 for i in model.ids)
    df = np.zeros(neighbours.TERMS)
    everything = [*texts, texts[3], texts[4]]
    for t in everything:
        for p in neighbours.terms(t):
            df[p] += 1
    assert np.allclose(model.idf, np.log((len(everything) + 1) / (df + 1)))

    def latent(text):
        v = np.zeros(neighbours.TERMS)
        for p, n in neighbours.terms(text).items():
            v[p] = (1 + math.log(n)) * model.idf[p]
        v = v / (np.linalg.norm(v) or 1) @ model.space
        return v / np.linalg.norm(v) if np.linalg.norm(v) > 1e-9 else None

    got = neighbours.score(docs, model).collect()
    assert len(got) == len(everything)
    for r in got:
        x = latent(texts[4] if r.doc_id is None else texts[r.doc_id])
        if x is None:
            assert r.score == pytest.approx(model.zero) and r.evidence == []
            continue
        s = sorted(((-round(float(e @ x), 9), k) for k, e in enumerate(model.examples)))[: neighbours.NEAREST]
        total = sum(max(0, -c) for c, _ in s) + neighbours.SHRINK
        assert r.score == pytest.approx((sum(max(0, -c) * model.y[k] for c, k in s) + neighbours.SHRINK * model.prior) / total, abs=1e-6)
    right = [(r.score >= 0.5) == (r.doc_id % 5 != 0) for r in got if r.doc_id is not None and r.doc_id < 200 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert sum(right) >= 0.95 * len(right)


def test_ties_go_to_the_first():
    idf = np.ones(neighbours.TERMS)
    model = neighbours.Model(idf, [(k, k % 2, {5: 1}) for k in range(40)] + [(99, 1, {6: 1})])
    at, s = model.nearest(model.examples[:1])
    assert at[0].tolist() == list(range(neighbours.NEAREST)) and (s == 1).all()
    few = neighbours.Model(idf, [(1, 1, {5: 1}), (2, 0, {6: 1})])
    assert few.score(["anything", None])[0].shape == (2,)


def test_odd(spark, odd, none):
    labels = spark.createDataFrame([(k, k % 2, "clash") for k in range(30)], "doc_id long, quality int, text string")
    model = neighbours.learn(odd, labels, F.lit(True))
    got = neighbours.score(odd, model)
    assert got.columns == ["doc_id", "score", "evidence"] and got.count() == odd.count() and got.where("score between 0 and 1").count() == odd.count()
    assert neighbours.score(none, model).count() == 0
    unlearnt = neighbours.learn(odd, labels.where("false"), F.lit(True))
    assert {r.score for r in neighbours.score(odd, unlearnt).collect()} == {0.0}
    assert {r.score for r in neighbours.score(odd, neighbours.learn(none, labels, F.lit(True))).collect()} == {0.0}


def test_held_out_labels(spark):
    d = "/root/testdata/sf0.01"
    out = QUERIES["op11_quality_neighbours"](spark, d).where("held_out").join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").collect()
    good, bad = [r.predicted for r in out if r.quality == 1], [r.predicted for r in out if r.quality == 0]
    assert sum(good) >= 0.98 * len(good) and sum(bad) <= 0.25 * len(bad)
