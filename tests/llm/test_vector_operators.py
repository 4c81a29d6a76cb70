"""Vector codes and centroids against brute force in Python's integers, with ties, odd rows and components too large for longs."""

import hashlib
import math
import random

import numpy as np
import pytest

from eventlens.llm import centroids, codes
from eventlens.llm.queries import QUERIES
from eventlens.llm.vectors import LONG, Sums, pairwise

KIND = "vec_id long, embedding array<double>, label int, id string, v int, key string, `a.b` int, cluster int, error int"


def floor(x, scale):
    return math.floor(x * scale) if abs(x * scale) < 2**62 else int(math.copysign(2**62, x))


def nearest(x, entries):
    return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(entries))


def mean(rows):
    return [sum(c) // len(rows) for c in zip(*rows)]


def brute_centroids(rows, k=16, rounds=3, scale=64, dims=64):
    kept = [(i, [floor(x, scale) for x in v]) for i, v, _ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    c = [v for _, v in order[:k]]
    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v, c)[1], []).append(v)
        c = [mean(groups[n]) if n in groups else old for n, old in enumerate(c)]
    out = [(i, *nearest(v, c)[::-1]) for i, v in kept]
    per = {}
    for _, n, d in out:
        per[n] = per.get(n, 0) + d
    total = sum(per.values())
    return [(i, n, min(d, LONG), min(per[n], LONG), min(total, LONG), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, n, d in out]


def brute_codes(rows, parts=16, entries=64, rounds=2, scale=256):
    kept = [(i, [floor(x, scale) for x in v], label) for i, v, label in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    w = 64 // parts
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[v[p * w : p * w + w] for _, v, _ in order] for p in range(parts)]
    for _ in range(rounds):
        for p, book in enumerate(books):
            groups = {}
            for _, v, _ in kept:
                q = v[p * w : p * w + w]
                groups.setdefault(nearest(q, book)[1], []).append(q)
            books[p] = [mean(groups[n]) if n in groups else e for n, e in enumerate(book)]
    out, per = [], {}
    for i, v, label in kept:
        hits = [nearest(v[p * w : p * w + w], b) for p, b in enumerate(books)]
        error = sum(d for d, _ in hits)
        out.append((i, "".join(f"{k:02x}" for _, k in hits), error, label))
        per[label] = per.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, min(e, LONG), min(per[label], LONG), digest) for i, code, e, label in out]


def table(rng, n, coarse, wide=False):
    """coarse: components of a few values only, so that many distances are equal."""
    rows = []
    for i in range(n):
        v = [rng.choice([-0.25, 0.0, 0.125]) if coarse else rng.uniform(-0.6, 0.6) for _ in range(64)]
        rows.append((i * 7 % n, v, rng.choice([0, 1, 1, None])))
    rows += [rows[3], rows[5], (None, rows[8][1], 2), (n + 1, None, 1), (n + 2, [None] * 64, 1), (n + 3, [math.nan] * 64, 0), (n + 4, [0.0] * 63 + [math.inf], 0), (n + 5, [], 1), (n + 6, [0.5] * 63, 1), (n + 7, [0.5] * 128, 1)]
    if wide:
        rows += [(n + 8, [1e30] * 64, 7), (n + 9, [-1e17] + [0.0] * 63, 8), (n + 10, [3e6] * 64, 8)]
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "k", 2, 9, 9) for r in rows], KIND).repartition(5)


def registered(df, name, monkeypatch):
    from eventlens.llm import queries

    monkeypatch.setattr(queries, "table", lambda *a: df)
    return sorted(map(tuple, QUERIES[name](df.sparkSession, "").collect()), key=str)


@pytest.mark.parametrize(("n", "coarse", "wide"), [(300, False, False), (300, True, False), (9, True, False), (80, False, True)])
def test_brute_force(spark, monkeypatch, n, coarse, wide):
    rows = table(random.Random(n + coarse), n, coarse, wide)
    df = frame(spark, rows)
    assert registered(df, "op13_centroids", monkeypatch) == sorted(brute_centroids(rows), key=str)
    assert registered(df, "op12_vector_codes", monkeypatch) == sorted(brute_codes(rows), key=str)


def test_nothing_to_do(spark, monkeypatch):
    df = frame(spark, [(1, None, 1)])
    for rows in (df, df.where("false")):
        assert registered(rows, "op13_centroids", monkeypatch) == registered(rows, "op12_vector_codes", monkeypatch) == []
    alone = frame(spark, [(4, [0.5] * 64, None)])
    assert registered(alone, "op13_centroids", monkeypatch)[0][:5] == (4, 0, 0, 0, 0)
    assert registered(alone, "op12_vector_codes", monkeypatch)[0][:4] == (4, "00" * 16, 0, 0)


def test_shortlist_holds_the_nearest():
    """Entries far from zero and next to each other: float32 alone orders many of them wrongly."""
    rng = np.random.default_rng(2)
    wrong = 0
    for size in (50, 10**5, 10**7):
        base = rng.integers(-size, size, 64)
        c = base + rng.integers(-3, 4, (16, 64))
        x = base + rng.integers(-3, 4, (400, 64))
        screen = centroids.Screen(c.tolist())
        exact = pairwise(x, c)
        best = exact.min(axis=1)
        may = screen.shortlist(x)
        assert (may | (exact > best[:, None])).all()
        assert (screen.nearest(x) == exact.argmin(axis=1)).all()
        square = (c.astype(np.float32) ** 2).sum(axis=1)
        wrong += int(((square - 2 * (x.astype(np.float32) @ c.astype(np.float32).T)).argmin(axis=1) != exact.argmin(axis=1)).sum())
    assert wrong > 0
    few = centroids.Screen(rng.integers(-40, 40, (16, 64)).tolist()).shortlist(rng.integers(-40, 40, (1000, 64)))
    assert few.sum() < 1100


@pytest.mark.parametrize("spread", [2, 30, 10**6])
def test_tree_is_a_full_comparison(spread):
    rng = np.random.default_rng(spread)
    points = rng.integers(-spread, spread + 1, (64, 4))
    points[40:50] = points[3]
    q = np.concatenate([rng.integers(-spread, spread + 1, (500, 4)), points])
    at, d = codes.Tree(points.tolist(), 64).nearest(q)
    exact = pairwise(q, points)
    assert (at == exact.argmin(axis=1)).all() and (d == exact.min(axis=1)).all()
    same = codes.Tree([[1, 1]] * 30, 2)
    assert same.nearest(np.array([[5, 5]]))[0].tolist() == [0]


def test_sums_are_exact():
    rng = random.Random(1)
    x = np.array([[rng.randint(-(2**62), 2**62) for _ in range(3)] for _ in range(50)], np.int64)
    group = np.array([rng.randrange(4) for _ in range(50)])
    sums = Sums(5, 3)
    sums.add(x[:20], group[:20])
    sums.add(x[20:], group[20:])
    for g in range(5):
        for p in range(3):
            assert (int(sums.high[g, p]) << 32) + int(sums.low[g, p]) == sum(int(v) for v, k in zip(x[:, p], group) if k == g)


def test_decode(spark):
    df = frame(spark, table(random.Random(3), 100, False))
    out, books = codes.compress(df, entries=100, rounds=0)
    first = df.where("vec_id = 7").first()
    row = out.where("vec_id = 7").first()
    assert max(abs(a - b) for a, b in zip(codes.decode(row.codes, books), first.embedding)) < 1 / 256 and row.error == 0


def test_registered(spark, sf):
    assert QUERIES["op12_vector_codes"](spark, sf).count() == QUERIES["op13_centroids"](spark, sf).count() > 0
