"""Windows, labels, overlaps and refinement: hand-computed cases."""

import pytest
from pyspark.sql import functions as F

from eventlens.functions import intervals
from eventlens.operators import joins, refine, windows


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{k}") for k, c in enumerate(cols))).first()


def lit(*xs):
    return [F.lit(x).cast("double") for x in xs]


@pytest.mark.parametrize(
    ("win", "event", "want"),
    [((0, 4), (1, 2), "c"), ((0, 4), (3.5, 10), None), ((0, 4), (2.5, 60), None), ((0, 4), (4, 8), "normal"), ((0, 4), (2, 6), "c"), ((0, 4), (None, None), "normal"), ((8, 12), (0, 60), "c")],
)
def test_window_label(spark, win, event, want):
    assert one(spark, intervals.window_label(*lit(*win, *event), F.lit("c"))).c0 == want


def test_repair(spark):
    assert tuple(one(spark, *intervals.repaired(*lit(2, 2, 6)))) == (0.0, 6.0)


@pytest.mark.parametrize(("a", "b", "want"), [((0, 10), (5, 15), 1 / 3), ((0, 5), (5, 10), 0), ((3, 3), (3, 3), 0), ((None, None), (0, 1), 0)])
def test_iou(spark, a, b, want):
    assert one(spark, intervals.iou(*lit(*a, *b))).c0 == pytest.approx(want)
    assert one(spark, intervals.iou(*lit(*b, *a))).c0 == pytest.approx(want)


@pytest.mark.parametrize(
    ("duration", "window", "stride", "want"),
    [(10, 4, 4, [(0, 4), (4, 8), (8, 10)]), (8, 4, 4, [(0, 4), (4, 8)]), (10, 4, 2, [(0, 4), (2, 6), (4, 8), (6, 10)]), (0, 4, 4, []), (3, 4, 4, [(0, 3)]), (9, 2, 4, [(0, 2), (4, 6), (8, 9)])],
)
def test_grid(spark, duration, window, stride, want):
    assert [(r.start, r.end) for r in one(spark, windows.grid(*lit(duration), float(window), float(stride))).c0] == want


def test_frames(spark):
    r = one(
        spark,
        windows.frame_indices(F.lit(60), F.lit(15.0), 8),
        windows.subsample(F.array(*map(F.lit, range(8))), 4),
        windows.strided(F.array(*map(F.lit, range(10))), 4),
        windows.strided(F.array(*map(F.lit, range(3))), 8),
        windows.middle(F.array(*map(F.lit, range(5)))),
        windows.frame_times(*lit(0, 8), F.lit(3), *lit(8)),
    )
    assert r.c0 == [0, 8, 16, 25, 33, 42, 50, 59]
    assert r.c1 == [0, 2, 5, 7]
    assert r.c2 == [0, 2, 4, 6]
    assert r.c3 == [0, 1, 2]
    assert r.c4 == 2
    assert r.c5 == [0.0, 4.0, 7.999]


@pytest.mark.parametrize(("tokens", "want"), [(512, (840, 448)), (128, (420, 224)), (None, (1280, 720)), (10**6, (1280, 720))])
def test_resize(spark, tokens, want):
    assert tuple(one(spark, windows.resized(F.lit(1280), F.lit(720), tokens)).c0) == want


def test_scale_routing(spark):
    rows = [("short", "loitering_or_suspicious_presence", 20.0), ("short", "normal", 20.0), ("long", "fire", 20.0), ("long", "normal", 16.0), ("long", "normal", 15.0)]
    got = windows.routed(spark.createDataFrame(rows, "scale string, class_name string, duration double"))
    assert sorted(map(tuple, got.collect())) == [("long", "normal", 16.0), ("short", "normal", 20.0)]


def test_point_in_interval(spark):
    seg = spark.createDataFrame([("v", 0.0, 5.0, "A", 0.0), ("v", 5.0, 8.0, "B", 2.0)], "video_id string, start double, end double, source_path string, source_start double")
    pts = spark.createDataFrame([("v", 5.0), ("v", 8.0), ("w", 1.0)], "video_id string, t double")
    got = {(r.video_id, r.t): (r.seg_path, r.seg_offset) for r in joins.point_in_interval(pts, seg, "video_id", "t").collect()}
    assert got == {("v", 5.0): ("B", 2.0), ("v", 8.0): (None, None), ("w", 1.0): (None, None)}


@pytest.mark.parametrize("how", ["inner", "left"])
def test_binned_overlap_is_the_plain_one(spark, how):
    import random

    rng = random.Random(5)
    rows = [(f"v{rng.randint(0, 2)}", k, s, s + rng.randint(1, 30)) for k, s in enumerate(rng.randint(0, 100) for _ in range(60))]
    a = spark.createDataFrame(rows, "video_id string, a long, s long, e long")
    b = a.select("video_id", F.col("a").alias("b"), (F.col("s") + 7).alias("s2"), (F.col("e") + 9).alias("e2"))
    plain = joins.overlap_join(a, b, "video_id", ("s", "e"), ("s2", "e2"), how)
    cut = joins.overlap_join(a, b, "video_id", ("s", "e"), ("s2", "e2"), how, bin_sec=10)
    pairs = lambda df: sorted((r.a, -1 if r.b is None else r.b) for r in df.select("a", "b").collect())
    assert pairs(plain) == pairs(cut)


def test_enrich_checks(spark):
    a = spark.createDataFrame([("v", 1), ("w", 2)], "k string, x int")
    with pytest.raises(ValueError, match="unknown"):
        joins.enrich(a, spark.createDataFrame([("v", 3)], "k string, y int"), "k")
    with pytest.raises(ValueError, match="unique"):
        joins.enrich(a, spark.createDataFrame([("v", 3), ("v", 4), ("w", 5)], "k string, y int"), "k")


@pytest.mark.parametrize(("interval", "want"), [((4, 12), (6, 10)), ((4, 8), (5.75, 6.25)), ((0, 2.6), (1.05, 1.55)), ((None, None), (None, None))])
def test_shrink(spark, interval, want):
    df = spark.createDataFrame([tuple(float(x) if x is not None else None for x in interval)], "start double, end double")
    assert tuple(refine.shrink(df, 4.0).first()) == want


def test_crossing(spark):
    v = spark.createDataFrame([("v", k, 4.0 * k, 4.0 * k + 4, "fire" if x else "normal", x) for k, x in enumerate([0.0, 0.8, 0.8, 0.0])], "video_id string, seq long, start double, end double, class_name string, score double")
    e = spark.createDataFrame([("v", "fire", 0, 4.0, 12.0)], "video_id string, class_name string, ord int, start double, end double")
    r = refine.refine(e, v, "interpolate").first()
    assert (r.start, r.end) == pytest.approx((4.5, 11.5))
    assert tuple(refine.refine(e, v, "both").select("start", "end").first()) == (4.5, 11.5)
    with pytest.raises(ValueError, match="mode"):
        refine.refine(e, v, "odd")


@pytest.mark.parametrize("width", [None, 7.0])
def test_first_segment_of_a_point(spark, width):
    """Overlapping, touching, equal and empty segments, points on edges, nulls and repeated rows, against a comparison with every segment."""
    import random

    rng = random.Random(11)
    segs = [(rng.choice(["v", "w", None]), float(s), float(s + rng.choice([0, 1, 2, 5, 30]) - (rng.random() < 0.1)), f"s{k}", float(k)) for k, s in enumerate(rng.randint(-5, 60) for _ in range(80))]
    segs += [("v", None, 3.0, "x", 0.0), ("v", 3.0, None, "x", 0.0)]
    pts = [(k, rng.choice(["v", "w", "u", None]), rng.choice([None, float(rng.randint(-8, 95)), rng.uniform(-8, 95)])) for k in range(150)] * 2
    s = spark.createDataFrame(segs, "video_id string, start double, end double, source_path string, source_start double").repartition(3)
    p = spark.createDataFrame(pts, "id int, video_id string, t double").repartition(3)
    want = []
    for k, v, t in pts:
        hit = min(((a, b, path, at) for u, a, b, path, at in segs if t is not None and v is not None and u == v and a is not None and b is not None and a <= t < b), default=None)
        want.append((k, v, t, hit[2] if hit else None, round(t - hit[0] + hit[3], 9) if hit else None))
    got = [(r.id, r.video_id, r.t, r.seg_path, None if r.seg_offset is None else round(r.seg_offset, 9)) for r in joins.point_in_interval(p, s, "video_id", "t", width).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("width", [None, 20.0])
def test_crossings_of_random_feeds(spark, width):
    """Each event against every crossing of its video and class."""
    import random

    rng = random.Random(12)
    v, e = [], []
    for name in ("a", "b", "c"):
        for k in range(40):
            s = float(rng.randint(0, 100))
            v.append((name, k, s, s + rng.choice([4, 6]), rng.choice(["fire", "smoke", "normal"]), round(rng.random(), 1)))
        for k in range(12):
            s = rng.choice([None, float(rng.randint(-5, 110))])
            e.append((name, rng.choice(["fire", "smoke", "flood"]), k, s, None if s is None or rng.random() < 0.1 else s + rng.choice([0, 2, 9, 30])))
    e.append(("unseen", "fire", 0, 1.0, 2.0))
    vd = spark.createDataFrame(v, "video_id string, seq long, start double, end double, class_name string, score double").repartition(3)
    ev = spark.createDataFrame(e, "video_id string, class_name string, ord int, start double, end double").repartition(3)
    got = {(r.video_id, r.ord): (r.start, r.end) for r in refine.interpolate(ev, vd, 0.5, width).collect()}
    assert len(got) == len(e)
    for name, c, k, s, end in e:
        feed = sorted(((a + b) / 2, x if kind == c else 0.0) for n, _, a, b, kind, x in v if n == name)
        rises = [(t2, t, t + (0.5 - x) / (x2 - x) * (t2 - t)) for (t, x), (t2, x2) in zip(feed, feed[1:]) if x < 0.5 <= x2]
        falls = [(t, t2, t2 + (0.5 - x2) / (x - x2) * (t - t2)) for (t, x), (t2, x2) in zip(feed, feed[1:]) if x2 < 0.5 <= x]
        new_s = min((r for r in rises if s is not None and r[0] >= s), default=(0, 0, s))[2]
        new_e = max((f for f in falls if end is not None and f[0] <= end), default=(0, 0, end))[2]
        want = (new_s, new_e) if None not in (new_s, new_e) and new_e > new_s else (s, end)
        assert got[name, k] == pytest.approx(want)


def test_first_event_of_a_window(spark):
    """Several events a clip: the least ord with a common part wins, an untimed one stands for the whole clip, touching isn't a part."""
    w = windows.sliding_windows(spark.createDataFrame([("v", 18.0), ("u", 8.0), ("n", 5.0)], "video_id string, duration double"), "duration")
    t = spark.createDataFrame(
        [("v", "late", 5, 2.0, 30.0), ("v", "first", 1, 4.0, 8.0), ("v", "tiny", 0, 11.0, 11.0), ("v", "b", 3, 15.9, 16.1), ("v", "a", 3, 15.0, 17.0), ("u", "whole", 2, None, None), ("u", "one", 1, 3.5, 4.0)],
        "video_id string, class_name string, ord int, start double, end double",
    )
    got = {(r.video_id, r.win_ord): (r.class_name, r.score) for r in windows.oracle_verdicts(w, t).collect()}
    assert [got["v", k][0] for k in range(5)] == ["late", "first", "late", "a", "a"]
    assert [got["u", k][0] for k in range(2)] == ["one", "whole"] and got["n", 0] == got["n", 1] == ("normal", 0.0)


@pytest.mark.parametrize("least", [0.1, 0.5, 0.9])
def test_similar_pairs_are_all_found(spark, least):
    import random

    rng = random.Random(13)
    mk = lambda n: [("v", k, s, s + rng.choice([0.0, rng.uniform(0.01, 0.3), rng.uniform(1, 4), rng.uniform(20, 90)])) for k, s in enumerate(rng.uniform(-20, 60) for _ in range(n))]
    a, b = mk(120), mk(120)
    left, right = spark.createDataFrame(a, "k string, a int, s double, e double"), spark.createDataFrame(b, "k string, b int, s2 double, e2 double")
    got = sorted((r.a, r.b) for r in joins.similar_pairs(left, right, ["k"], ("s", "e"), ("s2", "e2"), least).collect())
    iou = lambda x, y: max(0.0, min(x[3], y[3]) - max(x[2], y[2])) / ((max(x[3], y[3]) - min(x[2], y[2])) or 1)
    assert got == sorted((x[1], y[1]) for x in a for y in b if iou(x, y) >= least and iou(x, y) > 0)
