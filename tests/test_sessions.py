"""Hysteresis and merging: hand-computed cases and a plain state machine on random feeds."""

import random

import pytest
from pyspark.sql import functions as F

from eventlens import schema as S
from eventlens.operators import sessions

FEED = [(0, 4, "fire", 0.6), (4, 8, "fire", 0.4), (8, 12, "normal", 0.0), (12, 16, "fire", 0.45), (16, 20, "fire", 0.9), (20, 24, "smoke", 0.8), (40, 44, "fire", 0.7)]


def verdicts(spark, rows, video="v"):
    return spark.createDataFrame([(video, k, float(s), float(e), c, float(x)) for k, (s, e, c, x) in enumerate(rows)], "video_id string, seq long, start double, end double, class_name string, score double")


def events(df):
    return sorted((r.start, r.end, r.class_name, r.score) for r in df.collect())


@pytest.mark.parametrize(
    ("policy", "want"),
    [
        ({}, [(0, 8, "fire", 0.6), (16, 20, "fire", 0.9), (20, 24, "smoke", 0.8), (40, 44, "fire", 0.7)]),
        ({"merge_gap_sec": 8}, [(0, 20, "fire", 0.9), (20, 24, "smoke", 0.8), (40, 44, "fire", 0.7)]),
        ({"min_duration_sec": 8}, [(0, 8, "fire", 0.6)]),
    ],
)
def test_hand_computed(spark, policy, want):
    assert events(sessions.aggregate_one(verdicts(spark, FEED), **policy)) == want


@pytest.mark.parametrize(("start", "want"), [(12.0, [(0, 16, "fire", 0.9)]), (12.5, [(0, 4, "fire", 0.9)])])
def test_coverage_break(spark, start, want):
    assert events(sessions.aggregate_one(verdicts(spark, [(0, 4, "fire", 0.9), (start, start + 4, "fire", 0.4)]))) == want


def test_empty_and_all_normal(spark):
    assert events(sessions.aggregate_one(verdicts(spark, []))) == []
    assert events(sessions.aggregate_one(verdicts(spark, [(0, 4, "normal", 0.0)]))) == []


def machine(rows, cls, hi, lo, merge, least, hole):
    """A scan with explicit state; rows are in order."""
    spans, span, cover = [], None, None
    for s, e, c, x in rows:
        x = x if c == cls else 0.0
        if span and cover is not None and s - cover > hole:
            spans.append(span)
            span = None
        if span is None:
            span = [s, e, x] if x >= hi else None
        elif x >= lo:
            span[1], span[2] = max(span[1], e), max(span[2], x)
        else:
            spans.append(span)
            span = None
        cover = e if cover is None else max(cover, e)
    spans += [span] if span else []
    out = []
    for s, e, x in spans:
        if out and s - out[-1][1] <= merge:
            out[-1][1], out[-1][2] = max(out[-1][1], e), max(out[-1][2], x)
        else:
            out.append([s, e, x])
    return [(s, e, cls, x) for s, e, x in out if e - s >= least]


@pytest.mark.parametrize("seed", range(3))
def test_random_feeds(spark, seed):
    rng = random.Random(seed)
    feeds, all_rows = {}, []
    for v in range(40):
        rows, t = [], 0.0
        for _ in range(rng.randint(1, 40)):
            t += rng.choice([0, 2, 4, 4, 9, 14])
            rows.append((t, t + rng.choice([4, 4, 32]), rng.choice(["fire", "smoke", "normal"]), round(rng.random(), 2)))
        rows.sort(key=lambda r: r[0])
        feeds[f"v{v}"] = rows
        all_rows += [(f"v{v}", k, *r) for k, r in enumerate(rows)]
    rng.shuffle(all_rows)
    df = spark.createDataFrame(all_rows, "video_id string, seq long, start double, end double, class_name string, score double")
    grid = [{"theta_high": 0.5, "theta_low": 0.35}, {"theta_high": 0.7, "theta_low": 0.2, "merge_gap_sec": 0}, {"theta_high": 0.5, "theta_low": 0.5, "merge_gap_sec": 15, "min_duration_sec": 10}]
    got = {}
    for r in sessions.aggregate(df, S.policies(spark, *grid)).collect():
        got.setdefault((r.policy_id, r.video_id), []).append((r.start, r.end, r.class_name, r.score))
    for k, g in enumerate(grid):
        p = S.DEFAULT_POLICY | g
        for v, rows in feeds.items():
            want = [e for c in ("fire", "smoke") for e in machine(rows, c, p["theta_high"], p["theta_low"], p["merge_gap_sec"], p["min_duration_sec"], p["max_window_gap_sec"])]
            assert sorted(got.get((k, v), [])) == sorted(want)
    streams = sessions.with_policy(sessions.candidate_streams(df), S.policies(spark, *grid), ["theta_high", "theta_low", "max_window_gap_sec"])
    keys = ["video_id", "class_name", "theta_high", "theta_low", "max_window_gap_sec"]
    plain, hot = sessions.spans(streams, keys), sessions.hot_spans(streams, keys, 25.0)
    assert sorted(map(tuple, plain.drop("span").collect())) == sorted(map(tuple, hot.drop("span").collect()))


def test_low_above_high_is_refused(spark):
    with pytest.raises(ValueError, match="theta_low"):
        S.policies(spark, {"theta_low": 0.9})


def test_gate(spark):
    first = verdicts(spark, [(0, 4, "fire", 0.6), (4, 8, "smoke", 0.7), (8, 12, "normal", 0.0)])
    second = first.withColumn("score", F.when(F.col("seq") == 0, 0.95).otherwise(0.5))
    assert [(r.seq, r.class_name, r.score) for r in sessions.gate(first, second).orderBy("seq").collect()] == [(0, "fire", 0.6), (1, "normal", 0.0), (2, "normal", 0.0)]


def test_policies_by_class(spark):
    """The closest fit counts: class and level, class, level, all; without a fit there are no events. Against the plain machine."""
    rng = random.Random(21)
    rows = {v: [(4.0 * k, 4.0 * k + 4, rng.choice(["fire", "smoke", "fighting_or_violence", "normal"]), round(rng.random(), 2)) for k in range(40)] for v in "abc"}
    df = spark.createDataFrame([(v, k, *r) for v, l in rows.items() for k, r in enumerate(l)], "video_id string, seq long, start double, end double, class_name string, score double")
    meta = spark.createDataFrame([("a", 2), ("b", 3)], "video_id string, level int")
    table = [({"theta_high": 0.6}, None, 3), ({"theta_high": 0.8, "merge_gap_sec": 0.0}, "fire", None), ({"theta_high": 0.4, "theta_low": 0.1, "min_duration_sec": 9.0}, "fire", 2), ({"theta_high": 0.5}, "smoke", 1)]
    pol = S.policies(spark, *(p for p, _, _ in table))
    more = spark.createDataFrame([(k, c, n) for k, (_, c, n) in enumerate(table)], "policy_id int, class_name string, level int")
    got = {}
    for r in sessions.aggregate_by_class(df, pol.join(more, "policy_id"), meta).collect():
        got.setdefault((r.video_id, r.class_name, r.policy_id), []).append((r.start, r.end, r.class_name, r.score))
    fits = {("a", "fire"): 2, ("b", "fire"): 1, ("c", "fire"): 1, ("b", "smoke"): 0, ("c", "smoke"): 3, ("b", "fighting_or_violence"): 0}
    want = {}
    for (v, c), k in fits.items():
        p = S.DEFAULT_POLICY | table[k][0]
        found = machine(rows[v], c, p["theta_high"], p["theta_low"], p["merge_gap_sec"], p["min_duration_sec"], p["max_window_gap_sec"])
        if found:
            want[v, c, k] = sorted(found)
    assert {k: sorted(x) for k, x in got.items()} == want
    # Without levels every video counts as level 1.
    assert {r.class_name for r in sessions.aggregate_by_class(df, pol.join(more, "policy_id")).collect()} == {"fire", "smoke"}
