"""Policy sweeps: a grid of policies scored in one plan."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.operators import metrics
from eventlens.operators.lineage import cut
from eventlens.operators.matching import by_policy
from eventlens.operators.refine import refine_by_level
from eventlens.operators.sessions import combinations
from eventlens.schema import DEFAULT_POLICY, POLICY

#: The grid of a sweep.
HIGH, LOW, GAP, LEAST = [0.3, 0.5, 0.7, 0.9], [0.2, 0.35, 0.5], [0.0, 5.0, 15.0, 30.0], [0.0, 4.0, 10.0]


def grid(spark: SparkSession, high: list[float] = HIGH, low: list[float] = LOW, gap: list[float] = GAP, least: list[float] = LEAST) -> DataFrame:
    """All combinations with low <= high, numbered in order of the lists."""
    rows = [(h, lo, g, d) for h, lo, g, d in itertools.product(high, low, gap, least) if lo <= h]
    return spark.createDataFrame([(k, *r, DEFAULT_POLICY["max_window_gap_sec"]) for k, r in enumerate(rows)], POLICY)


def sweep(verdicts: DataFrame, truth: DataFrame, policies: DataFrame, tau: float = 0.1, top: int = 12) -> DataFrame:
    """The best policies by F1, precision, recall, then number of events and parameters (all descending).

    Verdicts are sorted once for all policies, and the truth is met once: policies that share thresholds and merge gap share their events, and every policy is a
    fold over its own part of them.
    """
    found, asked = combinations(verdicts, policies)
    found = cut(found)
    counts = by_policy(truth, found, asked, tau, False).groupBy("policy_id").agg(F.sum("n").cast("bigint").alias("n_events"), F.sum("tp").cast("bigint").alias("tp"))
    gt = truth.agg(F.count(F.lit(1)).alias("n_gt"))
    j = policies.join(F.broadcast(counts), "policy_id", "left").na.fill(0, ["n_events", "tp"]).crossJoin(F.broadcast(gt))
    tp = F.col("tp")
    scored = j.select("policy_id", "theta_high", "theta_low", "merge_gap_sec", "min_duration_sec", "n_events", "tp", *metrics.prf(tp, F.col("n_events") - tp, F.col("n_gt") - tp))
    order = [F.desc(c) for c in ("f1", "precision", "recall", "n_events", "theta_high", "theta_low", "merge_gap_sec", "min_duration_sec")]
    return scored.orderBy(*order).limit(top)


def sweep_overall(verdicts: DataFrame, truth: DataFrame, meta: DataFrame, policies: DataFrame, refine: str = "midpoint", window: float = 4.0, top: int = 10, threshold: float = 0.5) -> DataFrame:
    """The best policies by overall score: policy_id, its parameters, level1, level2, level3, overall.

    Events of levels 2 and up are refined (any mode of refine.refine) before they are scored, after the least duration has left out short ones. Interpolation
    reads a video's verdicts once for the events of all policies. Equal scores go in order of policy_id.
    """
    found, asked = combinations(verdicts, policies)
    found = cut(refine_by_level(cut(found), verdicts, meta, mode=refine, window=window, threshold=threshold))
    scored = policies.join(metrics.overall_by_policy(meta, truth, found, asked), "policy_id")
    names = ["policy_id", "theta_high", "theta_low", "merge_gap_sec", "min_duration_sec", "level1", "level2", "level3", "overall"]
    return scored.select(*names).orderBy(F.desc("overall"), "policy_id").limit(top)
