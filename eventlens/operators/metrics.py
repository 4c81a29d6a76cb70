"""Precision, recall, confusion, per-level scores and report statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.operators.lineage import cut
from eventlens.operators.matching import by_policy, match, tallies
from eventlens.operators.scans import meet
from eventlens.schema import LEVEL_WEIGHTS, OFFICIAL_TAU


def ratio(a: Column, b: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def prf(tp: Column, fp: Column, fn: Column) -> list[Column]:
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return [p.alias("precision"), r.alias("recall"), ratio(2 * p * r, p + r).alias("f1")]


def by_tau_and_level(truth: DataFrame, preds: DataFrame, meta: DataFrame, taus: list[float]) -> DataFrame:
    """tau, level (null: overall), tp, fp, fn, precision, recall, f1, mean_iou.

    One packed match serves all thresholds, the overall figures and all levels: matching never crosses videos. Events of unknown videos
    count in the overall figures only. mean_iou is over timed pairs, null if there are none.
    """
    t = tallies(truth, preds, taus).join(meta.select("video_id", "level"), "video_id", "left")
    # Each tally counts for all videos and, if its level is known, for that level.
    marks = F.array_compact(F.array(F.lit(-1), F.col("level").cast("int")))
    t = t.withColumn("_level", F.explode(marks)).groupBy("tau", "_level")
    both = t.agg(*(F.sum(k).cast("bigint").alias(k) for k in ("tp", "fp", "fn")), F.try_divide(F.sum("iou"), F.sum("timed")).alias("mean_iou")).withColumn("level", F.nullif("_level", F.lit(-1)))
    return both.select("tau", "level", "tp", "fp", "fn", *prf(F.col("tp"), F.col("fp"), F.col("fn")), "mean_iou")


def video_meta(rows: DataFrame) -> DataFrame:
    """video_id, level, has_anomaly of ground-truth rows."""
    return rows.groupBy("video_id").agg(F.max("level").alias("level"), F.bool_or("is_anomaly").alias("has_anomaly"))


def confusion(meta: DataFrame, preds: DataFrame) -> DataFrame:
    """One row: tp, fp, fn, tn over videos (does it hold any event?), precision, recall, false_alarm_rate, n_normal."""
    said = preds.select("video_id").distinct().withColumn("said", F.lit(True))
    j = meta.join(said, "video_id", "left").withColumn("said", F.coalesce("said", F.lit(False)))
    has, s = F.col("has_anomaly"), F.col("said")
    c = j.agg(F.count_if(has & s).alias("tp"), F.count_if(~has & s).alias("fp"), F.count_if(has & ~s).alias("fn"), F.count_if(~has & ~s).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(fp, fp + tn).alias("false_alarm_rate"), (fp + tn).alias("n_normal"))


def class_recall(truth: DataFrame, pairs: DataFrame) -> DataFrame:
    """class_name, hits, total of classes that have true events."""
    hits = pairs.groupBy("class_name").agg(F.count(F.lit(1)).alias("h"))
    total = truth.groupBy("class_name").agg(F.count(F.lit(1)).alias("total"))
    return total.join(hits, "class_name", "left").select("class_name", F.coalesce("h", F.lit(0)).alias("hits"), "total")


def class_sets(meta: DataFrame, truth: DataFrame, preds: DataFrame) -> DataFrame:
    """video_id, level, gt and pred: the sets of classes on both sides (empty arrays where there are none)."""
    g = truth.groupBy("video_id").agg(F.collect_set("class_name").alias("gt"))
    p = preds.groupBy("video_id").agg(F.collect_set("class_name").alias("pred"))
    none = F.array().cast("array<string>")
    j = meta.select("video_id", "level").join(g, "video_id", "left").join(p, "video_id", "left")
    return j.select("video_id", "level", F.coalesce("gt", none).alias("gt"), F.coalesce("pred", none).alias("pred"))


def level1(meta: DataFrame, truth: DataFrame, preds: DataFrame) -> DataFrame:
    """One row: n_videos, acc_binary, acc_class and score of level 1 (half each)."""
    s = class_sets(meta.where("level = 1"), truth, preds)
    anomalous = F.size("gt") > 0
    agree, hit = anomalous == (F.size("pred") > 0), F.arrays_overlap("gt", "pred")
    c = s.agg(F.count(F.lit(1)).alias("n_videos"), F.count_if(agree).alias("b"), F.count_if(anomalous).alias("t"), F.count_if(anomalous & hit).alias("c"))
    b, k = ratio(F.col("b"), F.col("n_videos")), ratio(F.col("c"), F.col("t"))
    return c.select("n_videos", b.alias("acc_binary"), k.alias("acc_class"), (0.5 * b + 0.5 * k).alias("score"))


def level23(meta: DataFrame, truth: DataFrame, preds: DataFrame, weights: list[tuple] = LEVEL_WEIGHTS, tau: float = OFFICIAL_TAU) -> DataFrame:
    """video_id, level, is_normal, alert, match_f1, timing, tp, fp, fn, score of each video of levels 2 and 3."""
    pairs = match(truth, preds, tau, official=True).groupBy("video_id").agg(F.count(F.lit(1)).alias("tp"), F.sum("iou").alias("iou"))
    g = truth.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_gt"))
    p = preds.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_pred"))
    v = meta.where(F.col("level").isin([w[0] for w in weights])).select("video_id", "level")
    v = v.join(g, "video_id", "left").join(p, "video_id", "left").join(pairs, "video_id", "left").na.fill(0)
    pr, rc = ratio(F.col("tp"), F.col("n_pred")), ratio(F.col("tp"), F.col("n_gt"))
    v = v.withColumns({
        "is_normal": F.col("n_gt") == 0,
        "alert": F.when(F.col("n_pred") > 0, 1.0).otherwise(0.0),
        "match_f1": ratio(2 * pr * rc, pr + rc),
        "timing": ratio(F.col("iou"), F.col("tp")),
    })
    total = F.lit(None).cast("double")
    for level, alert, matched, timing in weights:
        total = F.when(F.col("level") == level, alert * F.col("alert") + matched * F.col("match_f1") + timing * F.col("timing")).otherwise(total)
    score = F.when(F.col("is_normal"), 1.0 - F.col("alert")).otherwise(total)
    return v.select("video_id", "level", "is_normal", "alert", "match_f1", "timing", "tp", (F.col("n_pred") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"), score.alias("score"))


def overall(meta: DataFrame, truth: DataFrame, preds: DataFrame) -> DataFrame:
    """level (null: overall), n_videos, score, n_normal_zeroed. The overall score is the mean of the levels that have videos."""
    one = level1(meta, truth, preds).select(F.lit(1).alias("level"), "n_videos", "score", F.lit(None).cast("bigint").alias("n_normal_zeroed")).where("n_videos > 0")
    rest = level23(meta, truth, preds).groupBy(F.col("level").cast("int").alias("level")).agg(
        F.count(F.lit(1)).alias("n_videos"), F.avg("score").alias("score"), F.count_if(F.col("is_normal") & (F.col("score") == 0)).alias("n_normal_zeroed")
    )
    # The levels are three rows at most, packed into one, so the total doesn't compute them again.
    packed = one.unionByName(rest).agg(F.collect_list(F.struct("level", "n_videos", "score", "n_normal_zeroed")).alias("l"))
    add = lambda f, kind: F.aggregate("l", F.lit(0).cast(kind), lambda a, x: a + F.coalesce(x[f], F.lit(0).cast(kind)))
    zeroed = F.when(F.exists("l", lambda x: x["n_normal_zeroed"].isNotNull()), add("n_normal_zeroed", "bigint"))
    total = F.struct(F.lit(None).cast("int").alias("level"), add("n_videos", "bigint").alias("n_videos"), ratio(add("score", "double"), F.size("l")).alias("score"), zeroed.alias("n_normal_zeroed"))
    return packed.select(F.explode(F.concat("l", F.array(total))).alias("x")).select("x.*")


def overall_by_policy(meta: DataFrame, truth: DataFrame, found: DataFrame, policies: DataFrame, weights: list[tuple] = LEVEL_WEIGHTS, tau: float = OFFICIAL_TAU) -> DataFrame:
    """policy_id, level1, level2, level3 (null without videos), overall of the events of many policies (see matching.by_policy), all in one plan.

    Only videos where a policy has events get a row for it. The others' scores are known without one: 1 where nothing happens, 0 elsewhere, so they are counted.
    """
    ids = policies.select("policy_id")
    per_class = by_policy(truth, found, policies, tau, True)
    true = truth.groupBy("video_id", "class_name").agg(F.count(F.lit(1)).alias("g"))
    hit = F.max((F.col("g") > 0).cast("int"))
    each = per_class.join(true, ["video_id", "class_name"], "left").groupBy("policy_id", "video_id").agg(F.sum("n").alias("n"), F.sum("tp").alias("tp"), F.sum("iou").alias("iou"), F.coalesce(hit, F.lit(0)).alias("hit"))
    videos = meta.select("video_id", F.col("level").cast("int").alias("level")).where(F.col("level").isin(1, *(w[0] for w in weights)))
    videos = videos.join(true.groupBy("video_id").agg(F.sum("g").alias("g")), "video_id", "left").na.fill(0, ["g"])
    v = each.join(videos, "video_id")
    pr, rc = ratio(F.col("tp"), F.col("n")), ratio(F.col("tp"), F.col("g"))
    f1, timing = ratio(2 * pr * rc, pr + rc), ratio(F.col("iou"), F.col("tp"))
    score = F.lit(None).cast("double")
    for level, alert, matched, weight in weights:
        score = F.when(F.col("level") == level, alert + matched * f1 + weight * timing).otherwise(score)
    quiet = F.col("g") == 0
    sums = v.groupBy("policy_id", "level").agg(F.sum(F.when(quiet, 0.0).otherwise(score)).alias("sum"), F.count_if(quiet).alias("alarms"), F.count_if(~quiet).alias("seen"), F.sum("hit").alias("hits"))
    levels = videos.groupBy("level").agg(F.count(F.lit(1)).alias("videos"), F.count_if(quiet).alias("quiet"), F.count_if(~quiet).alias("events"))
    j = ids.crossJoin(F.broadcast(levels)).join(F.broadcast(sums), ["policy_id", "level"], "left").na.fill(0, ["alarms", "seen", "hits"]).na.fill(0.0, ["sum"])
    agree = F.col("seen") + F.col("quiet") - F.col("alarms")
    one = 0.5 * ratio(agree, F.col("videos")) + 0.5 * ratio(F.col("hits"), F.col("events"))
    j = j.withColumn("score", F.when(F.col("level") == 1, one).otherwise(ratio(F.col("sum") + F.col("quiet") - F.col("alarms"), F.col("videos"))))
    out = j.groupBy("policy_id").agg(*(F.max(F.when(F.col("level") == k, F.col("score"))).alias(f"level{k}") for k in (1, 2, 3)), F.avg("score").alias("overall"))
    return ids.join(out, "policy_id", "left").na.fill(0.0, ["overall"])


def latency_bonus(calls: DataFrame, videos: DataFrame) -> DataFrame:
    """One row: seconds of reported processing over seconds of video. calls: window_ms; videos: duration_sec."""
    spent = calls.agg(F.sum(F.coalesce("window_ms", F.lit(0.0))).alias("ms"))
    long = videos.agg(F.sum("duration_sec").alias("sec"))
    return spent.crossJoin(long).select(ratio(F.col("ms") / 1000, F.col("sec")).alias("ratio"))


def mean_components(per_video: DataFrame) -> DataFrame:
    """Means of alert, match_f1 and timing over videos that hold events, by level."""
    return per_video.where("not is_normal").groupBy("level").agg(F.avg("alert").alias("alert"), F.avg("match_f1").alias("match_f1"), F.avg("timing").alias("timing"))


def class_counts(df: DataFrame, cls: str = "class_name") -> DataFrame:
    return df.groupBy(cls).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), cls)


def anomaly_rate(verdicts: DataFrame) -> DataFrame:
    """n_windows, n_anomalous and their rate (0 for none)."""
    c = verdicts.agg(F.count(F.lit(1)).alias("n_windows"), F.count_if(F.col("class_name") != "normal").alias("n_anomalous"))
    return c.withColumn("rate", ratio(F.col("n_anomalous"), F.col("n_windows")))


def latency(df: DataFrame, keys: list[str], ms: str, digits: int = 1) -> DataFrame:
    """keys, call_count, total, average, p50, p95, max (half-even rounded to digits), by nearest rank.

    Ranks come from the counts of distinct values: values are counted before the shuffle, and a running sum over
    them finds the ones at the two ranks, so no group is gathered into an array.
    """
    counts = df.groupBy(*keys, F.col(ms).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    order = Window.partitionBy(*keys).orderBy("_x")
    run = counts.withColumn("_upto", F.sum("_n").over(order)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*keys)))

    def at(p: float) -> Column:
        rank = F.bround(p * (F.col("_all") - 1), 0)
        return F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col("_x")))

    out = run.groupBy(*keys).agg(F.sum("_n").alias("call_count"), F.sum(F.col("_x") * F.col("_n")).alias("_t"), at(0.5).alias("_50"), at(0.95).alias("_95"), F.max("_x").alias("_max"))
    return out.select(
        *keys, "call_count", F.bround("_t", digits).alias("total_time_ms"), F.bround(F.col("_t") / F.col("call_count"), digits).alias("average_time_ms"),
        F.bround("_50", digits).alias("p50_time_ms"), F.bround("_95", digits).alias("p95_time_ms"), F.bround("_max", digits).alias("max_time_ms"),
    )


#: Ranges a level of counts cuts a group's values into; values left in a range, about, that are sorted.
RANGES, CELL = 1024, 65_536
_MOST = 1.7976931348623157e308


def nth_values(df: DataFrame, keys: list[str], x: str, targets: DataFrame, largest: int) -> DataFrame:
    """keys, which, value: of each group's values in ascending order the one at rank `at` (from 0); nulls and NaN aren't values.

    targets: keys, which, at. largest: values of the largest group. Values are counted by ranges between the group's least and greatest; the range with the rank is
    cut into ranges again, until some CELL values are left, whose distinct ones are counted and scanned. So what is shuffled and sorted are
    counts, however large a group is.
    """
    r = df.select(*keys, F.col(x).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    by = [*keys, "which"]
    state = meet(targets.select(*keys, "which", F.col("at").cast("bigint").alias("_left")), r.groupBy(*keys).agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi")), keys)
    inside = lambda: meet(r, state, keys).where("_lo <= _x and _x <= _hi")
    half = lambda c: F.least(F.greatest(F.col(c), F.lit(-_MOST)), F.lit(_MOST)) / 2

    def found(counts: DataFrame, order: str) -> DataFrame:
        counts = counts.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy(order)))
        return counts.where((F.col("_upto") > F.col("_left")) & (F.col("_upto") - F.col("_n") <= F.col("_left")))

    while largest > CELL:
        part = F.try_divide(half("_x") - half("_lo"), half("_hi") - half("_lo"))
        cells = inside().withColumn("_cell", F.least(F.floor(F.coalesce(part, F.lit(0.0)) * RANGES), F.lit(RANGES - 1)))
        counts = cells.groupBy(*by, "_left", "_cell").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        state = cut(found(counts, "_cell").select(*by, (F.col("_left") - F.col("_upto") + F.col("_n")).alias("_left"), "_lo", "_hi", "_n"))
        largest = state.where("_lo < _hi").agg(F.max("_n")).first()[0] or 0
        state = state.drop("_n")
    values = inside().groupBy(*by, "_left", "_x").agg(F.count(F.lit(1)).alias("_n"))
    return found(values, "_x").select(*by, F.col("_x").alias("value"))


def medians(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, median: exact, the mean of the two middle values of an even number of them; groups without a value are left out."""
    n = df.where(F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double"))).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    largest = n.agg(F.max("n")).first()[0] or 0
    middle = F.array_distinct(F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)))
    targets = n.select(*keys, F.posexplode(middle).alias("which", "at"))
    return nth_values(df, keys, x, targets, largest).groupBy(*keys).agg(F.avg("value").alias("median"))


def spread(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """keys, median, min, max, stdev (sample; 0 below two values)."""
    rest = df.groupBy(*keys).agg(F.min(x).alias("min"), F.max(x).alias("max"), F.coalesce(F.stddev_samp(x), F.lit(0.0)).alias("stdev"))
    return meet(rest, medians(df, keys, x), keys, "left").select(*keys, "median", "min", "max", "stdev")


def realtime(df: DataFrame, keys: list[str], x: str, stride: float) -> DataFrame:
    """keys, median, keeps_up (median within the stride), drop (share of windows to skip)."""
    m = medians(df, keys, x)
    return m.select(*keys, "median", (F.col("median") <= stride).alias("keeps_up"), F.greatest(F.lit(0.0), 1 - F.try_divide(F.lit(stride), F.col("median"))).alias("drop"))


def aba(df: DataFrame, config: str, run: str, value: str, tolerance: float = 5.0) -> DataFrame:
    """config, a1, b, a2 (medians by pass), drift in per cent of a1 and a verdict."""
    m = medians(df.where(F.col(run).isin("A1", "B", "A2")), [config, run], value)
    m = m.groupBy(config).pivot(run, ["A1", "B", "A2"]).agg(F.max("median"))
    drift = 100 * F.abs(F.col("A2") - F.col("A1")) / F.nullif(F.col("A1"), F.lit(0.0))
    out = m.select(config, F.col("A1").alias("a1"), F.col("B").alias("b"), F.col("A2").alias("a2"), drift.alias("drift_pct"))
    return out.withColumn("verdict", F.when(F.col("drift_pct").isNull(), "incomplete").when(F.col("drift_pct") > tolerance, "unstable").when(F.col("b") < F.least("a1", "a2"), "b faster").when(F.col("b") > F.greatest("a1", "a2"), "b slower").otherwise("within noise"))


def coverage(timelines: DataFrame) -> DataFrame:
    """One row: seconds of events over seconds of video, of timelines (duration_sec, events)."""
    inside = F.aggregate("events", F.lit(0.0), lambda s, e: s + e["end_time_sec"] - e["start_time_sec"])
    return timelines.agg(ratio(F.sum(inside), F.sum("duration_sec")).alias("coverage"))
