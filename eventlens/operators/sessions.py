"""Hysteresis sessionisation and gap merge: a verdict stream folded into timed events.

A span opens at a score of theta_high or more, goes on while scores stay at theta_low or more, and closes below
that; a hole in coverage longer than max_window_gap closes it too, before the next row is looked at. In
terms of prefix scans over one order (start, seq): the running maximum of ends finds the holes, a row's signal is 1, 0
or null for hold, a hole turns hold into 0, and the state is the last signal that isn't null. So every step is a
window function over the same partitioning and sort, and a feed is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.schema import NORMAL


def candidate_streams(verdicts: DataFrame, classes: DataFrame | None = None) -> DataFrame:
    """Each video's whole stream once per class it holds (other than normal), with x, the class's own score.

    Columns: video_id, class_name, seq, start, end, x. Distinct classes are few per video (the label set bounds them).
    """
    kinds = classes if classes is not None else verdicts.where(F.col("class_name") != NORMAL).select("video_id", "class_name").distinct()
    kinds = kinds.groupBy("video_id").agg(F.collect_set("class_name").alias("kinds"))
    each = verdicts.select("video_id", "seq", "start", "end", F.col("class_name").alias("said"), "score").join(kinds, "video_id")
    each = each.withColumn("class_name", F.explode("kinds"))
    x = F.when(F.col("said") == F.col("class_name"), F.col("score")).otherwise(0.0)
    return each.select("video_id", "class_name", "seq", "start", "end", x.alias("x"))


#: Policies that are broadcast or packed into one row, at most.
POLICIES = 10_000


def few(policies: DataFrame) -> DataFrame:
    """A hint to broadcast a policy table, whose size is checked."""
    if policies.count() > POLICIES:
        raise ValueError(f"more than {POLICIES} policies; sweep them in parts")
    return F.broadcast(policies)


def with_policy(streams: DataFrame, policies: DataFrame, names: list[str]) -> DataFrame:
    """Every stream under every policy (few rows, packed into one that is broadcast)."""
    few(policies)
    packed = policies.select(*names).distinct().agg(F.collect_list(F.struct(*names)).alias("_p"))
    each = streams.crossJoin(F.broadcast(packed)).withColumn("_p", F.explode("_p"))
    return each.select(*streams.columns, *(F.col(f"_p.{n}").alias(n) for n in names))


def spans(streams: DataFrame, keys: list[str]) -> DataFrame:
    """keys, span, start, end, score of streams with x, theta_high, theta_low and max_window_gap_sec."""
    order = Window.partitionBy(*keys).orderBy("start", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hole = F.coalesce(F.col("start") - F.max("end").over(before) > F.col("max_window_gap_sec"), F.lit(False))
    signal = F.when(F.col("x") >= F.col("theta_high"), 1).when(F.col("x") < F.col("theta_low"), 0)
    s = streams.withColumn("_hole", hole)
    s = s.withColumn("_signal", F.when(F.col("_hole"), F.coalesce(signal, F.lit(0))).otherwise(signal))
    s = s.withColumn("_on", F.coalesce(F.last("_signal", ignorenulls=True).over(upto), F.lit(0)))
    was = F.coalesce(F.lag("_on").over(order), F.lit(0))
    s = s.withColumn("_rise", F.when((F.col("_on") == 1) & ((was == 0) | F.col("_hole")), 1).otherwise(0))
    s = s.withColumn("span", F.sum("_rise").over(upto))
    return s.where("_on = 1").groupBy(*keys, "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("x").alias("score"))


def merge(found: DataFrame, keys: list[str]) -> DataFrame:
    """Joins spans whose gap is merge_gap_sec or less and drops events shorter than min_duration_sec."""
    order = Window.partitionBy(*keys).orderBy("start", "span")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(F.col("start") - F.max("end").over(before) > F.col("merge_gap_sec"), F.lit(True))
    m = found.withColumn("_new", new.cast("int"))
    m = m.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    out = m.groupBy(*keys, "_island", "min_duration_sec").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"))
    return out.where(F.col("end") - F.col("start") >= F.col("min_duration_sec")).select(*keys, "start", "end", "score")


#: Pairs of thresholds that share one scan; verdicts of a task of such a scan, about.
PAIRS, VERDICTS = 12, 30_000


def dealt(streams: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Streams of verdicts dealt out by video and class, to as many tasks as their number asks for.

    A sweep makes many rows of each within the task, so the size of what is shuffled says nothing of the memory it takes; tasks that Spark would join by it
    grow with the input. Small tables stay as they are.
    """
    n = verdicts.count() // VERDICTS + 1
    return streams if n == 1 else streams.repartition(n, "video_id", "class_name")


def spans_of_pairs(streams: DataFrame, keys: list[str], pairs: list[tuple[float, float, float]]) -> DataFrame:
    """keys, pair (its number), span, start, end, score of streams under many (theta_high, theta_low, max_window_gap_sec).

    As spans, but a feed is sorted once for PAIRS pairs: each has its own running state over the one order, and only rows of open spans go on.
    """
    order = Window.partitionBy(*keys).orderBy("start", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = None
    for first in range(0, len(pairs), PAIRS):
        some = list(enumerate(pairs))[first : first + PAIRS]
        s = streams.withColumn("_gap", F.col("start") - F.max("end").over(before))
        hole = {k: F.coalesce(F.col("_gap") > gap, F.lit(False)) for k, (_, _, gap) in some}
        signal = {k: F.when(F.col("x") >= hi, 1).when(F.col("x") < lo, 0) for k, (hi, lo, _) in some}
        s = s.withColumns({f"_signal{k}": F.when(hole[k], F.coalesce(signal[k], F.lit(0))).otherwise(signal[k]) for k, _ in some})
        s = s.withColumns({f"_on{k}": F.coalesce(F.last(f"_signal{k}", ignorenulls=True).over(upto), F.lit(0)) for k, _ in some})
        s = s.withColumns({f"_was{k}": F.coalesce(F.lag(f"_on{k}").over(order), F.lit(0)) for k, _ in some})
        rise = {k: F.when((F.col(f"_on{k}") == 1) & ((F.col(f"_was{k}") == 0) | hole[k]), 1).otherwise(0) for k, _ in some}
        s = s.withColumns({f"_span{k}": F.sum(rise[k]).over(upto) for k, _ in some})
        inside = F.filter(F.array(*(F.when(F.col(f"_on{k}") == 1, F.struct(F.lit(k).alias("pair"), F.col(f"_span{k}").alias("span"))) for k, _ in some)), lambda x: x.isNotNull())
        rows = s.select(*keys, "start", "end", "x", F.explode(inside).alias("p")).select(*keys, "p.pair", "p.span", "start", "end", "x")
        found = rows.groupBy(*keys, "pair", "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("x").alias("score"))
        out = found if out is None else out.unionByName(found)
    return out


def combinations(verdicts: DataFrame, policies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """video_id, class_name, combo, start, end, score, len of events, one combo for each pair of thresholds and merge gap; and the policies with combo and least.

    One sort of a pair's spans gives the gap before each of them, and every merge gap is a cut of that order: a span begins an event where its gap is
    larger. A least duration only leaves out events, so policies that differ in it share them (len).
    """
    few(policies)
    rows = policies.select("policy_id", "theta_high", "theta_low", "max_window_gap_sec", "merge_gap_sec", "min_duration_sec").collect()
    pairs = sorted({(r.theta_high, r.theta_low, r.max_window_gap_sec) for r in rows})
    combos = sorted({(pairs.index((r.theta_high, r.theta_low, r.max_window_gap_sec)), r.merge_gap_sec) for r in rows})
    each = [(r.policy_id, combos.index((pairs.index((r.theta_high, r.theta_low, r.max_window_gap_sec)), r.merge_gap_sec)), float(r.min_duration_sec)) for r in rows]
    spark, keys = verdicts.sparkSession, ["video_id", "class_name", "pair"]
    asked = spark.createDataFrame(each, "policy_id int, combo int, least double")
    found = spans_of_pairs(dealt(candidate_streams(verdicts), verdicts), keys[:2], pairs)
    order = Window.partitionBy(*keys).orderBy("start", "span")
    gaps = found.withColumn("_gap", F.col("start") - F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    sizes = sorted({g for _, g in combos})
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gaps = gaps.withColumns({f"_cut{k}": F.sum(F.coalesce(F.col("_gap") > g, F.lit(True)).cast("int")).over(upto) for k, g in enumerate(sizes)})
    number = spark.createDataFrame([(p, sizes.index(g), k) for k, (p, g) in enumerate(combos)], "pair int, size int, combo int")
    parts = F.array(*(F.struct(F.lit(k).alias("size"), F.col(f"_cut{k}").alias("event")) for k in range(len(sizes))))
    rows = gaps.select(*keys, "start", "end", "score", F.explode(parts).alias("c")).select(*keys, "c.size", "c.event", "start", "end", "score")
    events = rows.join(F.broadcast(number), ["pair", "size"]).groupBy("video_id", "class_name", "combo", "event").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"))
    return events.drop("event").withColumn("len", F.col("end") - F.col("start")), asked


def aggregate(verdicts: DataFrame, policies: DataFrame, chunk_sec: float | None = None) -> DataFrame:
    """policy_id, video_id, class_name, start, end, score for every policy at once; chunk_sec: for feeds too long for one task (hot_spans).

    Spans depend on the thresholds and the coverage gap alone, so policies that share those share the scan; merge gap
    and least duration are applied to the spans, which are far fewer than the verdicts.
    """
    scan = ["theta_high", "theta_low", "max_window_gap_sec"]
    keys = ["video_id", "class_name", *scan]
    streams = with_policy(candidate_streams(verdicts), policies, scan)
    found = spans(streams, keys) if chunk_sec is None else hot_spans(streams, keys, chunk_sec)
    each = found.join(few(policies), scan)
    return merge(each, ["policy_id", "video_id", "class_name"])


def aggregate_one(verdicts: DataFrame, **policy: float) -> DataFrame:
    """video_id, class_name, start, end, score under one policy (defaults from the schema)."""
    from eventlens.schema import policies

    return aggregate(verdicts, policies(verdicts.sparkSession, policy)).drop("policy_id")


def hot_spans(streams: DataFrame, keys: list[str], chunk_sec: float) -> DataFrame:
    """As spans, for feeds too long for one task: feeds are cut into chunks of time and scanned in two levels.

    Prefix scans run within chunks. Two summaries of one row a chunk carry the rest: the end of coverage before the chunk, which
    decides its holes, and then the state and number of spans before it, as only rows up to a chunk's first signal depend on them.
    """
    s = streams.withColumn("_chunk", F.floor(F.col("start") / chunk_sec))
    parts = [*keys, "_chunk"]
    order = Window.partitionBy(*parts).orderBy("start", "seq")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)

    def with_chunk(df: DataFrame, per_chunk: DataFrame) -> DataFrame:
        right = per_chunk.select(*(F.col(k).alias(f"_r_{k}") for k in parts), *(c for c in per_chunk.columns if c not in parts))
        cond = F.lit(True)
        for k in parts:
            cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        return df.join(right, cond).drop(*(f"_r_{k}" for k in parts))

    ends = s.groupBy(*parts).agg(F.max("end").alias("_max")).withColumn("_end0", F.max("_max").over(earlier)).drop("_max")
    rows = with_chunk(s, ends)
    before = F.greatest("_end0", F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    hole = F.coalesce(F.col("start") - before > F.col("max_window_gap_sec"), F.lit(False))
    signal = F.when(F.col("x") >= F.col("theta_high"), 1).when(F.col("x") < F.col("theta_low"), 0)
    rows = rows.withColumn("_hole", hole)
    rows = rows.withColumn("_signal", F.when(F.col("_hole"), F.coalesce(signal, F.lit(0))).otherwise(signal))
    rows = rows.withColumn("_said", F.last("_signal", ignorenulls=True).over(upto)).withColumn("_was", F.lag("_said").over(order))

    risen = (F.col("_said") == 1) & ((F.col("_was") == 0) | F.col("_hole"))
    opens = F.max(F.when(F.col("_was").isNull() & F.col("_said").isNotNull(), F.struct(F.col("_said").alias("said"), F.col("_hole").alias("hole"))))
    state = F.max_by("_said", F.when(F.col("_said").isNotNull(), F.struct("start", "seq")))
    sums = rows.groupBy(*parts).agg(state.alias("_last"), opens.alias("_first"), F.count_if(F.col("_was").isNotNull() & risen).alias("_rises"))
    sums = sums.withColumn("_on0", F.coalesce(F.last("_last", ignorenulls=True).over(earlier), F.lit(0)))
    first = F.coalesce((F.col("_first.said") == 1) & (F.col("_first.hole") | (F.col("_on0") == 0)), F.lit(False))
    sums = sums.withColumn("_span0", F.coalesce(F.sum(F.col("_rises") + first.cast("int")).over(earlier), F.lit(0)))

    rows = with_chunk(rows, sums.select(*parts, "_on0", "_span0"))
    on = F.coalesce("_said", "_on0")
    rise = (on == 1) & ((F.coalesce("_was", "_on0") == 0) | F.col("_hole"))
    rows = rows.withColumn("span", F.sum(rise.cast("int")).over(upto) + F.col("_span0")).where(on == 1)
    return rows.groupBy(*keys, "span").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("x").alias("score"))


def in_order(events: DataFrame, video: str = "video_id") -> DataFrame:
    """Events with place, 0, 1, ... within their video in order of start (untimed ones as 0) and class."""
    order = Window.partitionBy(video).orderBy(F.coalesce("start", F.lit(0.0)), "class_name")
    return events.withColumn("place", F.row_number().over(order) - 1)


def two_scales(verdicts: DataFrame, **policy: float) -> DataFrame:
    """Events of two-scale verdicts (video_id, scale, duration, class_name, start, end, score, seq): what each scale may say, in one stream.

    At equal times the short scale comes first.
    """
    from eventlens.operators.windows import routed

    stream = routed(verdicts).withColumn("seq", F.struct((F.col("scale") != "short").alias("long"), "seq"))
    return aggregate_one(stream.drop("scale", "duration"), **policy)


def aggregate_by_level(verdicts: DataFrame, meta: DataFrame, policies: DataFrame) -> DataFrame:
    """As aggregate, with each video under the policies of its level (policies has a column level; a video without one counts as level 1)."""
    levels = verdicts.select("video_id").distinct().join(meta.select("video_id", "level"), "video_id", "left")
    levels = levels.select("video_id", F.coalesce("level", F.lit(1)).alias("level"))
    allowed = levels.join(few(policies.select("policy_id", "level")), "level").select("video_id", "policy_id")
    return aggregate(verdicts, policies.drop("level")).join(allowed, ["video_id", "policy_id"], "left_semi")


def aggregate_by_class(verdicts: DataFrame, policies: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """policy_id, video_id, class_name, start, end, score, every class of every video under the policy that fits it best.

    policies: a policy a row, with class_name and level; null stands for all. One for the class and level comes before one for the class, that before one for
    the level, and that before one for all; of equals the lowest policy_id counts, and classes that none fits have no events. A video without a level
    counts as level 1. Policies are few and resolved once a video and class, beside the stream, not once a row under each.
    """
    names = ["policy_id", "theta_high", "theta_low", "merge_gap_sec", "min_duration_sec", "max_window_gap_sec"]
    few(policies)
    packed = policies.agg(F.collect_list(F.struct("class_name", "level", *names)).alias("_p"))
    streams = candidate_streams(verdicts)
    if meta is None:
        streams = streams.withColumn("_level", F.lit(1))
    else:
        levels = meta.groupBy("video_id").agg(F.max("level").cast("int").alias("_level"))
        streams = streams.join(levels, "video_id", "left").withColumn("_level", F.coalesce("_level", F.lit(1)))
    fits = F.filter("_p", lambda p: F.coalesce(p["class_name"] == F.col("class_name"), F.lit(True)) & F.coalesce(p["level"] == F.col("_level"), F.lit(True)))
    best = F.array_min(F.transform(fits, lambda p: F.struct(p["class_name"].isNull().alias("any_class"), p["level"].isNull().alias("any_level"), p["policy_id"].alias("policy_id"), p.alias("p"))))["p"]
    each = streams.crossJoin(F.broadcast(packed)).withColumn("_p", best).where("_p is not null")
    keys = ["video_id", "class_name", *names]
    each = each.select("video_id", "class_name", "seq", "start", "end", "x", *(F.col(f"_p.{n}").alias(n) for n in names))
    return merge(spans(each, keys), ["video_id", "class_name", "policy_id", "merge_gap_sec"]).select("policy_id", "video_id", "class_name", "start", "end", "score")


def gated(joined: DataFrame, columns: list[str], least: float) -> DataFrame:
    """Verdicts that have been met with _second, the other stream's score for their window (null: none): what doesn't reach `least` becomes normal."""
    keep = (F.col("class_name") == NORMAL) | (F.coalesce("_second", F.lit(0.0)) >= least)
    return joined.select(
        *[c for c in columns if c not in ("class_name", "score")],
        F.when(keep, F.col("class_name")).otherwise(F.lit(NORMAL)).alias("class_name"),
        F.when(keep, F.col("score")).otherwise(0.0).alias("score"),
    )


def gate(first: DataFrame, second: DataFrame, least: float = 0.95) -> DataFrame:
    """A positive verdict survives if the second stream's score for the same window reaches `least`; others become normal."""
    keys = ["video_id", "start", "end"]
    other = second.select(*keys, F.col("score").alias("_second"))
    return gated(first.join(other, keys, "left"), first.columns, least)
