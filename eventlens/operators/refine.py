"""Boundary refinement: shrinking to window centres and interpolated threshold crossings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventlens.functions.intervals import midpoint
from eventlens.operators.scans import running
from eventlens.schema import NORMAL


def shrink(events: DataFrame, window: float) -> DataFrame:
    """Edges pulled in by half a window; what collapses is its centre plus and minus a quarter second; rounded to 3."""
    s, e = F.col("start") + window / 2, F.col("end") - window / 2
    centre = midpoint(F.col("start"), F.col("end"))
    gone = e <= s
    new_s, new_e = F.when(gone, centre - 0.25).otherwise(s), F.when(gone, centre + 0.25).otherwise(e)
    timed = F.col("start").isNotNull() & F.col("end").isNotNull()
    return events.withColumns({"start": F.when(timed, F.bround(new_s, 3)).otherwise(F.col("start")), "end": F.when(timed, F.bround(new_e, 3)).otherwise(F.col("end"))})


def interpolate(events: DataFrame, verdicts: DataFrame, threshold: float = 0.5, width: float | None = None) -> DataFrame:
    """Starts moved to the first rise that ends at or after them, ends to the last fall that begins at or before them.

    events: video_id, class_name, start, end and any others. A class's score at window centres crosses the threshold between two of them; the crossing is
    interpolated. Events and centres stand in one order per video and class: the scan backwards carries the next rise to each start, the scan
    forwards the last fall to each end. What would end before it starts stays, as do untimed events. width: seconds of a range, for feeds too long
    for one task (scans.running).
    """
    keys = ["video_id", "class_name"]
    kinds = verdicts.where(F.col("class_name") != NORMAL).groupBy("video_id").agg(F.collect_set("class_name").alias("kinds"))
    each = verdicts.select("video_id", midpoint(F.col("start"), F.col("end")).alias("t"), F.col("class_name").alias("said"), "score").where("t is not null").join(kinds, "video_id")
    each = each.withColumn("class_name", F.explode("kinds"))
    x = F.when(F.col("said") == F.col("class_name"), F.col("score")).otherwise(0.0)
    whole = F.struct(*events.columns)
    none = F.lit(None).cast("double")
    points = each.select(*keys, F.lit(False).alias("own"), "t", x.alias("x"), F.lit(None).cast(events.select(whole.alias("e")).schema["e"].dataType).alias("e"))
    both = points.unionByName(events.select(*keys, F.lit(True).alias("own"), none.alias("t"), none.alias("x"), whole.alias("e")))

    # The next centre: the last one before in the falling order of time.
    both = both.withColumns({"_t": -F.coalesce("t", F.lit(0.0)), "_x": -F.coalesce("x", F.lit(0.0)), "at": F.when(~F.col("own"), F.struct("t", "x"))})
    c = running(both, [*keys, "own"], ["_t", "_x"], "at", "next", current=False, width=width)
    t, v, t2, v2 = F.col("t"), F.col("x"), F.col("next.t"), F.col("next.x")
    up, down = (v < threshold) & (v2 >= threshold), (v2 < threshold) & (v >= threshold)
    rise, fall = t + (threshold - v) / (v2 - v) * (t2 - t), t2 + (threshold - v2) / (v - v2) * (t - t2)
    c = c.where(F.col("own") | up | down).select(
        *keys, "own", "e", F.when(up, rise).alias("rise"), F.when(down, fall).alias("fall"),
        # Backwards: rises by their end, an event by its start and after a rise at the same time; forwards: falls by their beginning, an event by its end and after.
        (-F.coalesce(F.when(F.col("own"), F.col("e.start")).otherwise(t2), F.lit(0.0))).alias("back"), F.coalesce(F.when(F.col("own"), F.col("e.end")).otherwise(t), F.lit(0.0)).alias("on"), (-t).alias("_t"), t2.alias("_t2"), (-rise).alias("_rise"), fall.alias("_fall"),
    )
    c = running(c, keys, ["back", "own", "_t", "_rise"], "rise", "new_start", width=width)
    c = running(c, keys, ["on", "own", "_t2", "_fall"], "fall", "new_end", width=width).where("own")
    s = F.when(F.col("e.start").isNotNull(), F.coalesce("new_start", "e.start"))
    e = F.when(F.col("e.end").isNotNull(), F.coalesce("new_end", "e.end"))
    moved = {"start": s, "end": e}
    ok = F.coalesce(e > s, F.lit(False))
    return c.select(*(F.when(ok, moved[n]).otherwise(F.col(f"e.{n}")).alias(n) if n in moved else F.col(f"e.{n}").alias(n) for n in events.columns))


def refine(events: DataFrame, verdicts: DataFrame, mode: str = "none", window: float = 4.0, threshold: float = 0.5) -> DataFrame:
    """none, midpoint, interpolate, or both (interpolation, then rounding)."""
    if mode not in ("none", "midpoint", "interpolate", "both"):
        raise ValueError(f"unknown mode {mode!r}")
    if mode == "none":
        return events
    if mode == "midpoint":
        return shrink(events, window)
    moved = interpolate(events, verdicts, threshold)
    return moved if mode == "interpolate" else shrink(moved, 0.0)


def refine_by_level(events: DataFrame, verdicts: DataFrame, meta: DataFrame, **how) -> DataFrame:
    """Refines events of levels 2 and up; a video without a level counts as level 1."""
    tagged = events.join(meta.select("video_id", F.col("level").alias("_level")), "video_id", "left").withColumn("_level", F.coalesce("_level", F.lit(1)))
    upper = refine(tagged.where("_level >= 2"), verdicts, **how)
    return tagged.where("_level < 2").unionByName(upper).select(*events.columns)
