"""Timeline synthesis: event clips laid into background, with their intervals moved to the timeline.

All draws are hashes of (seed, video, slot), so a rerun agrees and every video is built where its rows are. Clip pools
are numbered once and met by their number; a video's own rows are few (its slots), never the pool.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventlens.operators.lineage import cut

#: Target seconds, share of them covered by events, events per video.
TARGET_SEC, TARGET_COVERAGE, PER_VIDEO = 240.0, 0.08, (1, 6)
#: Filler of this length or less isn't laid.
LEAST_FILLER = 0.5
#: Background clips that a gap draws at first beyond those that would fill it twice.
DRAWS = 4
_UNIT = float(1 << 53)


def draw(seed: int, *what: Column) -> Column:
    """A uniform double in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), *what), F.lit(1 << 53)) / _UNIT


def numbered(pool: DataFrame, order: str) -> DataFrame:
    """The pool with pool_no 1..n in order of a key. Ranges of it are sorted, each by itself, and a range begins after the rows of those before it.

    The sorted ranges are evaluated once (lineage.cut): rows and sizes must be of the same ranges, whose bounds are sampled anew in every evaluation.
    """
    ranged = pool.repartitionByRange(F.col(order)).sortWithinPartitions(order)
    # A row's number within its partition is in the lower 33 bits, the partition's above.
    ranged = cut(ranged.withColumn("_m", F.monotonically_increasing_id()))
    ranged = ranged.withColumns({"_p": F.shiftright("_m", 33), "_r": F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = ranged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    sizes = sizes.select(F.col("_p").alias("_q"), F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(sizes), F.col("_p") == F.col("_q")).withColumn("pool_no", F.col("_before") + F.col("_r") + 1).drop("_m", "_p", "_q", "_r", "_before")


def timelines(videos: DataFrame, normals: DataFrame, anomalies: DataFrame, seed: int = 0, target: float = TARGET_SEC, share: float = TARGET_COVERAGE) -> DataFrame:
    """video_id, duration_sec, segments, events of each of videos (video_id, pure).

    normals: path, duration. anomalies: path, class_name, start, end, duration. Pure videos get no events; videos whose pool has
    nothing usable are left out. Per video 1 to 6 events; clips that would exceed 1.5 times the budget are passed over, but not the first.
    """
    backgrounds = normals.where(F.col("duration") > LEAST_FILLER)
    stats = backgrounds.agg(F.count(F.lit(1)).alias("n"), F.min("duration").alias("least"), F.avg("duration").alias("mean")).first()
    if not stats.n:
        raise ValueError(f"no background clip is longer than {LEAST_FILLER} s")
    n_bad = anomalies.count()
    budget = target * share * 1.5
    low, high = PER_VIDEO
    v = videos.select("video_id", "pure").withColumn("n_events", (F.floor(draw(seed, F.col("video_id"), F.lit("n")) * (high - low + 1)) + low).cast("int"))

    slots = v.where(~F.col("pure")).withColumn("slot", F.explode(F.sequence(F.lit(1), F.col("n_events") * 4)))
    slots = slots.withColumn("pool_no", F.floor(draw(seed, F.col("video_id"), F.col("slot")) * n_bad).cast("bigint") + 1)
    slots = slots.groupBy("video_id", "n_events", "pool_no").agg(F.min("slot").alias("slot"))
    clip = F.struct("slot", "path", "class_name", "start", "end", F.col("duration").cast("double").alias("duration"))
    drawn = slots.join(numbered(anomalies, "path"), "pool_no").where("duration > 0")
    drawn = drawn.groupBy("video_id", "n_events").agg(F.array_sort(F.collect_list(clip)).alias("clips"))
    kind = drawn.schema["clips"].dataType.simpleString()
    empty = F.struct(F.array().cast(kind).alias("chosen"), F.lit(0.0).alias("used"))

    def take(acc, c):
        full = F.size(acc["chosen"]) >= F.col("n_events")
        over = (acc["used"] + c["duration"] > budget) & (F.size(acc["chosen"]) > 0)
        return F.when(full | over, acc).otherwise(F.struct(F.concat(acc["chosen"], F.array(c)).alias("chosen"), (acc["used"] + c["duration"]).alias("used")))

    chosen = drawn.withColumn("f", F.aggregate("clips", empty, take)).select("video_id", "f.chosen", "f.used")
    if not n_bad:
        chosen = chosen.where("false")
    v = v.join(chosen, "video_id", "left").where(F.col("pure") | F.col("chosen").isNotNull() | F.lit(n_bad == 0))
    v = v.select("video_id", F.coalesce("chosen", F.array().cast(kind)).alias("chosen"), F.coalesce("used", F.lit(0.0)).alias("used"))
    filler = F.greatest(F.lit(0.0), target - F.col("used"))
    spots = F.array_sort(F.transform("chosen", lambda c: draw(seed, F.col("video_id"), F.lit("gap"), c["slot"])))
    v = v.withColumn("edges", F.transform(F.concat(F.array(F.lit(0.0)), spots, F.array(F.lit(1.0))), lambda x: x * filler))

    parts = v.select("video_id", F.posexplode(F.sequence(F.lit(0), F.size("chosen"))).alias("k", "_k"), "chosen", "edges")
    parts = parts.select("video_id", "k", (F.get("edges", F.col("k") + 1) - F.get("edges", F.col("k"))).alias("gap"), F.get("chosen", F.col("k")).alias("clip"))

    # Draws that clips of the mean length, twice over, would fill a gap with come first, and only gaps that are still open draw the rest.
    gaps = parts.where(F.col("gap") > LEAST_FILLER).select("video_id", "k", "gap", F.ceil(F.col("gap") / stats.least).cast("int").alias("most"))
    gaps = gaps.withColumn("soon", F.least("most", F.ceil(2 * F.col("gap") / stats.mean).cast("int") + DRAWS))
    pool = numbered(backgrounds, "path").select("pool_no", "path", F.col("duration").cast("double").alias("duration"))

    def drawn_fill(rows: DataFrame, first: Column, last: Column) -> DataFrame:
        each = rows.select("video_id", "k", "gap", F.explode(F.sequence(first, last)).alias("j"))
        each = each.withColumn("pool_no", F.floor(draw(seed, F.col("video_id"), F.col("k"), F.lit("fill"), F.col("j")) * stats.n).cast("bigint") + 1)
        return each.join(pool, "pool_no")

    fill = drawn_fill(gaps, F.lit(1), F.col("soon"))
    had = fill.groupBy("video_id", "k").agg(F.sum("duration").alias("had"))
    still = gaps.where("most > soon").join(had, ["video_id", "k"]).where(F.col("gap") - F.col("had") > LEAST_FILLER / 2)
    fill = fill.unionByName(drawn_fill(still, F.col("soon") + 1, F.col("most")))
    order = Window.partitionBy("video_id", "k").orderBy("j")
    fill = fill.withColumn("done", F.coalesce(F.sum("duration").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    fill = fill.where(F.col("gap") - F.col("done") > LEAST_FILLER)
    none = F.lit(None)
    fill = fill.select("video_id", "k", F.lit(0).alias("is_clip"), "j", "path", none.cast("string").alias("class_name"), F.least(F.col("duration"), F.col("gap") - F.col("done")).alias("len"), none.cast("double").alias("es"), none.cast("double").alias("ee"))
    bad = parts.where("clip is not null").select("video_id", "k", "clip.*")
    s, e = F.coalesce("start", F.lit(0.0)), F.coalesce("end", F.col("duration"))
    whole = e - s <= 0
    bad = bad.select("video_id", "k", F.lit(1).alias("is_clip"), F.lit(0).alias("j"), "path", "class_name", F.col("duration").alias("len"), F.when(whole, 0.0).otherwise(s).alias("es"), F.when(whole, F.col("duration")).otherwise(e).alias("ee"))
    laid = fill.unionByName(bad)
    run = Window.partitionBy("video_id").orderBy("k", "is_clip", "j")
    laid = laid.withColumn("end", F.sum("len").over(run)).withColumn("at", F.col("end") - F.col("len"))
    segment = F.struct(F.col("at").alias("start_sec"), F.col("end").alias("end_sec"), F.col("path").alias("source_path"), F.lit(0.0).alias("source_start_sec"), "class_name")
    event = F.struct("class_name", F.bround(F.col("at") + F.col("es"), 3).alias("start_time_sec"), F.bround(F.col("at") + F.least("ee", "len"), 3).alias("end_time_sec"))
    place = F.struct("k", "is_clip", "j")
    out = laid.groupBy("video_id").agg(
        F.bround(F.max("end"), 3).alias("duration_sec"),
        F.array_sort(F.collect_list(F.struct(place.alias("o"), segment.alias("s")))).alias("ss"),
        F.array_sort(F.collect_list(F.when(F.col("is_clip") == 1, F.struct(place.alias("o"), event.alias("e"))))).alias("es"),
    )
    return out.select("video_id", "duration_sec", F.transform("ss", lambda x: x["s"]).alias("segments"), F.transform("es", lambda x: x["e"]).alias("events"))


def resolve(tl: DataFrame, t: Column) -> Column:
    """struct<source_path, at> of the first segment that holds the time; null if none does."""
    hit = F.get(F.filter("segments", lambda s: (s["start_sec"] <= t) & (t < s["end_sec"])), F.lit(0))
    return F.when(hit.isNotNull(), F.struct(hit["source_path"].alias("source_path"), (hit["source_start_sec"] + t - hit["start_sec"]).alias("at")))


def manifest_tables(tl: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Ground-truth rows (a video without events is one row without times), videos, and the manifest as JSON lines."""
    row = F.explode_outer("events")
    truth = tl.select("video_id", row.alias("e")).select(
        "video_id", F.col("e").isNotNull().alias("is_anomaly"), F.coalesce("e.class_name", F.lit("normal")).alias("class_name"),
        "e.start_time_sec", "e.end_time_sec", F.lit(None).cast("string").alias("description_summary"),
    )
    videos = tl.select("video_id", F.concat(F.lit("videos/"), "video_id", F.lit(".mp4")).alias("filename"))
    return truth, videos, tl.select(F.to_json(F.struct(*tl.columns)).alias("value"))


def frame_plan(tl: DataFrame, windows: DataFrame, n: int) -> DataFrame:
    """video_id, start, end, frames: array of (source_path, items: array of (place, at)), each source once, in order of path.

    Frames of a window (video_id, start, end) are n even steps; places say where in the window a frame goes, so that sorting by them
    restores the order after each source has been read once. Times that no segment holds are left out.
    """
    from eventlens.operators.windows import frame_times

    j = windows.join(tl.select("video_id", "duration_sec", "segments"), "video_id")
    times = frame_times(F.col("start"), F.col("end"), F.lit(n), F.col("duration_sec"))
    each = F.transform(times, lambda t, i: F.struct(i.alias("place"), resolve(tl, t).alias("hit")))
    found = F.filter(each, lambda x: x["hit"].isNotNull())
    j = j.withColumn("_f", found)
    sources = F.array_sort(F.array_distinct(F.transform("_f", lambda x: x["hit"]["source_path"])))
    item = lambda x: F.struct(x["place"].alias("place"), x["hit"]["at"].alias("at"))
    frames = F.transform(sources, lambda p: F.struct(p.alias("source_path"), F.transform(F.filter("_f", lambda x: x["hit"]["source_path"] == p), item).alias("items")))
    return j.select("video_id", "start", "end", frames.alias("frames"))


def restored(frames: Column) -> Column:
    """array of (place, source_path, at) of a plan's frames, in the window's order."""
    flat = F.flatten(F.transform(frames, lambda s: F.transform(s["items"], lambda x: F.struct(x["place"].alias("place"), s["source_path"].alias("source_path"), x["at"].alias("at")))))
    return F.array_sort(flat)
