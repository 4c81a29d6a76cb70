"""Window grids, labels and frame arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventlens.functions.intervals import overlap, repaired, window_label
from eventlens.schema import DWELL, NORMAL, SCALES


def grid(duration: Column, window: float = 4.0, stride: float = 4.0) -> Column:
    """array<struct<ord, start, end>>: starts every stride from 0, the last window cut to the duration, none after it."""
    last = F.greatest(F.lit(0), F.ceil((duration - window) / stride).cast("int"))
    steps = F.when(duration > 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    rows = F.transform(steps, lambda k: F.struct(k.alias("ord"), (k * stride).alias("start"), F.least(k * stride + window, duration).alias("end")))
    return F.filter(rows, lambda r: r["start"] < duration)


def sliding_windows(df: DataFrame, duration: str, window: float = 4.0, stride: float = 4.0) -> DataFrame:
    """df's rows, one for each window: win_ord, win_start, win_end."""
    each = df.withColumn("w", F.explode(grid(F.col(duration).cast("double"), window, stride)))
    return each.select("*", F.col("w.ord").alias("win_ord"), F.col("w.start").alias("win_start"), F.col("w.end").alias("win_end")).drop("w")


def labelled_windows(clips: DataFrame, scale: str = "short", **thresholds: float) -> DataFrame:
    """Of clips (class_name, start, end, duration, ...): labelled windows; ambiguous ones are dropped.

    A clip no longer than the window is one window.
    """
    window, stride = SCALES[scale]
    d = F.col("duration").cast("double")
    s, e = repaired(F.col("start"), F.col("end"), d)
    cut = F.when(d <= window, F.array(F.struct(F.lit(0).alias("ord"), F.lit(0.0).alias("start"), d.alias("end")))).otherwise(grid(d, window, stride))
    each = clips.withColumns({"ev_start": s, "ev_end": e}).withColumn("w", F.explode(cut))
    label = window_label(F.col("w.start"), F.col("w.end"), F.col("ev_start"), F.col("ev_end"), F.col("class_name"), **thresholds)
    out = each.withColumns({"label": label, "win_ord": F.col("w.ord"), "win_start": F.col("w.start"), "win_end": F.col("w.end"), "scale": F.lit(scale)})
    return out.where("label is not null").drop("w", "ev_start", "ev_end")


def all_scales(clips: DataFrame, **thresholds: float) -> DataFrame:
    """Labelled windows at every scale that a clip's class asks for."""
    clips = clips.where("duration > 0")
    return labelled_windows(clips, "short", **thresholds).unionByName(labelled_windows(clips.where(F.col("class_name").isin(DWELL)), "long", **thresholds))


def oracle_verdicts(windows: DataFrame, truth: DataFrame, hit: float = 0.9, window: float = 4.0) -> DataFrame:
    """windows (video_id, win_ord, win_start, win_end, duration) with the verdict a perfect model would give.

    The first event (by ord, then class) with a common part names the class; untimed events stand for the whole clip. `window` is the usual length of a
    window: time is cut into bins of it, windows and events meet by video and bin, so a video's windows never meet all of its events. A
    window lies in the bins it touches; its first event over all of them is the least of its bins' first events. Both sides are exploded, which Spark's
    size estimates don't see, so the joins are asked to sort and merge: as a broadcast a side would go through the driver.
    """
    first = lambda s: F.floor(s / window)
    last = lambda s, e: F.greatest(first(s), F.ceil(e / window) - 1)
    keys = ["video_id", "win_ord", "win_start", "win_end"]
    w = windows.withColumn("_bin", F.explode(F.sequence(first(F.col("win_start")), last(F.col("win_start"), F.col("win_end")))))
    clips = windows.groupBy("video_id").agg(F.max("duration").alias("_d"))
    t = truth.select("video_id", "class_name", "ord", "start", "end").join(clips.hint("merge"), "video_id")
    s, e = F.coalesce("start", F.lit(0.0)), F.coalesce("end", "_d")
    t = t.select(F.col("video_id").alias("_v"), F.struct("ord", "class_name").alias("_c"), s.alias("_s"), F.least(e, F.col("_d")).alias("_e")).where("_e > _s")
    t = t.withColumn("_bin2", F.explode(F.sequence(first(F.col("_s")), last(F.col("_s"), F.col("_e")))))
    hits = w.join(t.hint("merge"), (F.col("video_id") == F.col("_v")) & (F.col("_bin") == F.col("_bin2")) & (overlap(F.col("win_start"), F.col("win_end"), F.col("_s"), F.col("_e")) > 0), "left")
    best = hits.groupBy(*keys).agg(F.min("_c")["class_name"].alias("c"))
    return best.select(*keys, F.coalesce("c", F.lit(NORMAL)).alias("class_name"), F.when(F.col("c").isNotNull(), hit).otherwise(0.0).alias("score"))


def frame_indices(n_total: Column, fps: Column, num: int, start: Column | None = None, end: Column | None = None) -> Column:
    """num indices spread evenly from start to end, floored; bounds are clamped to the clip."""
    last = n_total - 1
    a = F.lit(0) if start is None else F.floor(F.coalesce(start, F.lit(0.0)) * fps)
    b = last if end is None else F.coalesce(F.floor(end * fps), last)
    a = F.greatest(F.lit(0), F.least(a, last))
    b = F.greatest(a, F.least(b, last))
    if num == 1:
        return F.array(a.cast("int"))
    return F.transform(F.sequence(F.lit(0), F.lit(num - 1)), lambda i: F.when(i == num - 1, b).otherwise(F.floor(a + i * (b - a) / (num - 1))).cast("int"))


def frame_times(start: Column, end: Column, n: Column, duration: Column) -> Column:
    """n times from start to end inclusive, none later than a thousandth before the end of the clip."""
    step = F.greatest(n - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.least(start + (end - start) * i / step, duration - 1e-3))


def subsample(frames: Column, n: int) -> Column:
    """n elements at half-even rounded even steps, each once."""
    if n < 2:
        raise ValueError("a subsample has two frames or more")
    size = F.size(frames)
    at = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.bround(i * (size - 1) / (n - 1), 0).cast("int")))
    return F.when(size <= n, frames).otherwise(F.transform(at, lambda i: F.get(frames, i)))


def strided(frames: Column, n: int) -> Column:
    """Every (size div n)-th element, the first n."""
    step = F.greatest(F.lit(1), F.floor(F.size(frames) / n).cast("int"))
    return F.slice(F.filter(frames, lambda _, i: F.pmod(i, step) == 0), 1, n)


def middle(frames: Column) -> Column:
    return F.get(frames, F.floor(F.size(frames) / 2).cast("int"))


def resized(width: Column, height: Column, tokens: int | None, unit: int = 28) -> Column:
    """struct<width, height> scaled down to a token budget, in whole units; smaller frames stay."""
    if tokens is None:
        return F.struct(width.alias("width"), height.alias("height"))
    beta = F.sqrt(width * height / F.lit(float(tokens * unit * unit)))

    def fit(x: Column) -> Column:
        return F.greatest(F.lit(unit), (F.floor(x / beta / unit) * unit).cast("int"))

    small = (width <= 0) | (height <= 0) | (beta <= 1.0)
    return F.struct(F.when(small, width).otherwise(fit(width)).alias("width"), F.when(small, height).otherwise(fit(height)).alias("height"))


def routed(verdicts: DataFrame) -> DataFrame:
    """Of two-scale verdicts (scale, duration, class_name): what each scale may say; long needs clips of 16 s or more."""
    short = (F.col("scale") == "short") & ~F.col("class_name").isin(DWELL)
    long = (F.col("scale") == "long") & (F.col("class_name").isin(DWELL) | (F.col("class_name") == NORMAL)) & (F.col("duration") >= 16)
    return verdicts.where(short | long)




def window_ids(windows: DataFrame, order: str, pattern: str = "w%06d") -> DataFrame:
    """Windows with id: the pattern filled with their position, from 0, in order of a unique column. Only ranges are sorted, never the whole."""
    from eventlens.operators.synth import numbered

    return numbered(windows, order).withColumn("id", F.format_string(pattern, F.col("pool_no") - 1)).drop("pool_no")
