"""Nested result documents: assembly and rule checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.schema import CLASSES, NORMAL

VALID = CLASSES[1:]
#: Least and most characters of an explanation; tolerance of a runtime's average; bytes that draw a warning.
EXPLAIN, TOLERANCE, LARGE = (20, 500), 0.02, 5 * 1024 * 1024


def entries(meta: DataFrame, events: DataFrame, runtime: DataFrame | None = None, explanations: DataFrame | None = None, valid: list[str] = VALID) -> DataFrame:
    """video_id, events (array of class_name, start_time_sec, end_time_sec, explanation), runtime_metadata of every video.

    events: video_id, class_name, start, end, score, ord. Level 1: the best one (the first of equals), without times. Upper levels: intervals
    with 0 <= start < end, rounded to 3. explanations (video_id, class_name, text) outside the allowed length are left out.
    """
    e = events.where(F.col("class_name").isin(valid)).join(meta.select("video_id", "level"), "video_id", "left").withColumn("level", F.coalesce("level", F.lit(1)))
    none = F.lit(None)
    best = e.where("level = 1").groupBy("video_id").agg(F.max_by("class_name", F.struct(F.coalesce("score", F.lit(0.0)), -F.col("ord"))).alias("class_name"))
    best = best.select("video_id", "class_name", none.cast("double").alias("start_time_sec"), none.cast("double").alias("end_time_sec"), F.lit(0).cast("bigint").alias("ord"))
    ok = (F.col("end") > F.col("start")) & (F.col("start") >= 0)
    upper = e.where((F.col("level") > 1) & ok).select("video_id", "class_name", F.bround("start", 3).alias("start_time_sec"), F.bround("end", 3).alias("end_time_sec"), F.col("ord").cast("bigint").alias("ord"))
    rows = best.unionByName(upper)
    if explanations is not None:
        good = explanations.where(F.length("text").between(*EXPLAIN)).select("video_id", "class_name", F.col("text").alias("explanation"))
        rows = rows.join(good, ["video_id", "class_name"], "left")
    else:
        rows = rows.withColumn("explanation", none.cast("string"))
    packed = rows.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("ord", "start_time_sec", "class_name", "end_time_sec", "explanation"))).alias("l"))
    item = F.transform("l", lambda x: F.struct(x["class_name"].alias("class_name"), x["start_time_sec"].alias("start_time_sec"), x["end_time_sec"].alias("end_time_sec"), x["explanation"].alias("explanation")))
    out = meta.select("video_id").distinct().join(packed.select("video_id", item.alias("events")), "video_id", "left")
    out = out.withColumn("events", F.coalesce("events", F.array().cast("array<struct<class_name:string,start_time_sec:double,end_time_sec:double,explanation:string>>")))
    return out.join(runtime, "video_id", "left") if runtime is not None else out


def runtimes(calls: DataFrame, model_name: str) -> DataFrame:
    """video_id, runtime_metadata of calls (video_id, window_ms, n_frames)."""
    from eventlens.operators.metrics import latency

    stats = latency(calls.withColumn("ms", F.coalesce("window_ms", F.lit(0.0))), ["video_id"], "ms")
    sums = calls.groupBy("video_id").agg(F.sum(F.coalesce("n_frames", F.lit(0))).cast("int").alias("frames"), F.sum(F.coalesce("window_ms", F.lit(0.0))).alias("ms"))
    model = F.struct(
        F.lit(model_name).alias("model_name"), F.col("call_count").cast("int").alias("call_count"),
        *(F.col(c) for c in ("total_time_ms", "average_time_ms", "p50_time_ms", "p95_time_ms", "max_time_ms")),
    )
    whole = F.struct(F.col("frames").alias("frames_processed"), F.col("call_count").cast("int").alias("chunks_processed"), F.bround("ms", 1).alias("end_to_end_internal_time_ms"), F.array(model).alias("model_runtimes"))
    return stats.join(sums, "video_id").select("video_id", whole.alias("runtime_metadata"))


def _head(submission_id: str, model_name: str, hardware: str, wall_ms: float, version: str) -> list[Column]:
    run = F.struct(F.lit(wall_ms).alias("total_wall_time_ms"), F.lit(hardware).alias("hardware"))
    return [F.lit(version).alias("schema_version"), F.lit(submission_id).alias("submission_id"), F.lit(model_name).alias("model_name"), run.alias("run_metadata")]


def document_head(spark: SparkSession, submission_id: str, model_name: str, hardware: str, wall_ms: float, version: str = "1.0") -> DataFrame:
    """One row: a document without its predictions, for writers.document_lines."""
    return spark.range(1).select(*_head(submission_id, model_name, hardware, wall_ms, version))


def document(found: DataFrame, submission_id: str, model_name: str, hardware: str, wall_ms: float, version: str = "1.0") -> DataFrame:
    """One row: the whole document; predictions in order of video. It is one value, for what the platform takes; larger ones are written by writers.document_lines."""
    packed = found.agg(F.array_sort(F.collect_list(F.struct(*found.columns))).alias("predictions"))
    return packed.select(*_head(submission_id, model_name, hardware, wall_ms, version), "predictions")


def validate(found: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """video_id, rule, n: broken rules of entries (video_id, events, runtime_metadata) and how often each is broken.

    Every rule is an expression over an entry's own arrays; only repeated ids need a shuffle, and levels a join.
    """
    j = found.join(levels.select("video_id", F.col("level").alias("_level")), "video_id", "left") if levels is not None else found.withColumn("_level", F.lit(None).cast("int"))
    level = F.col("_level")

    def events(test) -> Column:
        return F.size(F.filter("events", test))

    def s_e(e):
        return e["start_time_sec"], e["end_time_sec"]

    untimed = lambda e: s_e(e)[0].isNull() | s_e(e)[1].isNull()
    rules = {
        "no video_id": F.when(F.coalesce(F.col("video_id").cast("string"), F.lit("")) == "", 1).otherwise(0),
        "class normal": events(lambda e: e["class_name"] == NORMAL),
        "unknown class": events(lambda e: ~F.coalesce(e["class_name"].isin(CLASSES), F.lit(False))),
        "level 1 with times": F.when(level == 1, events(lambda e: s_e(e)[0].isNotNull() | s_e(e)[1].isNotNull())).otherwise(0),
        "upper level without times": F.when(level > 1, events(untimed)).otherwise(0),
        "bad interval": F.when(level > 1, events(lambda e: F.coalesce((s_e(e)[0] < 0) | (s_e(e)[1] <= s_e(e)[0]), F.lit(False)))).otherwise(0),
        "explanation length": events(lambda e: F.coalesce(~F.length(e["explanation"]).between(*EXPLAIN), F.lit(False))),
        "level 1 with several events": F.when((level == 1) & (F.size("events") > 1), 1).otherwise(0),
    }
    if "runtime_metadata" in found.columns:
        def models(test) -> Column:
            return F.coalesce(F.size(F.filter("runtime_metadata.model_runtimes", test)), F.lit(0))

        def off(m):
            mean = F.try_divide(m["total_time_ms"], m["call_count"])
            return F.coalesce((mean != 0) & (F.abs(m["average_time_ms"] - mean) / F.nullif(mean, F.lit(0.0)) > TOLERANCE), F.lit(False))

        rules["runtime missing"] = F.when(F.col("runtime_metadata").isNull(), 1).otherwise(0)
        rules["average off"] = F.greatest(F.lit(0), models(off))
        kind = found.schema["runtime_metadata"].dataType["model_runtimes"].dataType.elementType
        if "call_times_ms" in kind.names:
            rules["call times"] = F.greatest(F.lit(0), models(lambda m: F.coalesce(F.size(m["call_times_ms"]) != m["call_count"], F.lit(False)) & m["call_times_ms"].isNotNull()))
    broken = F.array(*(F.struct(F.lit(r).alias("rule"), n.cast("bigint").alias("n")) for r, n in rules.items()))
    out = j.select("video_id", F.explode(broken).alias("b")).where("b.n > 0").groupBy("video_id", "b.rule").agg(F.sum("b.n").alias("n"))
    twice = found.groupBy("video_id").agg((F.count(F.lit(1)) - 1).alias("n")).where("n > 0").select("video_id", F.lit("repeated video_id").alias("rule"), "n")
    return out.unionByName(twice)


def chat_examples(windows: DataFrame, system: str, prompt: str, num_frames: int = 8) -> DataFrame:
    """messages, video, start_time_sec, end_time_sec: a chat of three turns per labelled window."""
    target = F.to_json(F.struct((F.col("class_name") != NORMAL).alias("is_anomaly"), "class_name"))
    turns = [("system", F.lit(system)), ("user", F.concat(F.repeat(F.lit("<image>"), F.lit(num_frames)), F.lit("\n" + prompt))), ("assistant", target)]
    messages = F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns))
    return windows.select(messages.alias("messages"), F.col("path").alias("video"), F.col("win_start").alias("start_time_sec"), F.col("win_end").alias("end_time_sec"))


def multimodal_examples(windows: DataFrame, system: str, prompt: str, frames: str = "frames", keep: list[str] | None = None) -> DataFrame:
    """The columns to keep and messages whose contents are arrays of (type, text, image): one image part per frame (path or reference), then the prompt."""
    none = F.lit(None).cast("string")

    def text(c: Column) -> Column:
        return F.struct(F.lit("text").alias("type"), c.alias("text"), none.alias("image"))

    images = F.transform(frames, lambda f: F.struct(F.lit("image").alias("type"), none.alias("text"), f.cast("string").alias("image")))
    target = F.to_json(F.struct((F.col("class_name") != NORMAL).alias("is_anomaly"), "class_name"))
    turns = [("system", F.array(text(F.lit(system)))), ("user", F.concat(images, F.array(text(F.lit(prompt))))), ("assistant", F.array(text(target)))]
    return windows.select(*(keep or []), F.array(*(F.struct(F.lit(r).alias("role"), c.alias("content")) for r, c in turns)).alias("messages"))
