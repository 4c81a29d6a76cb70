"""Registered queries on streams: tables as arrivals out of order, run to the end and compared with what the batch gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventlens.operators import sessions
from eventlens.plans import adapters as A
from eventlens.plans.adapters import SQL
from eventlens.plans.catalogue import _EVENTS, _GRID, ORACLES, q6, query, r6
from eventlens.sources import readers, writers
from eventlens.streaming import feeds, hysteresis, sinks

#: The row that ends a stream; it is taken out of the results.
_END = {"video_id": -1, "class_name": "none", "start": -1.0, "end": -1.0, "score": 0.0, "upto": 0.0}


@query(ORACLES["gate_join"])
def stream_gate(spark, d):
    """The gate as a join of two streams; every verdict comes out, confirmed or not."""
    at = A.scratch(spark, "gate")
    v = A.verdicts(spark, d).withColumn("at", F.col("ts").cast("timestamp")).drop("ts")
    keys = ["video_id", "start", "end"]
    second = v.groupBy(*keys).agg(F.max(F.least(F.lit(1.0), F.col("score") * 1.5 + (F.col("seq") % 2) * 0.2)).alias("score"), (F.max("at") + F.expr("INTERVAL 3 MINUTES")).alias("at"))
    # Scores of 0 aren't told, so that verdicts without a partner have to wait.
    out = feeds.gate(A.arrivals(v, "first", end=_END), A.arrivals(second.where("score > 0"), "second", end=_END), watermark="7 hours")
    hysteresis.run_available(out, f"{at}/out", f"{at}/state")
    return spark.read.schema(out.schema).parquet(f"{at}/out").where("video_id >= 0").select("video_id", "seq", "class_name", *r6("score"))


@query(f"WITH {SQL['verdicts']}, {_EVENTS} SELECT video_id, class_name, {q6('start', 'end', 'score')} FROM found")
def stream_merge(spark, d):
    """Spans merged into events as sessions with a dynamic gap."""
    from eventlens import schema as S

    at = A.scratch(spark, "merge")
    streams = sessions.with_policy(sessions.candidate_streams(A.verdicts(spark, d)), S.policies(spark), ["theta_high", "theta_low", "max_window_gap_sec"])
    origin = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    spans = sessions.spans(streams, ["video_id", "class_name"]).select("video_id", "class_name", F.timestamp_micros(origin + F.round(F.col("start") * 3600000000).cast("bigint")).alias("at"), "start", "end", "score")
    out = feeds.merged(A.arrivals(spans, "spans", end=_END), 5.0, watermark="7 hours", unit=3600.0)
    hysteresis.run_available(out, f"{at}/out", f"{at}/state")
    return spark.read.schema(out.schema).parquet(f"{at}/out").where("video_id >= 0").select("video_id", "class_name", *r6("start", "end", "score"))


@query(f"WITH {SQL['clips']}, g AS ({_GRID.format(s=4, w=4)}) SELECT video_id::VARCHAR AS video_id, win_ord, win_start, win_end FROM g")
def stream_grid(spark, d):
    """Clips that grow by 5 seconds an hour; some say when they end, the others fall idle."""
    at = A.scratch(spark, "grid")
    c = A.clips(spark, d).select("video_id", "duration", F.explode(F.sequence(F.lit(0), F.ceil(F.col("duration") / 5).cast("int") - 1)).alias("k"))
    upto = F.least((F.col("k") + 1) * 5.0, F.col("duration"))
    hour = F.timestamp_seconds(F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("k") * 3600)
    last = F.when(F.col("video_id") % 2 == 0, upto == F.col("duration"))
    chunks = c.select(F.col("video_id").cast("string").alias("video_id"), hour.alias("at"), upto.alias("upto"), last.alias("last"))
    # The row that ends the stream is of length 0 and so has no window.
    out = feeds.grid(A.arrivals(chunks, "chunks", end=_END), watermark="7 hours", idle=8 * 3600.0)
    hysteresis.run_available(out, f"{at}/out", f"{at}/state")
    return spark.read.schema(feeds.WINDOW).parquet(f"{at}/out")


@query(f"""WITH {SQL['verdicts']} SELECT 'events' AS "table", video_id::VARCHAR AS video_id, class_name, count(*) AS n, round(sum("end" - "start"), 4) AS seconds FROM verdicts WHERE class_name <> 'normal' GROUP BY ALL
UNION ALL SELECT 'verdicts', video_id::VARCHAR, class_name, count(*), round(sum("end" - "start"), 4) FROM verdicts GROUP BY ALL""")
def stream_tables(spark, d):
    """One stream into event files and verdict lines, batch by batch; all complete batches read back."""
    at = A.scratch(spark, "tables")
    v = A.verdicts(spark, d).select(F.col("video_id").cast("string").alias("video_id"), F.col("ts").cast("timestamp").alias("at"), "start", "end", "class_name", "score")
    names = {"start": "start_time_sec", "end": "end_time_sec"}
    tables = {
        "events": lambda b, path: writers.events_csv(b.where("class_name <> 'normal'"), path),
        "verdicts": lambda b, path: writers.compact_json(b.drop("at").withColumnsRenamed(names), path),
    }
    sinks.start(A.arrivals(v, "verdicts"), f"{at}/out", f"{at}/state", tables).awaitTermination()
    events = [readers.predictions(spark, p) for p in sinks.batches(spark, f"{at}/out", "events")]
    lines = [readers.verdicts(spark, p) for p in sinks.batches(spark, f"{at}/out", "verdicts")]
    out = None
    for name, parts in (("events", events), ("verdicts", lines)):
        for p in parts:
            p = p.select(F.lit(name).alias("table"), "video_id", "class_name", "start", "end")
            out = p if out is None else out.unionByName(p)
    return out.groupBy("table", "video_id", "class_name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("end") - F.col("start")), 4).alias("seconds"))
