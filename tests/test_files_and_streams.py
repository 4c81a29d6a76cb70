"""Sources and sinks on written files, the stream against the batch, and the registered queries."""

import json
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from eventlens.operators import sessions
from eventlens.sources import readers, writers
from eventlens.streaming import feeds, hysteresis, sinks

GT = "video_id,is_anomaly,class_name,start_time_sec,end_time_sec,description_summary"


def put(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def test_splits(spark, tmp_path):
    put(tmp_path / "test/ground_truth.csv", GT + ",level\nT1,true,fire,1.0,2.0,x,2\nT1,true,smoke,,,y,2\nT2,false,normal,,,,1\n")
    put(tmp_path / "test/videos.csv", "video_id,filename\nT1,videos/T1.mp4\nT2,videos/T2.mp4\n")
    df = readers.split(spark, str(tmp_path))
    assert df.count() == 3 and df.where("video_id = 'T2'").first().video_path.endswith("/test/videos/T2.mp4")
    assert sorted((r.class_name, r.start) for r in readers.truth(df).collect()) == [("fire", 1.0), ("smoke", None)]
    put(tmp_path / "bad/ground_truth.csv", "video_id\nT1\n")
    with pytest.raises(ValueError, match="missing"):
        readers.split(spark, str(tmp_path), "bad")


def test_train_folders(spark, tmp_path):
    for c in ("fire", "smoke", "unknown_folder"):
        put(tmp_path / f"train/{c}/ground_truth.csv", GT + f"\nV1,true,{c},0,1,d\n")
        put(tmp_path / f"train/{c}/videos.csv", "video_id,filename\nV1,videos/V1.mp4\n")
    got = readers.train(spark, str(tmp_path))
    assert sorted((r.class_dir, r.level) for r in got.collect()) == [("fire", None), ("smoke", None)]


def test_predictions(spark, tmp_path):
    put(tmp_path / "p.csv", "video_id,class_name\nv,fire\nv,normal\n")
    put(tmp_path / "p.jsonl", '{"video_id": "v", "class_name": "fire", "score": 0.5, "is_anomaly": true}\n{"video_id": "v", "class_name": "smoke", "is_anomaly": false}\n')
    put(tmp_path / "e.jsonl", "")
    put(tmp_path / "e.csv", "")
    assert [(r.class_name, r.score) for r in readers.predictions(spark, str(tmp_path / "p.csv")).collect()] == [("fire", 1.0)]
    assert [(r.class_name, r.score) for r in readers.predictions(spark, str(tmp_path / "p.jsonl")).collect()] == [("fire", 0.5)]
    assert readers.predictions(spark, str(tmp_path / "e.jsonl")).count() == readers.predictions(spark, str(tmp_path / "e.csv")).count() == 0


def test_json_sources(spark, tmp_path):
    put(tmp_path / "v.jsonl", '{"video_id": "v", "start_time_sec": 0, "end_time_sec": 4, "class_name": "fire", "score": 0.7}\n')
    r = readers.verdicts(spark, str(tmp_path / "v.jsonl")).first()
    assert (r.window_ms, r.n_frames, r.score) == (0.0, 0, 0.7)
    put(tmp_path / "s.json", json.dumps({"v": [[0, 1.5], [2, 3]], "w": []}, indent=1))
    assert [tuple(x) for x in readers.span_map(spark, str(tmp_path / "s.json")).orderBy("span_no").collect()] == [("v", 0, 0.0, 1.5), ("v", 1, 2.0, 3.0)]
    put(tmp_path / "m.csv", "video_id,level\na,1\nb,\n")
    assert readers.level_manifest(spark, str(tmp_path / "m.csv")).count() == 1
    put(tmp_path / "i.jsonl", "".join(json.dumps({"id": f"w{k:06d}", "video_id": "v", "start": 0, "end": 4, "n_frames": 8}) + "\n" for k in range(5)))
    assert [r.id for r in readers.export_index(spark, str(tmp_path / "i.jsonl"), 2).collect()] == ["w000000", "w000001"]
    for k in (2, 10, 1):
        put(tmp_path / f"frames/w1/f{k}.jpg", "x")
    assert [r.frame_no for r in readers.frames(spark, str(tmp_path / "frames")).orderBy("frame_no").collect()] == [1, 2, 10]
    paths = spark.createDataFrame([("out/checkpoint-20",), ("out/checkpoint-140",), ("out/final",)], "path string")
    assert readers.newest_checkpoint(paths).first().path == "out/checkpoint-140"
    clip = spark.createDataFrame([(30.0, 15.0), (30.0, 0.0), (30.0, None)], "n_frames double, fps double")
    assert [r[0] for r in clip.select(readers.duration()).collect()] == [2.0, 0.0, 0.0]


def test_sinks(spark, tmp_path):
    e = spark.createDataFrame([("v", "fire", 1.0, 2.0, 0.5)], "video_id string, class_name string, start double, end double, score double")
    writers.events_csv(e, str(tmp_path / "e"))
    writers.events_csv(e.where("false"), str(tmp_path / "none"))
    assert spark.read.option("header", True).csv(str(tmp_path / "e")).columns == writers.EVENT_COLUMNS
    assert "".join(p.read_text() for p in (tmp_path / "none").glob("part-*")).strip() == ",".join(writers.EVENT_COLUMNS)
    assert not writers.document(e, str(tmp_path / "d"))
    writers.keyed_json(e, "video_id", "class_name", str(tmp_path / "k"))
    assert spark.read.text(str(tmp_path / "k")).first().value == '{"v":"fire"}'
    writers.compact_json(e, str(tmp_path / "c"))
    writers.json_lines(e, str(tmp_path / "j"))
    writers.embeddings(e, str(tmp_path / "p"))
    assert spark.read.json(str(tmp_path / "j")).count() == spark.read.parquet(str(tmp_path / "p")).count() == spark.read.text(str(tmp_path / "c")).count() == 1


KIND = "video_id string, start double, end double, class_name string, score double"


def feed_rows(seed, videos, n):
    rng = random.Random(seed)
    rows = []
    for v in range(videos):
        t = 0.0
        for _ in range(n):
            t += rng.choice([2, 4, 4, 9, 14])
            rows.append((f"v{v}", t, t + rng.choice([4, 4, 20]), rng.choice(["fire", "smoke", "normal"]), round(rng.random(), 2)))
    return rows


def put_in_steps(spark, df, at, steps):
    """Writes the rows of each step (a predicate) as files of their own, in order."""
    for k, where in enumerate(steps):
        df.where(where).orderBy(F.rand(k)).coalesce(1).write.parquet(f"{at}/step={k}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/step=*")


def rows_of(df):
    return sorted(tuple(r) for r in df.select("video_id", "class_name", "start", "end", "score").collect())


def test_stream_is_the_batch_whatever_the_order(spark, tmp_path):
    """Rows up to 100 seconds out of order, within the watermark: the events are the batch's. A row behind the watermark has no effect."""
    rng = random.Random(4)
    rows = [(*r, r[1] + rng.uniform(0, 100)) for r in feed_rows(4, 6, 40)]
    df = spark.createDataFrame(rows, KIND + ", come double").withColumn("at", F.timestamp_millis((F.col("start") * 1000).cast("long")))
    late = df.where("video_id = 'v0'").limit(1).withColumn("class_name", F.lit("fire")).withColumn("score", F.lit(1.0)).withColumn("come", F.lit(1e6))
    stream = put_in_steps(spark, df.unionByName(late), str(tmp_path / "in"), ["come < 80", "come between 80 and 200", "come > 200 and come < 1e5", "come > 1e5"])
    events = hysteresis.stream_events(hysteresis.explode_classes(stream, ["fire", "smoke"]), watermark="101 seconds")
    hysteresis.run_available(events, str(tmp_path / "out"), str(tmp_path / "state"))
    emitted = spark.read.parquet(str(tmp_path / "out"))
    held = hysteresis.remaining_events(spark, str(tmp_path / "state"))
    assert emitted.count() > 0 and held.count() > 0
    batch = sessions.aggregate_one(df.withColumn("seq", F.monotonically_increasing_id()))
    assert rows_of(emitted.unionByName(held)) == rows_of(batch)


@pytest.mark.parametrize("policy", [{"merge_gap_sec": 0.0, "min_duration_sec": 5.0}, {"merge_gap_sec": 8.0, "theta_low": 0.2}])
def test_machine_is_the_batch(spark, policy):
    """The stream's state machine, handed its state again after every row, against the batch operator."""
    rows = feed_rows(7, 5, 60)
    got = []
    for v in {r[0] for r in rows}:
        for c in ("fire", "smoke"):
            state, out = None, []
            for _, s, e, kind, x in sorted(r for r in rows if r[0] == v):
                machine = hysteresis.Machine(policy, state)
                machine.row(s, e, x if kind == c else 0.0)
                out += machine.out
                state = machine.state()
            machine.out = []
            machine.end()
            got += [(v, c, *o) for o in out + machine.out]
    batch = sessions.aggregate_one(spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], KIND + ", seq long"), **policy)
    assert sorted(got) == rows_of(batch)


def test_gate_stream(spark, tmp_path):
    """Partners before and after their verdict, none, one told too late, and one of another window."""
    def ts(x):
        return F.timestamp_seconds(x + 1000)

    first = spark.createDataFrame([("v", k, 4.0 * k, 4.0 * k + 4, "fire" if k % 4 else "normal", 0.8) for k in range(40)] + [("end", 99, 0.0, 0.0, "normal", 0.0)], "video_id string, seq long, start double, end double, class_name string, score double")
    first = first.withColumn("at", F.when(F.col("video_id") == "end", ts(F.lit(100_000))).otherwise(ts(F.col("start"))))
    second = spark.createDataFrame([("v", 4.0 * k, 4.0 * k + (5 if k == 9 else 4), 0.99 if k % 3 else 0.5, 4.0 * k + (50 if k == 13 else (-5, 0, 5)[k % 3])) for k in range(35)] + [("end", 0.0, 0.0, 1.0, 100_000.0)], "video_id string, start double, end double, score double, t double")
    second = second.withColumn("at", ts(F.col("t"))).drop("t")
    steps = ["start < 60 and video_id <> 'end'", "start >= 60", "video_id = 'end'"]
    out = feeds.gate(put_in_steps(spark, first, str(tmp_path / "a"), steps), put_in_steps(spark, second, str(tmp_path / "b"), steps), watermark="2 minutes", apart="10 seconds")
    hysteresis.run_available(out, str(tmp_path / "out"), str(tmp_path / "state"))
    got = {r.seq: (r.class_name, r.score) for r in spark.read.parquet(str(tmp_path / "out")).where("video_id = 'v'").collect()}
    assert got == {k: ("fire", 0.8) if k % 4 and k % 3 and k < 35 and k not in (9, 13) else ("normal", 0.8 if k % 4 == 0 else 0.0) for k in range(40)}


def test_merged_stream(spark, tmp_path):
    """Sessions with a dynamic gap: a gap of just merge_gap joins, a longer one doesn't, a long span reaches over short ones."""
    spans = [("v", "fire", s, e, x) for s, e, x in [(0, 4, 0.5), (9, 12, 0.9), (17.5, 18, 0.6), (30, 60, 0.7), (32, 33, 0.8), (65, 66, 0.4), (71.001, 72, 0.3)]] + [("v", "smoke", 1, 2, 0.5), ("end", "x", 10_000, 10_001, 0.0)]
    df = spark.createDataFrame([tuple(float(c) if isinstance(c, int) else c for c in r) for r in spans], "video_id string, class_name string, start double, end double, score double")
    df = df.withColumn("at", F.timestamp_millis((F.col("start") * 1000).cast("long")))
    want = [("v", "fire", 0.0, 12.0, 0.9), ("v", "fire", 17.5, 18.0, 0.6), ("v", "fire", 30.0, 66.0, 0.8), ("v", "fire", 71.001, 72.0, 0.3), ("v", "smoke", 1.0, 2.0, 0.5)]
    assert rows_of(feeds.merged(df.where("video_id = 'v'"), 5.0)) == want
    stream = put_in_steps(spark, df, str(tmp_path / "in"), ["start > 20 and start < 1000 or start < 1", "start between 1 and 20", "start > 1000"])
    hysteresis.run_available(feeds.merged(stream, 5.0, watermark="3 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert rows_of(spark.read.parquet(str(tmp_path / "out")).where("video_id = 'v'")) == want


def test_sinks_after_a_forced_stop(spark, tmp_path):
    """The second batch fails after its first table is written; the rerun leaves every row once in both tables."""
    df = spark.createDataFrame(feed_rows(5, 3, 20), KIND).withColumn("at", F.timestamp_millis((F.col("start") * 1000).cast("long")))
    stream = put_in_steps(spark, df, str(tmp_path / "in"), ["start < 60", "start between 60 and 100", "start > 100"])
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    broken = [True]

    def lines(batch, path):
        if broken[0] and path.endswith("batch=1"):
            broken[0] = False
            batch.drop("at").limit(1).write.mode("overwrite").parquet(path + "/part")
            raise RuntimeError("stopped by force")
        writers.json_lines(batch.drop("at"), path)

    tables = {"events": lambda b, path: writers.events_csv(b, path), "lines": lines}
    with pytest.raises(Exception, match="forc"):
        sinks.start(stream, out, state, tables).awaitTermination()
    assert len(sinks.batches(spark, out, "events")) == 2 and len(sinks.batches(spark, out, "lines")) == 1
    sinks.start(stream, out, state, tables).awaitTermination()
    for name, read in (("events", lambda p: spark.read.option("header", True).csv(p)), ("lines", spark.read.json)):
        folders = sinks.batches(spark, out, name)
        assert [f.rsplit("=", 1)[1] for f in folders] == ["0", "1", "2"] and read(folders).count() == df.count()


@pytest.mark.parametrize("name", ["multi_class_aggregate", "greedy_match_general", "overall_score", "label_windows", "stream_hysteresis", "sweep_overall_topk", "timelines_round_trip", "frame_plan", "submission_validate", "latency_summary", "stream_gate", "stream_merge", "stream_grid", "stream_tables"])
def test_registered(spark, sf, name):
    from eventlens.plans.catalogue import QUERIES

    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_entry_without_corpus_operators(tmp_path):
    """With the corpus folder gone (and with the pipeline gone as well) the other queries are still there."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    top = Path(__file__).resolve().parents[1]
    shutil.copytree(top / "eventlens", tmp_path / "eventlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(top / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("from eventlens.llm import bpe\n")
    ask = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and 'pipeline' not in q and not any(k.startswith('op') for k in q) and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, check=True)
    (tmp_path / "corpus_pipeline.py").unlink()
    subprocess.run([sys.executable, "-c", ask], cwd=tmp_path, check=True)


def test_windowed_and_session_counts_on_a_stream(spark, tmp_path):
    """Hopping windows and sessions of a stream, once the watermark has passed them, against plain counts."""
    rows = [("v", t, c, 0.5) for t, c in ((0, "fire"), (5, "normal"), (9, "fire"), (40, "fire"), (41, "smoke"), (400, "normal"), (401, "normal"), (900, "normal"))]
    df = spark.createDataFrame(rows, "video_id string, t long, class_name string, score double").withColumn("at", F.timestamp_seconds("t"))
    for k, cond in enumerate(("t < 300", "t between 300 and 800", "t > 800")):
        df.where(cond).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    hysteresis.run_available(hysteresis.windowed_counts(stream(), "32 seconds", "8 seconds", "1 second"), str(tmp_path / "w"), str(tmp_path / "sw"))
    hysteresis.run_available(hysteresis.session_counts(stream(), "8 seconds", "1 second"), str(tmp_path / "s"), str(tmp_path / "ss"))
    got = {r.b: (r.n, r.anomalous) for r in spark.read.parquet(str(tmp_path / "w")).select(F.unix_seconds("window.start").alias("b"), "n", "anomalous").collect()}
    want = {}
    for _, t, c, _ in rows[:-1]:
        for b in range(t // 8 * 8, t // 8 * 8 - 32, -8):
            n, a = want.get(b, (0, 0))
            want[b] = (n + 1, a + (c != "normal"))
    assert got == want
    sessions_seen = {(r.class_name, r.b): r.n for r in spark.read.parquet(str(tmp_path / "s")).select("class_name", F.unix_seconds("session_window.start").alias("b"), "n").collect()}
    assert sessions_seen == {("fire", 0): 1, ("fire", 9): 1, ("fire", 40): 1, ("smoke", 41): 1}


def test_grid_stream_is_the_batch_in_few_buckets(spark, tmp_path):
    """Growing videos, some of which say when they end, in three buckets: the batch's windows, and a state of a value and a timer a bucket instead of a video."""
    from eventlens.operators import windows
    from eventlens.streaming import feeds

    clips = spark.range(60).select(F.col("id").cast("string").alias("video_id"), (F.col("id") % 23 + F.col("id") % 3 / 4).cast("double").alias("duration")).where("duration > 0")
    k = F.explode(F.sequence(F.lit(0), F.ceil(F.col("duration") / 5).cast("int") - 1)).alias("k")
    upto = F.least((F.col("k") + 1) * 5.0, F.col("duration"))
    last = F.when(F.col("video_id").cast("int") % 2 == 0, upto == F.col("duration"))
    chunks = clips.select("video_id", "duration", k).select("video_id", "k", F.timestamp_seconds(F.col("k") * 10 + 1000).alias("at"), upto.alias("upto"), last.alias("last"))
    end = spark.createDataFrame([("end", 9)], "video_id string, k int").select("video_id", "k", F.timestamp_seconds(F.lit(99999)).alias("at"), F.lit(0.0).alias("upto"), F.lit(None).cast("boolean").alias("last"))
    stream = put_in_steps(spark, chunks.unionByName(end), str(tmp_path / "in"), ["k = 1", "k in (0, 2)", "k in (3, 4)", "k = 9"])
    out = feeds.grid(stream, watermark="60 seconds", idle=50.0, buckets=3)
    with hysteresis.keyed_state(spark):
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators) <= 3
    batch = windows.sliding_windows(clips, "duration").select("video_id", "win_ord", "win_start", "win_end")
    assert sorted(map(tuple, spark.read.schema(feeds.WINDOW).parquet(str(tmp_path / "out")).collect())) == sorted(map(tuple, batch.collect()))


def test_events_stream_is_the_batch_in_few_buckets(spark, tmp_path):
    """Many feeds in two buckets, some of which end long before others: emitted and held events are the batch's."""
    rows = [(v, s + 400 * int(v[1:]), e + 400 * int(v[1:]), *r) for v, s, e, *r in feed_rows(9, 9, 40)]
    df = spark.createDataFrame(rows, KIND).withColumn("at", F.timestamp_millis((F.col("start") * 1000).cast("long"))).withColumn("come", F.col("start") + F.pmod(F.xxhash64("start", "video_id"), F.lit(90)))
    stream = put_in_steps(spark, df, str(tmp_path / "in"), ["come < 700", "come between 700 and 1900", "come > 1900"])
    events = hysteresis.stream_events(hysteresis.explode_classes(stream, ["fire", "smoke"]), watermark="101 seconds", buckets=2)
    hysteresis.run_available(events, str(tmp_path / "out"), str(tmp_path / "state"))
    emitted = spark.read.schema(hysteresis.EVENT).parquet(str(tmp_path / "out"))
    held = hysteresis.remaining_events(spark, str(tmp_path / "state"))
    assert emitted.count() > 0 and held.count() > 0
    assert rows_of(emitted.unionByName(held)) == rows_of(sessions.aggregate_one(df.drop("come").withColumn("seq", F.monotonically_increasing_id())))


def test_gate_stream_holds_what_a_partner_can_change(spark, tmp_path):
    """Normal verdicts and scores below the least aren't kept in state, null classes and scores are as in the batch, and the watermark is moved by low scores too."""
    def ts(x):
        return F.timestamp_seconds(x + 1000)

    kinds, scores = ("normal", "fire", None, "normal", "normal"), (0.99, None, 0.2, 0.95, 0.94, 0.1, float("nan"))
    first = [("v", k, 4.0 * k, 4.0 * k + 4, kinds[k % 5], 0.8, float(k)) for k in range(210)] + [("end", 999, 0.0, 0.0, "normal", 0.0, 1e5)]
    first = spark.createDataFrame(first, "video_id string, seq long, start double, end double, class_name string, score double, t double").withColumn("at", ts(F.col("t"))).drop("t")
    # The last score of the stream is a low one: without it nothing that waits would come out.
    second = [("v", 4.0 * k, 4.0 * k + 4, scores[k % 7], k + 5.0) for k in range(210) if k % 11] + [("end", 0.0, 0.0, 0.0, 1e5)]
    second = spark.createDataFrame(second, "video_id string, start double, end double, score double, t double").withColumn("at", ts(F.col("t"))).drop("t")
    steps = ["start < 400 and video_id <> 'end'", "start >= 400", "video_id = 'end'"]
    out = feeds.gate(put_in_steps(spark, first, str(tmp_path / "a"), steps), put_in_steps(spark, second, str(tmp_path / "b"), steps), watermark="2 minutes", apart="10 seconds")
    with hysteresis.keyed_state(spark):
        query = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination()
    held = first.where("not class_name <=> 'normal'").count() + second.where("score >= 0.95").count()
    assert 0 < max(o.numRowsTotal for p in query.recentProgress for o in p.stateOperators) <= held
    names = ["seq", "class_name", "score"]
    got, want = spark.read.parquet(str(tmp_path / "out")).where("video_id = 'v'"), sessions.gate(first.where("video_id = 'v'"), second)
    assert sorted(map(str, got.select(names).collect())) == sorted(map(str, want.select(names).collect())) and got.count() == 210


def test_gate_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    """Verdicts of a first run meet scores of a second one, whose state is read back from the checkpoint."""
    first = spark.createDataFrame([("v", k, 4.0 * k, 4.0 * k + 4, "fire", 0.8) for k in range(30)] + [("end", 99, 0.0, 0.0, "fire", 0.0)], "video_id string, seq long, start double, end double, class_name string, score double")
    first = first.withColumn("at", F.timestamp_seconds(F.when(F.col("video_id") == "end", 100_000).otherwise(F.col("start") + 1000)))
    second = first.where("seq % 2 = 0 or video_id = 'end'").select("video_id", "start", "end", F.lit(0.97).alias("score"), "at")
    first.where("video_id = 'v'").write.parquet(str(tmp_path / "a/0"))
    second.where("start = 0 and video_id = 'v'").write.parquet(str(tmp_path / "b/0"))
    read = lambda df, side: spark.readStream.schema(df.schema).parquet(str(tmp_path / side / "*"))
    for k in range(2):
        hysteresis.run_available(feeds.gate(read(first, "a"), read(second, "b"), watermark="2 hours"), str(tmp_path / "out"), str(tmp_path / "state"))
        if k == 0:
            second.where("start > 0").write.parquet(str(tmp_path / "b/1"))
            first.where("video_id = 'end'").write.parquet(str(tmp_path / "a/1"))
            second.where("video_id = 'end'").write.parquet(str(tmp_path / "b/2"))
    got = {r.seq: r.class_name for r in spark.read.parquet(str(tmp_path / "out")).where("video_id = 'v'").collect()}
    assert got == {k: "normal" if k % 2 else "fire" for k in range(30)}


def test_arrivals_work_their_rows_out_once(spark):
    """A costly table isn't evaluated anew for every step; every row arrives once, in the end row's company."""
    from eventlens.plans import adapters

    seen = spark.sparkContext.accumulator(0)

    def count(x):
        seen.add(1)
        return x

    df = spark.range(500).select(F.udf(count, "long")("id").alias("video_id"), F.timestamp_seconds(F.col("id") * 600).alias("at"), F.lit("x").alias("note"))
    stream = adapters.arrivals(df, "once", end={"video_id": -1})
    assert seen.value == 500
    query = stream.writeStream.format("memory").queryName("once").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted(r.video_id for r in spark.table("once").collect()) == list(range(-1, 500))
    assert len([p for p in query.recentProgress if p.numInputRows]) == adapters.STEPS + 1
