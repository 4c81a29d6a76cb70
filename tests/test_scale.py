"""What must hold as tables grow: plans without large broadcasts, numbers that don't depend on the deal of rows, tasks of bounded size."""

import json

from pyspark.sql import functions as F

from eventlens.functions import scoring
from eventlens.llm import bpe
from eventlens.operators import matching, sessions, submission, sweep, synth, windows
from eventlens.plans import adapters
from eventlens.sources import readers, writers


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_first_events_are_not_broadcast(spark):
    """Sizes before explode say nothing of what comes out; the joins of windows and events sort and merge."""
    clips = spark.range(50).select(F.col("id").alias("video_id"), F.lit(40.0).alias("duration"))
    truth = clips.select("video_id", F.lit("fire").alias("class_name"), F.lit(1).alias("ord"), F.lit(None).cast("double").alias("start"), F.lit(None).cast("double").alias("end"))
    out = windows.oracle_verdicts(windows.sliding_windows(clips, "duration"), truth)
    assert "Broadcast" not in plan(out)
    assert [tuple(r) for r in out.select("class_name", F.lit(1)).groupBy("class_name").count().collect()] == [("fire", 500)]


def test_numbers_are_whole_over_many_ranges(spark):
    """More rows than are sampled for the ranges' bounds: every number from 1 once, in order of the key, whatever other columns are asked for."""
    n = 60_000
    rows = spark.range(n).select(F.struct((F.col("id") * 7919 % n).alias("a"), F.lit(0).alias("b")).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("pad")).repartition(8)
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        out = synth.numbered(rows, "key")
        bad = out.where("pool_no <> key.a + 1").count()
        assert (out.count(), bad, out.agg(F.sum(F.length("pad"))).first()[0]) == (n, 0, 64 * n)
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


def test_probability_evaluates_its_logits_once(spark):
    """The steps of a reply stand in the plan once: what is named several times is bound, not repeated."""
    said = F.array(F.struct(F.concat(F.lit(" tr"), F.lit("ue"), F.col("id").cast("string")).alias("piece"), F.array(F.lit(-10.0), F.sqrt("id"), F.lit(0.5), F.lit(None).cast("double")).alias("logits")))
    out = spark.range(1, 5).select("id", scoring.boolean_probability(said, [1], [2]).alias("p"))
    text = out._jdf.queryExecution().optimizedPlan().toString().upper()
    assert (text.count("SQRT("), text.count("AGGREGATE("), text.count("ARRAY_MAX(")) == (1, 1, 1)
    null = spark.range(1).select(scoring.boolean_probability(F.array(F.struct(F.lit("no").alias("piece"), F.array(F.lit(1.0)).alias("logits"))), [1], [2]).alias("p"))
    assert null.first().p is None


def test_a_document_is_written_and_read_in_parts(spark, tmp_path):
    """The parts in order are one JSON text with the entries in order of video; no row holds them all."""
    n, at = 3_000, tmp_path / "d"
    none = F.lit(None).cast("double")
    event = F.struct(F.lit('a "quoted" } name\n').alias("class_name"), none.alias("start_time_sec"), F.col("id").cast("double").alias("end_time_sec"), F.lit(None).cast("string").alias("explanation"))
    found = spark.range(n).repartition(5).select(F.format_string("v%05d", "id").alias("video_id"), F.when(F.col("id") % 3 > 0, F.array(event)).otherwise(F.array().cast("array<struct<class_name:string,start_time_sec:double,end_time_sec:double,explanation:string>>")).alias("events"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        head = submission.document_head(spark, "id", "m", "cpu", 1.0)
        assert not writers.document_lines(found, head, str(at))
        assert writers.document_lines(found, head, str(at), warn=1000)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted(at.glob("part-*"))
    assert len(parts) > 1 and max(p.stat().st_size for p in parts) < 0.7 * sum(p.stat().st_size for p in parts)
    doc = json.loads("".join(p.read_text() for p in parts))
    assert (doc["schema_version"], doc["run_metadata"]["hardware"]) == ("1.0", "cpu")
    assert [p["video_id"] for p in doc["predictions"]] == [f"v{k:05d}" for k in range(n)]
    assert doc["predictions"][1]["events"] == [{"class_name": 'a "quoted" } name\n', "start_time_sec": None, "end_time_sec": 1.0, "explanation": None}]
    got = {r.video_id: [tuple(e)[:3] for e in r.events] for r in readers.submission_lines(spark, str(at)).collect()}
    assert got == {f"v{k:05d}": [('a "quoted" } name\n', None, float(k))] if k % 3 else [] for k in range(n)}
    writers.document_lines(found.where("false"), head, str(at))
    assert json.loads("".join(p.read_text() for p in sorted(at.glob("part-*"))))["predictions"] == []


def test_tasks_of_a_sweep_are_dealt_by_rows(spark, sf, monkeypatch):
    """The scan's tasks follow the number of verdicts, not of shuffled bytes; the events and the scores stay the same."""
    v, t, some = adapters.verdicts(spark, sf), adapters.truth(spark, sf), sweep.grid(spark, [0.3, 0.5], [0.2], [5.0, 15.0], [0.0, 4.0])
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = rows(sessions.combinations(v, some)[0]), rows(sweep.sweep(v, t, some))
    monkeypatch.setattr(sessions, "VERDICTS", v.count() // 9)
    monkeypatch.setattr(matching, "ROWS", 200)
    streams = sessions.dealt(sessions.candidate_streams(v), v)
    assert streams.withColumn("p", F.spark_partition_id()).select("p").distinct().count() > 4
    assert (rows(sessions.combinations(v, some)[0]), rows(sweep.sweep(v, t, some))) == want


def test_gaps_draw_what_they_need(spark, monkeypatch):
    """Gaps draw by the mean length first; those left open by short clips draw on, so that timelines are those of all draws at once."""
    videos = spark.range(60).select(F.format_string("v%d", "id").alias("video_id"), (F.col("id") % 4 == 0).alias("pure"))
    normals = spark.range(40).select(F.format_string("n%02d", "id").alias("path"), F.when(F.col("id") < 36, 1.25).otherwise(90.0).alias("duration"))
    bad = spark.range(9).select(F.format_string("b%d", "id").alias("path"), F.lit("fire").alias("class_name"), F.lit(1.0).alias("start"), F.lit(3.0).alias("end"), F.lit(5.0).alias("duration"))
    rows = lambda: sorted(map(repr, synth.timelines(videos, normals, bad, seed=3).collect()))
    monkeypatch.setattr(synth, "DRAWS", 0)
    few = rows()
    monkeypatch.setattr(synth, "DRAWS", 10_000)
    assert few == rows() and len(few) == 60


def test_the_tree_of_a_usual_word_is_its_root():
    """Merging compares few nodes: a word of up to WIDTH bytes asks for its ranks and no tree is walked; longer ones agree with a plain loop."""
    import random

    rng, ranks = random.Random(4), {bytes([c]): c - 97 for c in range(97, 101)}
    for a in [x + y for x in list(ranks) for y in list(ranks)] + [x + y + z for x in list(ranks) for y in list(ranks)[:2] for z in list(ranks)[:2]]:
        ranks[a] = len(ranks)

    def plain(piece):
        parts = [piece[k : k + 1] for k in range(len(piece))]
        while True:
            found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks]
            if not found:
                return [ranks[x] for x in parts]
            k = min(found)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]

    assert bpe.WIDTH >= 8
    for n in [*range(40), 255, 256, 257, 300]:
        piece = bytes(rng.choice(b"abcd") for _ in range(n))
        assert bpe.merge(piece, ranks) == plain(piece)
