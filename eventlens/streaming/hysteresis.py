"""Hysteresis sessionisation on a stream, with typed state and event-time timers; feeds and classes are dealt to buckets, whose state is read and written together.

Rows are held until the watermark has passed them, so those that arrive out of order within it are taken in order of (start, end, x); later ones are late and Spark drops them.
Beside the held rows, state is the open span, the end of coverage and the merged event that a next span could still join. An event is final, and
emitted, once a later span cannot join it: when the next span begins too far on, or when the watermark is past its end by the coverage gap and the merge gap. When a
stream ends, remaining_events gives what its state still holds.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from eventlens.schema import DEFAULT_POLICY, NORMAL

EVENT = "video_id string, class_name string, start double, end double, score double"
SPAN = ["cover", "latest", "s", "e", "m", "ps", "pe", "pm"]
HELD, KINDS = ["who", "at", "start", "end", "x"], [np.int64, np.int64, float, float, float]
#: A bucket's state.
FEEDS = "video_id array<string>, class_name array<string>, until array<bigint>, " + ", ".join(f"{c} array<double>" for c in SPAN) + ", who array<bigint>, at array<bigint>, " + ", ".join(f"{c} array<double>" for c in HELD[2:])
N_FEEDS = 3 + len(SPAN) + len(HELD)
#: Buckets that the keys of a stream are dealt to. Python and the state store are called once a bucket and batch, so neither once a key nor once a row.
BUCKETS = 256
#: State in RocksDB, where a join keeps both sides in one store a partition instead of in four.
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.streaming.join.stateFormatVersion": "3"}
_COUNTED = "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows"


def explode_classes(verdicts: DataFrame, classes: list[str]) -> DataFrame:
    """Every verdict once for each class of a fixed list, with x, that class's own score."""
    each = verdicts.withColumn("cls", F.explode(F.array(*(F.lit(c) for c in classes if c != NORMAL))))
    x = F.when(F.col("class_name") == F.col("cls"), F.col("score")).otherwise(0.0)
    return each.select(F.col("video_id").cast("string").alias("video_id"), F.col("cls").alias("class_name"), "at", "start", "end", x.alias("x"))


class Machine:
    """One feed and class: rows in order of time to final events. (s, e, m) is the open span, (ps, pe, pm) the event a next span could join."""

    def __init__(self, policy: dict[str, float], state: tuple | None = None):
        self.p = DEFAULT_POLICY | policy
        self.cover, self.latest, self.s, self.e, self.m, self.ps, self.pe, self.pm = state or (None,) * 8
        self.out: list[tuple[float, float, float]] = []

    def state(self) -> tuple:
        return self.cover, self.latest, self.s, self.e, self.m, self.ps, self.pe, self.pm

    def final(self) -> None:
        if self.ps is not None and self.pe - self.ps >= self.p["min_duration_sec"]:
            self.out.append((self.ps, self.pe, self.pm))
        self.ps = self.pe = self.pm = None

    def close(self) -> None:
        if self.s is None:
            return
        if self.ps is not None and self.s - self.pe <= self.p["merge_gap_sec"]:
            self.pe, self.pm = max(self.pe, self.e), max(self.pm, self.m)
        else:
            self.final()
            self.ps, self.pe, self.pm = self.s, self.e, self.m
        self.s = self.e = self.m = None

    def row(self, start: float, end: float, x: float) -> None:
        if self.s is not None and start - self.cover > self.p["max_window_gap_sec"]:
            self.close()
        if self.s is None and self.ps is not None and start - self.pe > self.p["merge_gap_sec"]:
            self.final()
        if self.s is None:
            if x >= self.p["theta_high"]:
                self.s, self.e, self.m = start, end, x
        elif x >= self.p["theta_low"]:
            self.e, self.m = max(self.e, end), max(self.m, x)
        else:
            self.close()
        self.cover = end if self.cover is None else max(self.cover, end)
        self.latest = start

    def end(self) -> None:
        self.close()
        self.final()

    def wait(self) -> float:
        """How long after the start of the last row a later one could still join, in the units of the rows."""
        return self.cover - self.latest + self.p["max_window_gap_sec"] + self.p["merge_gap_sec"]


def _machines(policy: dict[str, float], spans: list[tuple], who: np.ndarray, start: np.ndarray, end: np.ndarray, x: np.ndarray) -> Iterator[tuple[int, int, int, Machine]]:
    """Each feed's machine, by its place in spans, after its rows: place, first and last row, machine. Rows are in order of who, then time."""
    edges = [0, *(np.flatnonzero(np.diff(who)) + 1).tolist(), len(who)] if len(who) else [0]
    for a, b in pairwise(edges):
        k = int(who[a])
        machine = Machine(policy, spans[k])
        for row in zip(start[a:b].tolist(), end[a:b].tolist(), x[a:b].tolist()):
            machine.row(*row)
        yield k, a, b, machine


class Feed(StatefulProcessor):
    """Per bucket of feeds and classes: holds rows until the watermark, then runs each feed's machine over its own.

    State is a row of arrays: a feed's span and until when (milliseconds) its pending event may be joined; of held rows the feed's place in those, and the row.
    A timer stands at the first held row, or where the first pending event of a feed that holds none becomes final.
    """

    def __init__(self, unit: float, policy: dict[str, float]):
        self.unit, self.policy = unit, policy

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.feeds = handle.getValueState("feeds", FEEDS)

    def _advance(self, frames: Iterator[pd.DataFrame], mark: int) -> Iterator[pd.DataFrame]:
        """frames: new rows (at in microseconds); mark: the watermark in milliseconds."""
        videos, classes, until, *rest = self.feeds.get() if self.feeds.exists() else [[]] * N_FEEDS
        spans, held = list(zip(*rest[:8])), rest[8:]
        names, until = list(zip(videos, classes)), list(until)
        place = {name: k for k, name in enumerate(names)}
        parts = [[np.array(c, kind) for c, kind in zip(held, KINDS)]]
        for frame in frames:
            who = []
            for name in zip(frame["video_id"], frame["class_name"]):
                k = place.get(name)
                if k is None:
                    k = place[name] = len(names)
                    names.append(name)
                    spans.append((None,) * 8)
                    until.append(0)
                who.append(k)
            parts.append([np.array(who, np.int64), *(frame[c].to_numpy(kind) for c, kind in zip(("us", "start", "end", "x"), KINDS[1:]))])
        who, at, start, end, x = (np.concatenate(c) for c in zip(*parts))
        ready = at <= mark * 1000
        order = np.flatnonzero(ready)
        order = order[np.lexsort((at[order], x[order], end[order], start[order], who[order]))]
        waits = np.zeros(len(names), bool)
        waits[who[~ready]] = True
        out, times, ran = [], at[order], set()
        for k, a, b, machine in _machines(self.policy, spans, who[order], start[order], end[order], x[order]):
            spans[k] = machine.state()
            # With nothing held the feed waits until no later row could join.
            until[k] = max(int(times[a:b].max() / 1000 + machine.wait() * self.unit * 1000) + 1, mark + 1)
            ran.add(k)
            out += [(*names[k], *o) for o in machine.out]
        stay = []
        for k, name in enumerate(names):
            if waits[k] or k in ran or until[k] > mark:
                stay.append(k)
            else:  # nothing of it is left
                machine = Machine(self.policy, spans[k])
                machine.end()
                out += [(*name, *o) for o in machine.out]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if stay:
            moved = np.zeros(len(names), np.int64)
            moved[stay] = np.arange(len(stay))
            columns = zip(*((*names[k], until[k], *spans[k]) for k in stay))
            rows = (moved[who[~ready]], *(c[~ready] for c in (at, start, end, x)))
            self.feeds.update((*map(list, columns), *(c.tolist() for c in rows)))
            timers = [until[k] for k in stay if not waits[k]] + (-(-rows[1] // 1000)).tolist()
            self.handle.registerTimer(max(min(timers), mark + 1))
        else:
            self.feeds.clear()
        if out:
            yield pd.DataFrame(out, columns=["video_id", "class_name", "start", "end", "score"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        yield from self._advance(rows, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield from self._advance(iter([]), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_events(streams: DataFrame, watermark: str = "1 hour", unit: float = 1.0, buckets: int = BUCKETS, **policy: float) -> DataFrame:
    """Final events of a stream (video_id, class_name, at timestamp, start, end, x); start and end in units of `unit` seconds since the epoch of at's origin.

    Run it by run_available, or start it within keyed_state(): its state needs the RocksDB store. Feeds and classes are dealt to so many
    buckets, whose number a checkpoint is bound to.
    """
    p = DEFAULT_POLICY | policy
    if p["theta_low"] > p["theta_high"]:
        raise ValueError("theta_low is above theta_high")
    marked = streams.where(F.col("at").isNotNull()).withWatermark("at", watermark)
    bucket = F.pmod(F.xxhash64("video_id", "class_name"), F.lit(buckets)).alias("bucket")
    dealt = marked.select(bucket, F.col("video_id").cast("string").alias("video_id"), "class_name", "at", F.unix_micros("at").alias("us"), "start", "end", "x")
    return dealt.groupBy("bucket").transformWithStateInPandas(Feed(unit, policy), EVENT, "append", "EventTime")


def remaining_events(spark: SparkSession, checkpoint: str, **policy: float) -> DataFrame:
    """The events that a stopped stream's state still holds: with those emitted, the events of all rows read so far.

    The state is read as a table from the query's checkpoint, a bucket a row: each machine goes on from its span over its held rows, of which a feed has no more than
    the watermark's delay allows.
    """
    state = spark.read.format("statestore").option("stateVarName", "feeds").load(checkpoint).select("key.bucket", "value.*")

    def finish(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in frame.to_dict("records"):
            names = list(zip(r["video_id"], r["class_name"]))
            spans = [tuple(None if v is None or v != v else float(v) for v in span) for span in zip(*(r[c] for c in SPAN))]
            who, _, start, end, x = (np.asarray(r[c], kind) for c, kind in zip(HELD, KINDS))
            order = np.lexsort((x, end, start, who))
            machines = {k: m for k, _, _, m in _machines(policy, spans, who[order], start[order], end[order], x[order])}
            for k, name in enumerate(names):
                machine = machines.get(k) or Machine(policy, spans[k])
                machine.end()
                out += [(*name, *o) for o in machine.out]
        return pd.DataFrame(out, columns=["video_id", "class_name", "start", "end", "score"])

    return state.groupBy("bucket").applyInPandas(finish, EVENT)


@contextmanager
def keyed_state(spark: SparkSession, counted: bool = True) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which typed state needs. counted: their progress tells the rows of it, at the cost of a look-up for every write."""
    conf = _STATE if counted else _STATE | {_COUNTED: "false"}
    old = {name: spark.conf.get(name, None) for name in conf}
    for name, value in conf.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in old.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Runs what is there to the end, into parquet."""
    with keyed_state(stream.sparkSession, counted=False):
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def windowed_counts(verdicts: DataFrame, window: str = "32 seconds", slide: str = "8 seconds", watermark: str = "1 minute") -> DataFrame:
    """Verdicts and anomalous ones per feed in hopping windows of event time."""
    marked = verdicts.withWatermark("at", watermark)
    return marked.groupBy("video_id", F.window("at", window, slide)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("class_name") != NORMAL).alias("anomalous"))


def session_counts(verdicts: DataFrame, gap: str = "8 seconds", watermark: str = "1 minute") -> DataFrame:
    """Sessions of anomalous verdicts per feed and class, parted by inactivity.

    Normal verdicts advance the watermark too: the filter names the event time, so it isn't pushed below the watermark.
    """
    marked = verdicts.withWatermark("at", watermark).where(F.when(F.col("at").isNotNull(), F.col("class_name") != NORMAL))
    return marked.groupBy("video_id", "class_name", F.session_window("at", gap)).agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("score"))
