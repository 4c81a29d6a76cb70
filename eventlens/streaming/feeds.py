"""Batch operators on streams: the gate as a join of two streams, gap merge as sessions with a dynamic gap, the window grid with state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from eventlens.operators.sessions import gated
from eventlens.schema import NORMAL, SCALES
from eventlens.streaming.hysteresis import BUCKETS

WINDOW = "video_id string, win_ord int, win_start double, win_end double"


def gate(first: DataFrame, second: DataFrame, least: float = 0.95, watermark: str = "1 hour", apart: str = "10 minutes") -> DataFrame:
    """sessions.gate of two streams with an event time `at`: verdicts and the other model's score for the same window, told no more than `apart` from each other.

    Both sides wait in state until the watermark is past what they could still meet; a verdict without a partner comes out then, as not confirmed. Only what a partner
    can change waits: normal verdicts come out at once, and scores that don't reach `least`, which change as little as none, aren't kept. A window's
    score should be told once: each that reaches `least` gives its verdict a row. Rows without an event time are left out.
    """
    a = first.where(F.col("at").isNotNull()).withWatermark("at", watermark)
    b = second.where(F.col("at").isNotNull()).select(F.col("video_id").alias("_v"), F.col("at").alias("_at"), F.col("start").alias("_s"), F.col("end").alias("_e"), F.col("score").alias("_second")).withWatermark("_at", watermark)
    near = F.expr(f"_at BETWEEN at - INTERVAL {apart} AND at + INTERVAL {apart}")
    # Low scores advance the watermark too: the filter names the event time, so it isn't pushed below the watermark.
    counts = ~F.col("class_name").eqNullSafe(NORMAL) & F.when(F.col("_at").isNotNull(), F.col("_second") >= least)
    joined = a.join(b, (F.col("video_id") == F.col("_v")) & (F.col("start") == F.col("_s")) & (F.col("end") == F.col("_e")) & near & counts, "leftOuter")
    return gated(joined, first.columns, least)


def merged(spans: DataFrame, merge_gap_sec: float = 5.0, watermark: str = "1 hour", unit: float = 1.0) -> DataFrame:
    """sessions.merge of a stream of spans (video_id, class_name, at: the time of start, start, end, score): start, end, score of the events.

    A span keeps its session open for its own length and the merge gap, so the session ends where the running end of its spans does. A session has its end for
    its own, so a span that starts just there joins. start and end are in units of `unit` seconds. Batch or stream; nulls in at are left out.
    """
    gap = F.make_interval(secs=F.round((F.col("end") - F.col("start") + merge_gap_sec) * unit, 6).cast("decimal(18,6)"))
    marked = spans.where(F.col("at").isNotNull()).withWatermark("at", watermark)
    out = marked.groupBy("video_id", "class_name", F.session_window("at", gap)).agg(F.min("start").alias("start"), F.max("end").alias("end"), F.max("score").alias("score"))
    return out.drop("session_window")


class Grid(StatefulProcessor):
    """Per bucket of videos: each one's length seen so far, its next window's number, whether it has ended, and until when (milliseconds) chunks may still come.

    All videos of a bucket are worked out together, as arrays: Python and the state store are called once a bucket and batch, not once a video.
    """

    def __init__(self, window: float, stride: float, idle: float):
        self.window, self.stride, self.idle = window, stride, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "video_id array<string>, upto array<double>, next array<int>, done array<boolean>, until array<bigint>")

    def _emit(self, videos: pd.DataFrame, whole: np.ndarray) -> tuple[pd.DataFrame, np.ndarray]:
        """Windows that are certain at these lengths, with the last one, cut, where the whole length is known; each video's next number."""
        upto, first = videos["upto"].to_numpy(float), videos["next"].to_numpy(np.int64)
        steps = (upto - self.window) / self.stride
        last = np.where(whole, np.where(upto > 0, np.maximum(0, np.ceil(steps)), -1), np.floor(steps)).astype(np.int64)
        n = np.maximum(0, last - first + 1)
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
        end, known, start = np.repeat(upto, n), np.repeat(whole, n), k * self.stride
        rows = pd.DataFrame({"video_id": videos["video_id"].to_numpy(object).repeat(n), "win_ord": k.astype(np.int32), "win_start": start, "win_end": np.where(known, np.minimum(start + self.window, end), start + self.window)})
        return rows[~known | (start < end)], np.maximum(first, last + 1)

    def _advance(self, new: list[pd.DataFrame], mark: int) -> Iterator[pd.DataFrame]:
        """new: this batch's chunks, a row a video and frame (video_id, upto, last, until); mark: the watermark in milliseconds."""
        known = pd.DataFrame(dict(zip(("video_id", "upto", "next", "done", "until"), self.seen.get() if self.seen.exists() else [[]] * 5)))
        every = pd.concat([known.astype({"upto": float, "next": int, "done": bool, "until": int}).assign(last=False, told=False), *(f.assign(next=0, done=False, told=True) for f in new)])
        v = every.groupby("video_id", dropna=False, sort=False).max().reset_index()
        idle = (~v["told"] & (v["until"] <= mark)).to_numpy()
        v.loc[v["told"], "until"] = v["until"].clip(lower=mark + 1)
        open_ = (v["told"].to_numpy() | idle) & ~v["done"].to_numpy()
        out, nexts = self._emit(v[open_], (v["last"].to_numpy() | idle)[open_])
        v.loc[open_, "next"] = nexts
        v["done"] |= v["last"]
        v = v[~idle]
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        if len(v):
            ids = [x if isinstance(x, str) else None for x in v["video_id"]]
            self.seen.update((ids, *(v[c].tolist() for c in ("upto", "next", "done", "until"))))
            self.handle.registerTimer(max(int(v["until"].min()), mark + 1))
        else:
            self.seen.clear()
        if len(out):
            yield out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = []
        for frame in rows:
            each = frame.groupby("video_id", dropna=False, sort=False).agg(upto=("upto", "max"), last=("last", "max"), until=("ms", "max")).reset_index()
            new.append(each.assign(until=each["until"] + int(self.idle * 1000)))
        yield from self._advance(new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        yield from self._advance([], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def grid(chunks: DataFrame, window: float = SCALES["short"][0], stride: float = SCALES["short"][0], watermark: str = "1 hour", idle: float = 3600.0, buckets: int = BUCKETS) -> DataFrame:
    """The windows of growing videos: video_id, win_ord, win_start, win_end, counted from each video's own beginning.

    chunks: video_id, at (timestamp), upto (seconds of the video that are there now), last. A window comes out once the video covers it; the last one is cut when the
    video ends, by its last chunk or because it has been idle for `idle` seconds of event time. Chunks may come in any order within the watermark. Start it
    within hysteresis.keyed_state(). Null at or upto are left out. Videos are dealt to so many buckets, whose number a checkpoint is bound to.
    """
    marked = chunks.where("at is not null and upto is not null").withWatermark("at", watermark)
    video = F.col("video_id").cast("string")
    marked = marked.select(F.pmod(F.xxhash64(video), F.lit(buckets)).alias("bucket"), video.alias("video_id"), "at", F.unix_millis("at").alias("ms"), F.col("upto").cast("double").alias("upto"), F.coalesce("last", F.lit(False)).alias("last"))
    return marked.groupBy("bucket").transformWithStateInPandas(Grid(window, stride, idle), WINDOW, "append", "EventTime")
