"""Streaming twins of the batch windows and of the tracker.

Sources need a `timestamp` event time; `event_time` makes it from frames (or from a timestamp without zone). Windows
come out in append mode once the watermark has passed them, so late rows within the delay are counted and later ones are not.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.tracking import LiveTracks

EPOCH = 1_600_000_000  # a multiple of every window length used here; frame 0's time


def event_time(frames: DataFrame, frame: str, fps: float, out: str = "ts") -> DataFrame:
    return frames.withColumn(out, F.timestamp_micros((F.lit(EPOCH * 1_000_000) + F.col(frame) * F.lit(1e6 / fps)).cast("long")))


def zoned(df: DataFrame, column: str) -> DataFrame:
    """A timestamp without zone as a timestamp in the session's zone, which watermarks need."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def hop_windows(stream: DataFrame, keys: list[str], time: str, size_s: float, step_s: float, delay: str, aggregates: list[Column]) -> DataFrame:
    """Windows of size_s every step_s, with start t0_s in seconds since frame 0. Windows that begin before frame 0 are left out, as the batch operator has none."""
    w = F.window(time, f"{size_s} seconds", f"{step_s} seconds")
    out = stream.withWatermark(time, delay).groupBy(*keys, w.alias("w")).agg(*aggregates)
    start = F.unix_micros("w.start") / 1e6 - EPOCH
    return out.withColumn("t0_s", start).where("t0_s >= 0").drop("w")


def sessions(stream: DataFrame, keys: list[str], time: str, gap_s: float, delay: str, aggregates: list[Column]) -> DataFrame:
    """Runs of events that lie less than gap_s apart."""
    s = F.session_window(time, f"{gap_s} seconds")
    out = stream.withWatermark(time, delay).groupBy(*keys, s.alias("s")).agg(*aggregates)
    return out.withColumn("start_s", F.unix_micros("s.start") / 1e6 - EPOCH).select(*keys, "start_s", *[c for c in out.columns if c not in (*keys, "s")])


def track(stream: DataFrame, key: str = "video", gap: int = 200, near: float = 150.0, far: float = 450.0, area_log: float = 0.7, keep: float = 0.9, idle_ms: int | None = None) -> DataFrame:
    """Track ids per video for components (frame, comp_id, cx, cy, area, border) that arrive in frame order within a video: the batch tracker's
    steps, with its live tracks as state. A track that was not seen for `gap` frames leaves the state, and with
    idle_ms a video's state goes when nothing arrived for that long; such a query runs until it is stopped, also with availableNow.
    Without areas or borders all are alike. Rows of one micro-batch are sorted by frame first."""
    kind = dict(stream.dtypes)[key]

    def run(k, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(batches), ignore_index=True).sort_values(["frame", "comp_id"], kind="stable")
        live = LiveTracks(gap, near, far, area_log, keep, state.get if state.exists else None)
        ids = live.run(pdf)
        state.update(live.state())
        if idle_ms is not None:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: k[0], "frame": pdf["frame"].astype("int64"), "comp_id": pdf["comp_id"].astype("int64"), "track_id": ids})

    names = zip(LiveTracks.FIELDS, ("long", "long", "double", "double", "double", "boolean"), strict=True)
    has = {c: F.col(c) if c in stream.columns else F.lit(x).alias(c) for c, x in (("area", 1.0), ("border", False))}
    return stream.select(key, "frame", "comp_id", "cx", "cy", *has.values()).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, frame long, comp_id long, track_id long", "started long, " + ", ".join(f"{c} array<{t}>" for c, t in names), "append", "NoTimeout" if idle_ms is None else "ProcessingTimeTimeout")
