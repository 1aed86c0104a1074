"""The tracker over a stream whose rows may be late: state per video, event-time timers per frame.

Rows wait in state until the watermark has passed their frame; then the frame's timer lets the tracker take it, in order, whatever
the order in which rows arrived. Rows that come after their frame was passed are late and left out, as the watermark says. Live
tracks are kept one by one in map state: a track that is not continued for `gap` frames leaves it with the next frame, or, where
no frame follows, by a timer of its own time, so that a video that ends leaves no tracks behind.

The state store must be RocksDB (`STATE_STORE`), which Spark requires for timers and maps.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.tracking import LiveTracks
from .twins import EPOCH

STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
COLUMNS = ["frame", "comp_id", "cx", "cy", "area", "border"]
KINDS = {"frame": "int64", "comp_id": "int64", "cx": float, "cy": float, "area": float, "border": bool}


class TrackProcessor(StatefulProcessor):
    def __init__(self, key: str, fps: float, gap: int, near: float, far: float, area_log: float, keep: float):
        self.key, self.fps, self.rules, self.gap = key, fps, (gap, near, far, area_log, keep), gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "frame long", "rows array<struct<comp_id:long,cx:double,cy:double,area:double,border:boolean>>")
        self.tracks = handle.getMapState("tracks", "id long", "last long, x double, y double, area double, border boolean")
        self.started = handle.getValueState("started", "n long")

    def millis(self, frame: int) -> int:
        """A frame's time: the one that event_time gives it, in whole milliseconds."""
        return EPOCH * 1000 + int(frame * 1e6 / self.fps) // 1000

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        for pdf in rows:
            for frame, part in pdf.groupby("frame"):
                frame = int(frame)
                if self.millis(frame) <= passed:  # its timer has fired
                    continue
                new = list(zip(part["comp_id"].astype(int), part["cx"].astype(float), part["cy"].astype(float), part["area"].astype(float), part["border"].astype(bool), strict=True))
                new = [tuple(x.item() if hasattr(x, "item") else x for x in row) for row in new]
                old = [tuple(x) for x in self.waiting.getValue((frame,))[0]] if self.waiting.containsKey((frame,)) else []
                self.waiting.updateValue((frame,), (old + new,))
                self.handle.registerTimer(self.millis(frame))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(k[0] for k in self.waiting.keys() if self.millis(k[0]) <= now)
        live = sorted((k[0], *v) for k, v in self.tracks.iterator())
        state = (self.started.get()[0] if self.started.exists() else 0, *([list(c) for c in zip(*live)] if live else [[]] * 6))
        tracks = LiveTracks(*self.rules, state)
        out = []
        for frame in due:
            rows = pd.DataFrame([tuple(x) for x in self.waiting.getValue((frame,))[0]], columns=COLUMNS[1:]).assign(frame=frame)[COLUMNS].astype(KINDS).sort_values("comp_id", kind="stable")
            out.append(pd.DataFrame({self.key: pd.Series([key[0]] * len(rows), index=rows.index, dtype=object), "frame": frame, "comp_id": rows["comp_id"], "track_id": tracks.run(rows)}))
            self.waiting.removeKey((frame,))
        kept = [row for row in zip(*(getattr(tracks, c).tolist() for c in LiveTracks.FIELDS), strict=True) if self.millis(row[1] + self.gap) > now]
        for gone in {row[0] for row in live} - {row[0] for row in kept}:
            self.tracks.removeKey((gone,))
        for i, last, x, y, area, border in kept:
            self.tracks.updateValue((i,), (last, x, y, area, border))
        if due:
            self.started.update((tracks.started,))
            self.handle.registerTimer(self.millis(int(max(due)) + self.gap))
        if out:
            yield pd.concat(out, ignore_index=True)

    def close(self) -> None:
        pass


def track(stream: DataFrame, fps: float, delay: str, key: str = "video", gap: int = 200, near: float = 150.0, far: float = 450.0, area_log: float = 0.7, keep: float = 0.9) -> DataFrame:
    """(key, frame, comp_id, track_id) as the batch tracker gives them, for components (ts of twins.event_time, frame, comp_id, cx, cy, area, border)
    that arrive at most `delay` late. A frame's rows come out once the watermark has passed it."""
    kind = dict(stream.dtypes)[key]
    has = {c: F.col(c) if c in stream.columns else F.lit(x).alias(c) for c, x in (("area", 1.0), ("border", False))}
    rows = stream.withWatermark("ts", delay).select(key, "ts", "frame", "comp_id", "cx", "cy", *has.values())
    processor = TrackProcessor(key, fps, gap, near, far, area_log, keep)
    return rows.groupBy(key).transformWithStateInPandas(processor, f"{key} {kind}, frame long, comp_id long, track_id long", "Append", "EventTime")


