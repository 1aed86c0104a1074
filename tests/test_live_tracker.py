"""The tracker over late rows against the batch tracker."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetrail.operators import tracking
from kinetrail.streaming import live_tracker, twins

SCHEMA = "video string, frame long, comp_id long, cx double, cy double, area double, border boolean"


@pytest.fixture()
def rocks(spark):
    for k, v in live_tracker.STATE_STORE.items():
        spark.conf.set(k, v)
    yield
    for k in live_tracker.STATE_STORE:
        spark.conf.unset(k)


def streamed(spark, tmp_path, batches, delay, gap):
    """Runs the batches one after another; each is one micro-batch."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    for i, rows in enumerate(batches):
        frame = twins.event_time(spark.createDataFrame(rows, SCHEMA), "frame", 20.0)
        frame.toPandas().to_parquet(folder / f"{i:03}.parquet", coerce_timestamps="us", index=False)
    source = spark.readStream.schema(SCHEMA + ", ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(folder))
    found = live_tracker.track(source, 20.0, delay, gap=gap)
    found.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("video string, frame long, comp_id long, track_id long").parquet(out)


def test_late_rows_within_the_delay_change_nothing(spark, rocks, tmp_path):
    r = random.Random(5)
    rows = [(v, f, c, r.uniform(0, 500), r.uniform(0, 500), r.uniform(80, 120), r.random() < 0.2) for v in ("a", "b") for f in range(120) if not (v == "a" and 40 < f < 70) for c in range(3)]
    late = sorted(rows, key=lambda x: x[1] + r.uniform(0, 30))  # at most 30 frames, 1.5 s, out of order
    size = len(late) // 6 + 1
    flush = [[("z", 10_000, 0, 0.0, 0.0, 1.0, False)], [("z", 10_001, 0, 0.0, 0.0, 1.0, False)]]
    got = streamed(spark, tmp_path, [late[i : i + size] for i in range(0, len(late), size)] + flush, "2 seconds", 15).where("video <> 'z'")
    want = tracking.track(spark.createDataFrame(rows, SCHEMA), gap=15)
    columns = ["video", "frame", "comp_id", "track_id"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_rows_after_the_delay_are_left_out(spark, rocks, tmp_path):
    def at(f, x):
        return ("a", f, 0, x, 0.0, 100.0, False)

    batches = [[at(0, 0.0), at(1, 1.0)], [at(400, 2.0)], [at(2, 1.5), at(401, 3.0)], [at(900, 9.0)], [at(901, 9.0)]]
    got = {x["frame"]: x["track_id"] for x in streamed(spark, tmp_path, batches, "1 second", 15).collect()}
    assert got == {0: 0, 1: 0, 400: 1, 401: 1}  # frame 2 came too late; 900 still waits


class Handle:
    """State and timers in memory."""

    class Map(dict):
        def getValue(self, k):
            return self[k]

        def containsKey(self, k):
            return k in self

        def updateValue(self, k, v):
            self[k] = v

        def removeKey(self, k):
            self.pop(k, None)

        def iterator(self):
            return iter(list(self.items()))

    class Value:
        v = None

        def exists(self):
            return self.v is not None

        def get(self):
            return self.v

        def update(self, v):
            self.v = v

    def __init__(self):
        self.timers = []

    def getMapState(self, *_):
        return self.Map()

    def getValueState(self, *_):
        return self.Value()

    def registerTimer(self, t):
        self.timers.append(t)


class At:
    def __init__(self, t):
        self.t = t

    def getCurrentWatermarkInMs(self):
        return self.t

    def getExpiryTimeInMs(self):
        return self.t


def test_tracks_leave_the_state_when_their_video_ends():
    p, h = live_tracker.TrackProcessor("video", 20.0, 15, 150.0, 450.0, 0.7, 0.9), Handle()
    p.init(h)
    rows = pd.DataFrame([(0, 0, 1.0, 1.0, 100.0, False), (1, 0, 2.0, 1.0, 100.0, False), (1, 1, 400.0, 400.0, 100.0, False)], columns=live_tracker.COLUMNS)
    list(p.handleInputRows(("a",), iter([rows]), At(0)))
    assert sorted(k[0] for k in p.waiting) == [0, 1] and not p.tracks
    first = pd.concat(p.handleExpiredTimer(("a",), At(0), At(p.millis(1))))
    assert first["track_id"].tolist() == [0, 0, 1] and not p.waiting and sorted(p.tracks) == [(0,), (1,)]
    last = max(h.timers)
    assert last == p.millis(16) and not list(p.handleExpiredTimer(("a",), At(0), At(last))) and not p.tracks
    assert p.started.get() == (2,)  # ids are never used again
    list(p.handleInputRows(("a",), iter([rows.assign(frame=5)]), At(p.millis(5))))
    assert not p.waiting


def test_pixels_of_one_frame_in_two_batches_meet(spark, rocks, tmp_path):
    batches = [[("a", 0, 0, 0.0, 0.0, 100.0, False)], [("a", 0, 1, 300.0, 0.0, 100.0, False)], [("a", 1, 0, 301.0, 0.0, 100.0, False), ("a", 1, 1, 1.0, 0.0, 100.0, False)], [("z", 10_000, 0, 0.0, 0.0, 1.0, False)], [("z", 10_001, 0, 0.0, 0.0, 1.0, False)]]
    got = streamed(spark, tmp_path, batches, "1 second", 15).where(F.col("video") == "a")
    assert sorted(map(tuple, got.select("frame", "comp_id", "track_id").collect())) == [(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 0)]
