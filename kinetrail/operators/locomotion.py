"""How tracks move: smoothed speed per frame, and per track and video the time spent moving, the speed, and the bouts of movement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import relational, series


def smoothed_speed(frames: DataFrame, fps: float, length: float, gap: int, size: int) -> DataFrame:
    """frames (video, track, frame, cx, cy, core) with `v`: speed in lengths per second between frames with core, short gaps filled, rolling median."""
    keys = ["video", "track"]
    out = series.speed(frames, keys, "frame", "cx", "cy", "core", fps, length)
    out = series.interpolate(out, keys, "frame", "speed", gap, "filled")
    return series.rolling_median(out, keys, "frame", "filled", size, "v").drop("speed", "filled")


def track_report(speeds: DataFrame, fps: float, moving: float, bridge: int, least: int) -> DataFrame:
    """Per video and track: seconds seen, median speed, shares of moving and pausing frames, and number, frames and greatest length of the bouts of movement (gaps up to bridge are closed, shorter ones than least left out)."""
    v = F.col("v")
    parts = speeds.groupBy("video", "track").agg((F.count_if("core") / fps).alias("core_s"), relational.median("v").alias("speed"), F.avg((v > moving).cast("double")).alias("frac_move"), F.avg((v <= moving).cast("double")).alias("frac_pause"))
    bouts = series.bridged_runs(speeds.withColumn("__m", v > moving), ["video", "track"], "frame", "__m", bridge, least)
    n = F.col("b") - F.col("a") + 1
    bouts = bouts.groupBy("video", "track").agg(F.count(F.lit(1)).alias("bouts"), F.sum(n).alias("bout_frames"), F.max(n).alias("longest_bout"))
    return parts.join(bouts, ["video", "track"], "left").fillna(0, ["bouts", "bout_frames", "longest_bout"])


def with_videos(report: DataFrame, label: str = "ALL") -> DataFrame:
    """The report with a row `label` per video: sums, the longest bout, and means weighted by the seconds of the tracks that have the value."""
    w = F.col("core_s")

    def mean(c: str) -> Column:
        return F.try_divide(F.sum(F.col(c) * w), F.sum(F.when(F.col(c).isNotNull(), w))).alias(c)

    every = report.groupBy("video").agg(F.lit(label).alias("track"), *[mean(c) for c in ("speed", "frac_move", "frac_pause")], F.sum("core_s").alias("core_s"), F.sum("bouts").alias("bouts"), F.sum("bout_frames").alias("bout_frames"), F.max("longest_bout").alias("longest_bout"))
    return report.withColumn("track", F.col("track").cast("string")).unionByName(every)


#: Lengths per second under which a body rests, bending per second from which it thrashes, curvature of a coil, and seconds of a reversal.
PAUSE, BENDING, COIL, REVERSAL = 0.04, 0.8, 12.0, 0.5


def motion_masks(frames: DataFrame, speed: str, bending: str, along: str, core: str) -> DataFrame:
    """frames with the masks moving, paused, thrashing, forward and backward. along: speed towards the head. What is unknown is false."""
    held = lambda c: F.coalesce(c, F.lit(False))
    on, v, b, a = held(F.col(core)), F.col(speed), F.col(bending), F.col(along)
    moving = on & held(v >= PAUSE)
    slow = on & held(v < PAUSE)
    return frames.withColumns({"moving": moving, "paused": slow & held(b < BENDING), "thrashing": slow & held(b >= BENDING), "forward": moving & held(a > PAUSE), "backward": moving & held(a < -PAUSE)})


def motion_shares(frames: DataFrame, keys: list[str], frame: str, core: str, fps: float) -> DataFrame:
    """Per key, from motion_masks: shares of core frames that move, pause and thrash, shares of moving frames that go forward and backward, and reversals
    (runs of backward frames of REVERSAL seconds) per minute of core frames."""
    n = F.count_if(F.col(core))
    moving = F.greatest(F.count_if("moving"), F.lit(1))
    parts = frames.groupBy(*keys).agg(n.alias("n_core"), *[F.try_divide(F.count_if(c), n).alias(f"frac_{a}") for c, a in (("moving", "move"), ("paused", "pause"), ("thrashing", "thrash"))], *[(F.count_if(c) / moving).alias(f"frac_{c}") for c in ("forward", "backward")])
    back = series.runs(frames, keys, frame, "backward", int(REVERSAL * fps)).groupBy(*keys).agg(F.count(F.lit(1)).alias("__r"))
    joined = parts.join(back, keys, "left")
    return joined.withColumn("rev_per_min", F.try_divide(F.coalesce("__r", F.lit(0)), F.col("n_core") / fps / 60)).drop("__r")


def curvature_shares(frames: DataFrame, keys: list[str], curvature: str, full: str, moving: str, fps: float) -> DataFrame:
    """Per key, over whole midlines: root mean square of the curvature in moving frames (in all where they are less than a second), the share of
    frames whose greatest curvature is a coil's, and the 90th percentile of that greatest one. curvature: arrays; null elements are left out."""
    f = frames.where(F.col(full)).withColumn("__k", F.filter(curvature, lambda x: x.isNotNull()))
    squares = lambda on: F.sum(F.when(on, F.aggregate("__k", F.lit(0.0), lambda t, x: t + x * x)))
    counts = lambda on: F.sum(F.when(on, F.size("__k")))
    move, every = F.coalesce(F.col(moving), F.lit(False)), F.lit(True)
    most = F.array_max(F.transform("__k", F.abs))
    enough = F.count_if(move) >= fps
    rms = F.sqrt(F.try_divide(F.when(enough, squares(move)).otherwise(squares(every)), F.when(enough, counts(move)).otherwise(counts(every))))
    return f.groupBy(*keys).agg(rms.alias("curv_rms"), (F.count_if(most > COIL) / F.count(F.lit(1))).alias("frac_coil"), relational.p90(most).alias("kmax_p90"))
