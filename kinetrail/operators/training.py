"""Selection of training data from labels, synthetic crossings of midlines, and the tables behind figures and label files. Pixels stay outside."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g
from .relational import cap_per_group, median
from .series import by

#: Lengths that a label may have relative to the video's median, to its own track's, and at least; the share of a component near its midline.
GATE_VIDEO, GATE_TRACK, GATE_LEAST, COVERED = (0.75, 1.25), (0.8, 1.2), 0.35, 0.92


def centres(labels: DataFrame, videos: DataFrame, half: int, skip: int, step: int) -> DataFrame:
    """(video, track, frame) of every step-th frame, from half on and half before the end, whose track is labelled there and skip frames before and after.
    labels: video, track, frame (whole labels); videos: video, n_frames. Every label supports three centres; no row looks for others."""
    f = F.col("frame")
    support = labels.select("video", "track", F.explode(F.array(f - skip, f, f + skip)).alias("frame"))
    held = support.groupBy("video", "track", "frame").agg(F.count(F.lit(1)).alias("n")).where("n = 3").drop("n").join(videos.select("video", "n_frames"), "video")
    return held.where((f >= half) & (f < F.col("n_frames") - half) & ((f - half) % step == 0)).drop("n_frames")


def gated(found: DataFrame, labels: DataFrame, videos: DataFrame, mode: str = "video") -> DataFrame:
    """Centres in whose frame no whole label has a doubtful length (or, where `covered` is known, leaves much of its component uncovered).
    labels: video, track, frame, length [, covered]; videos: video, median_length. mode track compares with the median of the label's own track."""
    rows = labels.join(videos.select("video", "median_length"), "video")
    n = F.col("length")
    if mode == "track":
        own = labels.groupBy("video", "track").agg(median("length").alias("own"))
        rows = rows.join(own, ["video", "track"])
        ok = n.between(GATE_TRACK[0] * F.col("own"), GATE_TRACK[1] * F.col("own")) & (n >= GATE_LEAST * F.col("median_length"))
    elif mode == "video":
        ok = n.between(GATE_VIDEO[0] * F.col("median_length"), GATE_VIDEO[1] * F.col("median_length"))
    else:
        raise ValueError(f"mode is video or track, not {mode}")
    if "covered" in labels.columns:
        ok = ok & F.coalesce(F.col("covered") >= COVERED, F.lit(True))
    bad = rows.where(~F.coalesce(ok, F.lit(False))).select("video", "frame").distinct()
    return found.join(bad, ["video", "frame"], "left_anti")


def samples(found: DataFrame, labels: DataFrame, skip: int, per_video: int, slots: int, seed: int = 0) -> DataFrame:
    """(video, track, frame, slot, other, pts): for at most per_video centres of each video, chosen by a hash of track and frame, the labels at the centre's frame and
    skip frames around it of its own track (slot 0) and of the others that have all three, nearest first. pts: three midlines."""
    picked = cap_per_group(found.withColumn("__id", F.col("frame") * 1000 + F.col("track")), ["video"], "__id", per_video, seed).drop("__id")
    around = labels.select("video", F.col("track").alias("other"), "frame", F.struct("frame", "pts").alias("p"))
    f = F.col("frame")
    shifted = around.select("video", "other", F.explode(F.array(f - skip, f, f + skip)).alias("frame"), "p")
    three = shifted.groupBy("video", "other", "frame").agg(F.sort_array(F.collect_list("p")).alias("ps")).where(F.size("ps") == 3)
    rows = picked.join(three, ["video", "frame"])
    centre = rows.withColumn("c", g.centroid(F.col("ps")[1]["pts"]))
    own = centre.where("other = track").select("video", "track", "frame", F.col("c").alias("mine"))
    far = g.dist(F.col("c"), F.col("mine"))
    ranked = centre.join(own, ["video", "track", "frame"]).withColumn("slot", F.row_number().over(by(["video", "track", "frame"], (F.col("other") != F.col("track")), far, "other")) - 1)
    return ranked.where(F.col("slot") < slots).select("video", "track", "frame", "slot", "other", F.transform("ps", lambda p: p["pts"]).alias("pts"))


def crossed(base: Column, donor: Column, at: Column, donor_at: Column, angle: Column, offset: Column, reach: int = 2) -> Column:
    """donor, turned and moved so that its point donor_at lies `offset` to the left of base's point `at`, and its direction there is base's turned by angle (radians)."""

    def direction(p: Column, i: Column) -> Column:
        a, b = F.get(p, F.greatest(i - reach, F.lit(0))), F.get(p, F.least(i + reach, F.size(p) - 1))
        return F.atan2(b["y"] - a["y"], b["x"] - a["x"])

    def place(s: Column) -> Column:
        way = direction(s["base"], s["at"])
        turn = way + s["angle"] - direction(s["donor"], s["donor_at"])
        p, q = F.get(s["base"], s["at"]), F.get(s["donor"], s["donor_at"])
        x, y = p["x"] - F.sin(way) * s["offset"], p["y"] + F.cos(way) * s["offset"]
        values = F.struct(F.cos(turn).alias("c"), F.sin(turn).alias("s"), x.alias("x"), y.alias("y"), q["x"].alias("qx"), q["y"].alias("qy"))
        return g.let(values, lambda v: F.transform(s["donor"], lambda d: F.struct((v["x"] + v["c"] * (d["x"] - v["qx"]) - v["s"] * (d["y"] - v["qy"])).alias("x"), (v["y"] + v["s"] * (d["x"] - v["qx"]) + v["c"] * (d["y"] - v["qy"])).alias("y"))))

    return g.let(F.struct(base.alias("base"), donor.alias("donor"), at.cast("int").alias("at"), donor_at.cast("int").alias("donor_at"), angle.alias("angle"), offset.alias("offset")), place)


def collected_rows(points: DataFrame, individuals: Sequence[str], bodyparts: Sequence[str], digits: int = 5) -> DataFrame:
    """One row per labelled frame of a label file: folder, video, image name, and x and y of each individual's body parts; hidden ones are null.
    points: video, frame, individual, bodypart, x, y; the columns are known, so one pass pivots."""
    names = [f"{i}|{b}" for i in individuals for b in bodyparts]
    keyed = points.withColumn("__c", F.concat_ws("|", "individual", "bodypart")).where(F.col("__c").isin(names))
    wide = keyed.groupBy("video", "frame").pivot("__c", names).agg(F.first("x", True).alias("x"), F.first("y", True).alias("y"))
    image = F.concat(F.lit("img"), F.lpad(F.col("frame").cast("string"), digits, "0"), F.lit(".png"))
    return wide.select(F.lit("labeled-data").alias("folder"), "video", image.alias("image"), *[F.col(f"`{c}_{k}`") for c in names for k in ("x", "y")])


def feature_points(tracks: DataFrame, videos: DataFrame, features: Sequence[str]) -> DataFrame:
    """The dots of a figure of features by video: (feature, video, kind, value) of every track and of each video's mean."""
    sides = [df.unpivot(["video"], list(features), "feature", "value").withColumn("kind", F.lit(kind)) for df, kind in ((tracks, "track"), (videos, "video"))]
    return sides[0].unionByName(sides[1]).where(F.col("value").isNotNull() & ~F.isnan("value"))


def map_labels(points: DataFrame, group: str, x: str, y: str) -> DataFrame:
    """Where a group's name stands on a map of points: the medians of its coordinates, and how many points it has."""
    return points.groupBy(group).agg(median(x).alias(x), median(y).alias(y), F.count(F.lit(1)).alias("n"))
