"""Sinks. Tables and documents are made and written by Spark, partitioned by video; nothing of a video passes the driver."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BODYPARTS = ("head", "q1", "mid", "q3", "tail")
PLACES = (0, 12, 24, 36, 48)


def write_pose(pose: DataFrame, path: str, mode: str = "error") -> None:
    """Label rows, coordinates as 32-bit floats, one folder per video, in frame order. mode 'ignore' writes a backup once only."""
    small = pose.withColumn("pts", F.transform("pts", lambda p: F.when(p.isNotNull(), F.struct(p["x"].cast("float").alias("x"), p["y"].cast("float").alias("y")))))
    small.repartition("video").sortWithinPartitions("video", "track", "frame").write.mode(mode).partitionBy("video").parquet(path)


def five_points(pose: DataFrame, flagged: Column) -> DataFrame:
    """Long rows of the five body parts with their likelihood."""
    rows = F.array(*[F.struct(F.lit(b).alias("bodypart"), F.get("pts", F.lit(i)).alias("p")) for b, i in zip(BODYPARTS, PLACES, strict=True)])
    r = pose.withColumn("__f", flagged).select("video", "frame", F.col("track").alias("individual"), "__f", F.explode(rows).alias("r"))
    return r.select("video", "frame", "individual", "r.bodypart", F.col("r.p.x").alias("x"), F.col("r.p.y").alias("y"), F.when(F.col("r.p").isNull(), 0.0).when(F.col("__f"), 0.5).otherwise(1.0).alias("likelihood"))


def wide_points(points: DataFrame, individuals: Sequence[str]) -> DataFrame:
    """One row per frame, one column per individual, body part and coordinate; the columns are known, so one pass pivots."""
    names = [f"{i}|{b}" for i in individuals for b in BODYPARTS]
    keyed = points.withColumn("__c", F.concat_ws("|", "individual", "bodypart"))
    return keyed.groupBy("video", "frame").pivot("__c", names).agg(F.first("x").alias("x"), F.first("y").alias("y"), F.first("likelihood").alias("likelihood"))


def header_rows(individuals: Sequence[str], scorer: str) -> list[list[str]]:
    """The header levels of the wide table: scorer, individuals (with more than one), body parts, coordinates."""
    columns = [(i, b, c) for i in individuals for b in BODYPARTS for c in ("x", "y", "likelihood")]
    rows = [["scorer", *[scorer] * len(columns)], ["individuals", *[c[0] for c in columns]], ["bodyparts", *[c[1] for c in columns]], ["coords", *[c[2] for c in columns]]]
    return rows if len(individuals) > 1 else [rows[0], *rows[2:]]


def csv_lines(wide: DataFrame, individuals: Sequence[str], scorer: str) -> DataFrame:
    """(video, at, line): the lines of each video's wide table, its header first; at orders them. Hidden values are empty."""
    columns = [f"{i}|{b}_{c}" for i in individuals for b in BODYPARTS for c in ("x", "y", "likelihood")]
    number = lambda c: F.coalesce(F.format_string("%.3f", F.col(f"`{c}`")), F.lit(""))
    empty = lambda c: F.when(F.col(f"`{c}`").isNull(), "").otherwise(number(c))
    rows = wide.select("video", F.col("frame").cast("long").alias("at"), F.concat_ws(",", F.col("frame").cast("string"), *map(empty, columns)).alias("line"))
    head = [",".join(r) for r in header_rows(individuals, scorer)]
    heads = F.explode(F.array(*[F.struct(F.lit(k - len(head)).cast("long").alias("at"), F.lit(x).alias("line")) for k, x in enumerate(head)])).alias("h")
    return rows.unionByName(wide.select("video").distinct().select("video", heads).select("video", "h.at", "h.line"))


def write_csv_lines(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One text file per video, in order."""
    lines.repartition("video").sortWithinPartitions("video", "at").select("video", "line").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("video").text(path)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def qc_rows(qc: DataFrame) -> DataFrame:
    """Quality rows with flags as a sorted, ';'-joined set."""
    return qc.withColumn("flags", F.array_join(F.array_sort(F.array_distinct("flags")), ";"))


def summary_json(summary: DataFrame, tracks: DataFrame) -> DataFrame:
    """(video, json): the summary row with its tracks in order."""
    nested = tracks.groupBy("video").agg(F.sort_array(F.collect_list(F.struct("first_frame", *[c for c in tracks.columns if c not in ("video", "first_frame")]))).alias("tracks"))
    joined = summary.drop("tracks").join(nested, "video", "left")
    return joined.select("video", F.to_json(F.struct(*[c for c in joined.columns if c != "video"])).alias("json"))


def episode_json(episodes: DataFrame, videos: DataFrame) -> DataFrame:
    """(video, json): the episode document of each video of videos, with that one's other columns as its head and its episodes in order."""
    named = [c for c in episodes.columns if c not in ("video", "start")]
    nested = episodes.groupBy("video").agg(F.sort_array(F.collect_list(F.struct("start", *named))).alias("episodes"))
    joined = videos.join(nested, "video", "left")
    listed = F.coalesce("episodes", F.array().cast(joined.schema["episodes"].dataType)).alias("episodes")
    return joined.select("video", F.to_json(F.struct(F.lit(2).alias("format"), *videos.columns, listed)).alias("json"))


def project_yaml(settings: dict) -> str:
    """A flat project document: scalars, lists and one level of maps."""

    def value(v) -> str:
        return json.dumps(v) if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else "" if v is None else str(v)

    out: list[str] = []
    for k, v in settings.items():
        if isinstance(v, dict):
            out += [f"{k}:", *[f"  {json.dumps(str(a))}: {value(b)}" for a, b in v.items()]]
        elif isinstance(v, (list, tuple)):
            out += [f"{k}:", *["- " + (", ".join(map(value, x)).join("[]") if isinstance(x, (list, tuple)) else value(x)) for x in v]]
        else:
            out.append(f"{k}: {value(v)}")
    return "\n".join(out) + "\n"


def extend_project(old: dict | None, new: dict) -> dict:
    """old with new's videos; body parts and the number of animals must agree."""
    if old is None:
        return new
    for key in ("bodyparts", "multianimalproject", "scorer"):
        if old.get(key) != new.get(key):
            raise ValueError(f"the projects differ in {key}: {old.get(key)!r} and {new.get(key)!r}")
    return {**old, "video_sets": {**old.get("video_sets", {}), **new.get("video_sets", {})}}
