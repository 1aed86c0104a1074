"""Sources: label tensors, summaries, tables, result archives and frames.

Files are found and read by Spark (`binaryFile` for what Spark has no format of), so any store that Spark reaches works;
the video is the name of the folder that holds the file.
"""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.geometry import evenly
from .label_source import STEP, LabelReader

VIDEO_SUFFIXES = ("mp4", "mov", "avi", "mkv", "m4v")


def video_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), "[.][^.]*$", "")


def files(spark: SparkSession, root: str, pattern: str, videos: Sequence[str] | None = None) -> DataFrame:
    """path, modificationTime, length, content, video of the files with that name in the folders of root (all, or the listed ones)."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    df = df.withColumn("video", video_of(F.col("path")))
    return df.where(F.col("video").isin(list(videos))) if videos else df


def list_videos(spark: SparkSession, folder: str, suffixes: Sequence[str] = VIDEO_SUFFIXES) -> DataFrame:
    """path, video of the video files of a folder, in order; contents are not read."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.{" + ",".join([*suffixes, *map(str.upper, suffixes)]) + "}").load(folder)
    return df.select("path", stem(F.col("path")).alias("video")).orderBy("path")


def read_labels(spark: SparkSession, root: str, name: str = "labels49.npy", videos: Sequence[str] | None = None) -> DataFrame:
    """Pose rows from label tensors (frames, points, 2) or (frames, tracks, points, 2); NaN points are null, and rows without any point are left out. A file is read whole by one task (2 GB at most); label_source reads larger ones by ranges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for video, content in zip(batch.column("video").to_pylist(), batch.column("content").to_pylist(), strict=True):
                a = np.load(io.BytesIO(content), allow_pickle=False)
                a = a[:, None] if a.ndim == 3 else a
                for start in range(0, len(a), STEP):
                    yield LabelReader.rows(video, start, a[start : start + STEP].astype(float))

    return files(spark, root, name, videos).select("video", "content").mapInArrow(run, "video string, track string, frame int, pts array<struct<x:double,y:double>>")


def read_summaries(spark: SparkSession, root: str, videos: Sequence[str] | None = None) -> DataFrame:
    """One row per summary.json."""
    df = spark.read.schema(schemas.SUMMARY).option("multiLine", True).option("pathGlobFilter", "summary.json").option("recursiveFileLookup", "true").json(root)
    df = df.withColumn("video", video_of(F.col("_metadata.file_path")))
    return df.where(F.col("video").isin(list(videos))) if videos else df


def read_tracks(spark: SparkSession, root: str) -> DataFrame:
    """The tracks of all summaries, one row each."""
    return read_summaries(spark, root).select("video", F.explode("tracks").alias("t")).select("video", "t.*")


def read_table(spark: SparkSession, paths: str | Sequence[str], schema=None, exclude: str | None = None) -> DataFrame:
    """CSV files with a header, together, without those whose names contain `exclude`."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").option("nullValue", "")
    df = (reader.schema(schema) if schema is not None else reader.option("inferSchema", True)).csv(paths)
    if exclude:
        df = df.where(~F.contains(F.element_at(F.split("_metadata.file_path", "/"), -1), F.lit(exclude)))
    return df


def read_qc(spark: SparkSession, root: str) -> DataFrame:
    """qc_frames.csv of all videos; only columns are typed here; flags stay ';'-joined."""
    df = spark.read.option("header", True).option("recursiveFileLookup", "true").option("pathGlobFilter", "qc_frames.csv").schema(schemas.QC_COLUMNS).csv(root)
    return df.withColumn("video", video_of(F.col("_metadata.file_path"))).fillna("", ["flags"])


def read_results(spark: SparkSession, root: str, pattern: str = "*.zip") -> DataFrame:
    """Rows of result archives: `result.json` names the video, `labels_sam2.npz` holds the columns. Formats 1 and 2 are known."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    head = json.loads(z.read("result.json"))
                    if head.get("format", 1) not in (1, 2):
                        raise ValueError(f"unknown result format {head['format']}")
                    with np.load(io.BytesIO(z.read("labels_sam2.npz")), allow_pickle=False) as n:
                        mid = n["midline"].astype(float)
                        flat = [[None if v != v else v for v in row] for row in mid.reshape(len(mid), -1).tolist()]
                        arrays = [pa.array([head["video"]] * len(mid)), *(pa.array(n[c].astype(np.int32)) for c in ("frame", "track", "obj", "episode")), pa.array(flat, pa.list_(pa.float64())), pa.array(n["area"].astype(float)), pa.array(n["plausible"].astype(bool))]
                yield pa.RecordBatch.from_arrays(arrays, ["video", "frame", "track", "obj", "episode", "midline", "area", "plausible"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(root)
    return raw.select("content").mapInArrow(run, "video string, frame int, track int, obj int, episode int, midline array<double>, area double, plausible boolean")


def read_episodes(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """episodes.json, one row per episode."""
    df = spark.read.schema(schemas.EPISODES).option("multiLine", True).json(paths)
    return df.select("video", "fps", "n_frames", F.explode("episodes").alias("e")).select("video", "fps", "n_frames", "e.*")


def strided(frames: DataFrame, stride: int, frame: str = "frame") -> DataFrame:
    """Every stride-th frame, with its place among those taken."""
    return frames.where(F.pmod(F.col(frame), F.lit(stride)) == 0).withColumn("local", (F.col(frame) / stride).cast("int"))


def decoded_at(frame: Column, stride: int) -> Column:
    """The decoded frame at or before a frame."""
    return (F.floor(frame / stride) * stride).cast("int")


def training_frames(index: DataFrame, clean: int = 40, cluster: int = 60, least: int = 3, context: int = 2) -> DataFrame:
    """Frames to extract per video: evenly spaced clean ones, evenly spaced ones of each cluster episode, and context around its ends; cluster wins over context, context over clean. index: video, frame, kind, episode."""
    from ..operators.series import by

    clean_rows = _even(index.where("kind = 'clean'"), ["video"], F.lit(clean)).withColumn("rank", F.lit(2))
    episodes = index.where("kind = 'cluster'").groupBy("video", "episode").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    n = episodes.groupBy("video").agg(F.greatest(F.lit(least), F.floor(F.lit(cluster) / F.count(F.lit(1)))).alias("per"))
    cluster_rows = _even(index.where("kind = 'cluster'").join(n, "video"), ["video", "episode"], F.col("per")).drop("per").withColumn("rank", F.lit(0))
    around = F.array(*[F.col("a") - k for k in range(1, context + 1)], *[F.col("b") + k for k in range(1, context + 1)])
    context_rows = episodes.select("video", F.explode(around).alias("frame"), F.lit("context").alias("kind"), "episode", F.lit(1).alias("rank")).where("frame >= 0")
    every = clean_rows.unionByName(cluster_rows).unionByName(context_rows)
    w = by(["video", "frame"], "rank", "episode")
    return every.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k", "rank")


def _even(df: DataFrame, keys: list[str], k: Column) -> DataFrame:
    w = Window.partitionBy(*keys)
    d = df.withColumns({"__i": F.row_number().over(w.orderBy("frame")) - 1, "__n": F.count(F.lit(1)).over(w).cast("int")})
    return d.where(F.array_contains(evenly(F.col("__n"), k.cast("int")), F.col("__i"))).drop("__i", "__n")
