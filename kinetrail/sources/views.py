"""Views of the driver's tables as tracks, midlines, detections, labels and quality rows, and their DuckDB twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geometry import points


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return track_points(table(spark, sf_dir, "events"))


def track_points(e: DataFrame) -> DataFrame:
    """One track per user on a dense frame spine with a centroid; five videos."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(
        F.col("user_id").alias("track"),
        (F.col("user_id") % 5).cast("int").alias("video"),
        (F.row_number().over(w) - 1).alias("frame"),
        F.col("value").alias("cx"),
        F.get_json_object("props", "$.k").cast("double").alias("cy"),
        (F.floor("value").cast("int") % 3 != 0).alias("core"),
    )


def mid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A 32-point midline per vector, as points and flat."""
    m = F.transform("embedding", lambda e: e.cast("double"))
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").alias("track"), F.floor(F.col("vec_id") / 10).cast("int").alias("frame"), m.alias("m")).withColumn("pts", points(F.col("m")))


def det(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mid(spark, sf_dir).select(F.col("vec_id").alias("det_id"), "track", "frame", "m", "pts", F.when(F.col("vec_id") % 2 == 0, "ft").otherwise("base").alias("model"), ((F.col("vec_id") % 97) / 97.0).alias("score"))


def lab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mid(spark, sf_dir).where("vec_id % 3 <> 0").groupBy("track", "frame").agg(F.max_by("pts", "vec_id").alias("pts"), F.max("vec_id").alias("vec_id"))


def qc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pts(spark, sf_dir)
    flags = F.concat_ws(";", F.when(F.col("cx") > 100, "cluster"), F.when(F.col("cy") < 10, "from_cluster"), F.when(F.col("cx") < 1, "no_worm"), F.when(F.col("frame") % 11 == 0, "touches_border"))
    return p.select("track", "video", "frame", flags.alias("flags"), F.when(F.col("cx") < 1, "no_worm").when(F.col("cy") < 10, "head_cut").otherwise("full").alias("label_status"))


PTS = """pts AS (SELECT user_id AS track, CAST(user_id % 5 AS INTEGER) AS video, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS frame,
  value AS cx, CAST(json_extract(props, '$.k') AS DOUBLE) AS cy, CAST(floor(value) AS INTEGER) % 3 <> 0 AS core FROM events)"""
MID = """mid AS (SELECT vec_id, label AS track, CAST(vec_id // 10 AS INTEGER) AS frame, embedding::DOUBLE[] AS m FROM embeddings),
mp AS (SELECT vec_id, track, frame, CAST(i AS INTEGER) AS i, m[2 * i + 1] AS x, m[2 * i + 2] AS y FROM (SELECT *, unnest(range(0, len(m) // 2)) AS i FROM mid))"""
DET = MID + """, det AS (SELECT vec_id AS det_id, track, frame, m, CASE WHEN vec_id % 2 = 0 THEN 'ft' ELSE 'base' END AS model, (vec_id % 97) / 97.0 AS score FROM mid)"""
LAB = DET + """, lab AS (SELECT track, frame, max(vec_id) AS vec_id FROM mid WHERE vec_id % 3 <> 0 GROUP BY track, frame)"""
QC = PTS + """, qc AS (SELECT track, video, frame, concat_ws(';', CASE WHEN cx > 100 THEN 'cluster' END, CASE WHEN cy < 10 THEN 'from_cluster' END, CASE WHEN cx < 1 THEN 'no_worm' END, CASE WHEN frame % 11 = 0 THEN 'touches_border' END) AS flags,
  CASE WHEN cx < 1 THEN 'no_worm' WHEN cy < 10 THEN 'head_cut' ELSE 'full' END AS label_status FROM pts)"""
