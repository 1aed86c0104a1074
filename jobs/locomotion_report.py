"""Locomotion report of all tracks and videos.

    python jobs/locomotion_report.py --input DIR/events.parquet --output OUT [--videos 0 3] [--config FILE] [--master M]

Reads track points, smooths their speeds and writes one row per track and one row ALL per video, partitioned by video. Only
the partitions of the videos that were asked for are replaced, so a run can be repeated, or repeated for some videos.
"""

from __future__ import annotations

import argparse
import logging
import sys
from collections.abc import Sequence
from pathlib import Path

if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.settings import counted, load
from kinetrail.operators import locomotion
from kinetrail.sources.views import track_points

CONFIG = Path(__file__).with_suffix(".json")
SCHEMA = "track string, core_s double, speed double, frac_move double, frac_pause double, bouts long, bout_frames long, longest_bout long, video int"
log = logging.getLogger("jobs.locomotion_report")


def run(spark: SparkSession, source: str, output: str, config: dict, videos: Sequence[int] | None = None) -> DataFrame:
    """Writes the report of the videos (all where None) and returns the whole output as it stands then."""
    seen, wrote = Observation("read"), Observation("wrote")
    frames = track_points(spark.read.parquet(source))
    if videos:
        frames = frames.where(F.col("video").isin(list(videos)))
    frames = frames.observe(seen, F.count(F.lit(1)).alias("rows"))
    speeds = locomotion.smoothed_speed(frames, config["fps"], config["body_length"], config["fill_gap"], config["median_frames"])
    tracks = locomotion.track_report(speeds, config["fps"], config["moving_above"], config["bridge_frames"], config["least_bout"])
    report = locomotion.with_videos(tracks).observe(wrote, F.count(F.lit(1)).alias("rows"), F.count_if(F.col("track") == "ALL").alias("videos"))
    report = report.repartition("video").sortWithinPartitions("video", "track")
    report.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("video").parquet(output)
    log.info("read %s points of %s", counted(seen), source)
    log.info("wrote %s rows of %s videos to %s", counted(wrote), counted(wrote, "videos"), output)
    return spark.read.schema(SCHEMA).parquet(output)


def main(argv: Sequence[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    p.add_argument("--input", required=True, help="Parquet table of events")
    p.add_argument("--output", required=True, help="folder of the report")
    p.add_argument("--videos", type=int, nargs="*", help="videos to report; all where left out")
    p.add_argument("--config", default=str(CONFIG))
    p.add_argument("--master", help="Spark master, where the launcher sets none")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    builder = SparkSession.builder.appName("locomotion-report").config("spark.sql.session.timeZone", "UTC")
    spark = (builder.master(a.master) if a.master else builder).getOrCreate()
    try:
        run(spark, a.input, a.output, load(a.config, CONFIG), a.videos)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
