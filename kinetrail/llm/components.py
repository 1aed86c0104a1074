"""Connected components of a distributed edge list by alternating large-star and small-star steps.

Every step is a minimum per node (pre-aggregated) and a join, so a node with a third of all edges needs no list of its
neighbours anywhere. An edge with a null end joins nothing and is left out; repeated edges and loops count once or not at all. After each round the edges are written to the shared folder and read back, which cuts the lineage and
lets a lost executor's work be redone from there.
"""

from __future__ import annotations

from collections.abc import Iterable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir


@contextmanager
def shuffles_removed(spark: SparkSession):
    """Within it, the shuffle files of a query go when the query is done; else they stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def written(frames: DataFrame | Iterable[DataFrame], name: str) -> DataFrame:
    """frame, written to the shared folder once and read from there. What was shuffled for it goes then, so that only one step's shuffles lie on disk.
    Of several frames, which are made and written one after another, the union."""
    folder = None
    for frame in [frames] if isinstance(frames, DataFrame) else frames:
        folder = folder or shared_dir(frame.sparkSession, name)
        with shuffles_removed(frame.sparkSession):
            frame.write.mode("append").parquet(folder)
    return frame.sparkSession.read.parquet(folder)


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (u, v), root being the least node of its component. Nodes are their own roots' members."""
    edges = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    before = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        edges = written(small, "edges")
        state = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
