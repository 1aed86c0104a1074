"""The source of label tensors: ranges, filters, shapes and broken files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.sources import label_source, readers


@pytest.fixture()
def root(tmp_path):
    rng = np.random.default_rng(1)
    for v, shape in (("a", (1300, 49, 2)), ("b", (40, 2, 49, 2)), ("c", (0, 49, 2))):
        (tmp_path / v).mkdir()
        x = rng.random(shape).astype(np.float32)
        x[1:2, ..., 45:, :] = np.nan
        x[2:3] = np.nan
        np.save(tmp_path / v / "labels49.npy", x)
    (tmp_path / "b" / "other.npy").write_bytes(b"")
    return str(tmp_path)


@pytest.fixture()
def source(spark, root):
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    yield lambda n=100: label_source.label_tensors(spark, root, frames_per_task=n)
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def rows(frame):
    return sorted((r["video"], r["track"], r["frame"], tuple(r["pts"])) for r in frame.collect())


def test_ranges_give_what_whole_files_give(spark, root, source):
    assert rows(source()) == rows(readers.read_labels(spark, root)) and source().rdd.getNumPartitions() == 14
    assert rows(source(7)) == rows(source(10_000))


def test_filters_choose_files_and_ranges(source):
    some = source().where("video = 'a' AND frame >= 250 AND frame < 310")
    assert some.rdd.getNumPartitions() == 1 and some.count() == 60
    assert source().where("video IN ('b', 'c') AND frame > 37").rdd.getNumPartitions() == 1
    assert source().where("frame = 1 AND video = 'b'").count() == 2
    assert source().where("frame > 2000").count() == 0
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "250" not in plan and "310" not in plan  # the source took the ranges over; no filter repeats them
    kept = source().where((F.col("frame") % 2 == 0) & (F.col("video") == "b"))
    assert kept.count() == 38  # frame 2 is empty; what cannot be pushed is still evaluated


def test_filters_without_pushdown(spark, root):
    frame = label_source.label_tensors(spark, root, frames_per_task=100).where("video = 'a' AND frame >= 250 AND frame < 310")
    assert frame.rdd.getNumPartitions() == 14 and frame.count() == 60


def test_written_tensors_come_back(spark, tmp_path):
    poses = spark.createDataFrame([("a", 0, 0, [(1.0, 2.0), None]), ("a", 1, 4, [(0.5, 0.25), (3.0, 4.0)]), ("b", 0, 1, [(7.0, 8.0), (9.0, 10.0)])], "video string, track int, frame int, pts array<struct<x:double,y:double>>")
    done = label_source.write_label_tensors(poses, str(tmp_path / "out"), 2).collect()
    assert sorted(map(tuple, done)) == [("a", 5, 2), ("b", 2, 1)]
    label_source.register(spark)
    got = spark.read.format("label_tensor").load(f"file://{tmp_path}/out")
    assert rows(got) == rows(poses.withColumn("track", F.col("track").cast("string")))


@pytest.mark.parametrize("content", [b"no tensor at all", None])
def test_broken_tensors_are_errors(spark, tmp_path, content):
    (tmp_path / "v").mkdir()
    path = tmp_path / "v" / "labels49.npy"
    path.write_bytes(content) if content else np.save(path, np.zeros((3, 3)))
    label_source.register(spark)
    with pytest.raises(Exception, match="npy|shape"):
        spark.read.format("label_tensor").load(str(tmp_path)).count()
