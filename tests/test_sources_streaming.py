import json
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.operators import pixels, series
from kinetrail.sources import readers, writers
from kinetrail.streaming import twins


@pytest.fixture()
def jobs(tmp_path):
    """Two videos as a batch job leaves them."""
    rng = np.random.default_rng(1)
    for v, shape in (("a", (6, 49, 2)), ("b", (4, 2, 49, 2))):
        d = tmp_path / "auto" / v
        d.mkdir(parents=True)
        x = rng.random(shape).astype(np.float32)
        x[1, ..., 45:, :] = np.nan
        x[2] = np.nan
        np.save(d / "labels49.npy", x)
        (d / "summary.json").write_text(json.dumps({"n_frames": shape[0], "fps": 20.0, "flag_counts": {"split": 2}, "tracks": [{"id": "t0", "n_frames": 4, "body_length_px": 500.0}]}, indent=1))
        (d / "qc_frames.csv").write_text("frame,flags,n_comp,n_worms,area,length_px,touches_border,label_status\n0,split;cluster,1,1,1500,500.0,True,full\n1,,0,0,0,,False,-\n")
    return str(tmp_path / "auto")


def test_labels(spark, jobs):
    r = readers.read_labels(spark, jobs)
    rows = {(x["video"], x["track"], x["frame"]): x["pts"] for x in r.collect()}
    assert {k[:2] for k in rows} == {("a", "0"), ("b", "0"), ("b", "1")} and ("a", "0", 2) not in rows
    assert rows["a", "0", 1][44] is not None and rows["a", "0", 1][45] is None
    assert readers.read_labels(spark, jobs, videos=["b"]).select("video").distinct().count() == 1


def test_summaries_and_tables(spark, jobs):
    s = readers.read_summaries(spark, jobs).where("video = 'a'").first()
    assert s["n_frames"] == 6 and s["flag_counts"] == {"split": 2}
    assert readers.read_tracks(spark, jobs).count() == 2
    qc = readers.read_qc(spark, jobs)
    assert {r["flags"] for r in qc.collect()} == {"split;cluster", ""} and qc.count() == 4


def test_result_archive(spark, tmp_path):
    path = tmp_path / "r.zip"
    np.savez(tmp_path / "labels_sam2.npz", frame=np.arange(3), track=np.array([0, 0, -1]), obj=np.ones(3), episode=np.zeros(3), midline=np.full((3, 49, 2), 2.0, np.float32), area=np.ones(3), plausible=np.array([True, False, True]))
    with zipfile.ZipFile(path, "w") as z:
        z.write(tmp_path / "labels_sam2.npz", "labels_sam2.npz")
        z.writestr("result.json", json.dumps({"video": "a", "format": 2}))
    rows = readers.read_results(spark, str(tmp_path)).collect()
    assert [(r["track"], r["plausible"], len(r["midline"])) for r in rows] == [(0, True, 98), (0, False, 98), (-1, True, 98)]


def test_five_points_and_wide_table(spark, jobs, tmp_path):
    pose = readers.read_labels(spark, jobs, videos=["b"])
    points = writers.five_points(pose, F.lit(False))
    assert points.where("bodypart = 'tail' and frame = 1").first()["likelihood"] == 0.0
    wide = writers.wide_points(points, ["0", "1"])
    table = writers.csv_lines(wide, ["0", "1"], "me")
    lines = [r["line"] for r in table.orderBy("at").collect()]
    assert len(lines) == 4 + 3 and len(lines[0].split(",")) == 1 + 2 * 5 * 3 == len(lines[-1].split(","))
    assert [x.split(",")[0] for x in lines[:4]] == ["scorer", "individuals", "bodyparts", "coords"] and lines[4].startswith("0,")
    writers.write_csv_lines(table, str(tmp_path / "wide"))
    (file,) = (tmp_path / "wide" / "video=b").glob("part-*.txt")
    assert file.read_text().splitlines() == lines


def test_pose_round_trip_and_backup(spark, jobs, tmp_path):
    pose = readers.read_labels(spark, jobs)
    path = str(tmp_path / "pose")
    writers.write_pose(pose, path)
    writers.write_pose(pose.limit(0), path, mode="ignore")
    assert spark.read.parquet(path).count() == pose.count()


def test_documents_of_videos(spark):
    episodes = spark.createDataFrame([("a", 7, 9, 2), ("a", 1, 3, 1)], "video string, start int, end int, id int")
    videos = spark.createDataFrame([("a", 20.0), ("b", 25.0)], "video string, fps double")
    got = {r["video"]: json.loads(r["json"]) for r in writers.episode_json(episodes, videos).collect()}
    assert got["a"] == {"format": 2, "video": "a", "fps": 20.0, "episodes": [{"start": 1, "end": 3, "id": 1}, {"start": 7, "end": 9, "id": 2}]} and got["b"]["episodes"] == []
    tracks = spark.createDataFrame([("a", "t1", 5), ("a", "t0", 2)], "video string, id string, first_frame int")
    summary = spark.createDataFrame([("a", 9), ("b", 3)], "video string, n_frames int")
    got = {r["video"]: json.loads(r["json"]) for r in writers.summary_json(summary, tracks).collect()}
    assert [t["id"] for t in got["a"]["tracks"]] == ["t0", "t1"] and got["b"] == {"n_frames": 3}
    qc = writers.qc_rows(spark.createDataFrame([("a", ["split", "cluster", "split"]), ("a", [])], "video string, flags array<string>"))
    assert [r["flags"] for r in qc.collect()] == ["cluster;split", ""]


def test_videos_and_tables_of_a_folder(spark, tmp_path):
    for name in ("b.MP4", "a.mov", "notes.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r["video"] for r in readers.list_videos(spark, str(tmp_path)).collect()] == ["a", "b"]
    out = tmp_path / "tables"
    writers.write_table(spark.createDataFrame([(1, "x"), (2, None)], "k int, v string").coalesce(1), str(out))
    back = readers.read_table(spark, str(out), "k int, v string")
    assert sorted(map(tuple, back.collect()), key=str) == [(1, "x"), (2, None)]
    (tmp_path / "more").mkdir()
    for name in ("kept.csv", "old_draft.csv"):
        (tmp_path / "more" / name).write_text("k\n1\n")
    assert readers.read_table(spark, str(tmp_path / "more")).count() == 2 and readers.read_table(spark, str(tmp_path / "more"), exclude="draft").count() == 1


def test_project_documents():
    old = {"bodyparts": ["a"], "scorer": "s", "multianimalproject": True, "video_sets": {"x.mp4": "0, 1"}}
    new = {**old, "video_sets": {"y.mp4": "0, 1"}}
    assert set(writers.extend_project(old, new)["video_sets"]) == {"x.mp4", "y.mp4"}
    with pytest.raises(ValueError, match="bodyparts"):
        writers.extend_project(old, {**new, "bodyparts": ["b"]})
    assert '"x.mp4"' in writers.project_yaml(old)


def test_training_frames(spark):
    rows = [("v", f, "clean", -1) for f in range(100)] + [("v", f, "cluster", 0) for f in range(100, 130)]
    out = readers.training_frames(spark.createDataFrame(rows, "video string, frame int, kind string, episode int"), clean=10, cluster=12).collect()
    by = {k: sorted(r["frame"] for r in out if r["kind"] == k) for k in ("clean", "cluster", "context")}
    assert len(by["clean"]) == 9 + (99 not in by["context"]) and by["cluster"][0] == 100 and by["cluster"][-1] == 129 and len(by["cluster"]) == 12
    assert by["context"] == [98, 99, 130, 131]


def test_components(spark):
    gray = np.full((60, 80), 200, np.uint8)
    gray[10:40, 10:40] = 20
    gray[45:59, 5:75] = 30
    df = spark.createDataFrame([("v", 0, 80, 60, bytearray(gray.tobytes())), ("v", 1, 80, 60, bytearray(b"bad"))], "video string, frame int, width int, height int, gray binary")
    out = pixels.components(df).orderBy("comp_id").collect()
    assert [(r["frame"], r["area"], r["touches_border"]) for r in out] == [(0, 980, True), (0, 900, False)]
    labels, n = pixels.label(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 0], [1, 1, 0]], bool))
    assert n == 2 and labels[0, 0] == labels[0, 2] == labels[1, 1] != labels[3, 0]


def run(frame, name, path):
    q = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", path).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return frame.sparkSession.table(name)


def frames(spark, tmp_path):
    df = spark.range(100).select(F.lit("v").alias("video"), F.col("id").cast("int").alias("frame"), (F.col("id") * 1.5).alias("cx"), F.lit(5.0).alias("cy"), F.lit(0).alias("comp_id"))
    end = df.where("frame = 99").withColumn("frame", F.lit(5000))
    df.unionByName(end).coalesce(1).write.parquet(f"{tmp_path}/in")
    return spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), df


def test_streaming_hop_windows_equal_the_batch(spark, tmp_path):
    stream, batch = frames(spark, tmp_path)
    out = twins.hop_windows(twins.event_time(stream, "frame", 10.0), ["video"], "ts", 2.0, 1.0, "0 seconds", [F.count(F.lit(1)).alias("n"), F.sum("cx").alias("s")])
    got = {r["t0_s"]: (r["n"], r["s"]) for r in run(out, "hops", f"{tmp_path}/c1").collect() if r["n"] == 20}
    want = series.hop_windows(batch, ["video"], "frame", 20, 10).groupBy("t0").agg(F.count(F.lit(1)).alias("n"), F.sum("cx").alias("s")).collect()
    assert got == {r["t0"] / 10: (r["n"], r["s"]) for r in want}


def test_streaming_sessions(spark, tmp_path):
    stream, _ = frames(spark, tmp_path)
    kept = stream.where("frame < 30 or frame between 50 and 60 or frame = 5000")
    out = twins.sessions(twins.event_time(kept, "frame", 10.0), ["video"], "ts", 0.5, "0 seconds", [F.count(F.lit(1)).alias("n")])
    assert sorted((r["start_s"], r["n"]) for r in run(out, "runs", f"{tmp_path}/c2").collect()) == [(0.0, 30), (5.0, 11)]


def test_streaming_tracker(spark, tmp_path):
    stream, _ = frames(spark, tmp_path)
    rows = run(twins.track(stream), "tracks", f"{tmp_path}/c3").collect()
    assert {r["track_id"] for r in rows if r["frame"] < 100} == {0} and {r["track_id"] for r in rows if r["frame"] == 5000} == {1}
