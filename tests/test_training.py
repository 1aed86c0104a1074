"""Selection of training data against loops, and crossings against rotation matrices."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.operators import training

PTS = "array<struct<x:double,y:double>>"


def test_centres_and_gates_against_the_loop(spark):
    r = random.Random(1)
    rows = [(v, t, f, r.uniform(60, 140) if r.random() < 0.05 else 100.0, r.choice([None, 0.9, 0.95])) for v in "ab" for t in range(2) for f in range(90) if r.random() < 0.85]
    labels = spark.createDataFrame(rows, "video string, track int, frame int, length double, covered double")
    videos = spark.createDataFrame([("a", 90, 100.0), ("b", 50, 100.0)], "video string, n_frames int, median_length double")
    found = training.centres(labels, videos, 7, 3, 2)
    have = {x[:3] for x in rows}
    n = {"a": 90, "b": 50}
    want = {(v, t, c) for v in "ab" for t in range(2) for c in range(7, n[v] - 7, 2) if all((v, t, f) in have for f in (c - 3, c, c + 3))}
    assert {tuple(x) for x in found.select("video", "track", "frame").collect()} == want
    got = {tuple(x) for x in training.gated(found, labels.drop("covered"), videos).select("video", "track", "frame").collect()}
    assert got == {x for x in want if all(75 <= length <= 125 for v, _, f, length, _ in rows if (v, f) == (x[0], x[2]))}
    got = {tuple(x) for x in training.gated(found, labels, videos, "track").select("video", "track", "frame").collect()}
    assert got == {x for x in want if all(80 <= length <= 120 and (c is None or c >= 0.92) for v, _, f, length, c in rows if (v, f) == (x[0], x[2]))}
    with pytest.raises(ValueError):
        training.gated(found, labels, videos, "other")


def test_samples_hold_their_own_track_first(spark):
    rows = [("a", t, f, [(100.0 * t, float(f))]) for t in range(4) for f in range(20) if not (t == 3 and f == 10)]
    labels = spark.createDataFrame(rows, f"video string, track int, frame int, pts {PTS}")
    found = spark.createDataFrame([("a", 1, 10), ("a", 1, 12), ("a", 0, 5)], "video string, track int, frame int")
    got = {(x["track"], x["frame"], x["slot"]): (x["other"], [p[0]["y"] for p in x["pts"]]) for x in training.samples(found, labels, 2, 10, 3).collect()}
    assert {k: v[0] for k, v in got.items()} == {(1, 10, 0): 1, (1, 10, 1): 0, (1, 10, 2): 2, (1, 12, 0): 1, (1, 12, 1): 0, (1, 12, 2): 2, (0, 5, 0): 0, (0, 5, 1): 1, (0, 5, 2): 2}
    assert all(ys == [f - 2, f, f + 2] for (_, f, _), (_, ys) in got.items())
    assert training.samples(found, labels, 2, 1, 1).count() == 1
    assert training.samples(found.limit(0), labels, 2, 1, 1).count() == 0


def test_crossings_meet_where_they_should(spark):
    r = np.random.default_rng(2)
    t = np.linspace(0, 1, 49)
    rows, want = [], {}
    for k in range(20):
        base = np.stack([200 * t + 3 * np.sin(5 * t + k), 40 * np.cos(3 * t)], axis=1)
        donor = r.uniform(-50, 50, 2) + np.stack([150 * t, 30 * np.sin(4 * t + k)], axis=1)
        at, donor_at, angle, offset = int(r.integers(0, 49)), int(r.integers(0, 49)), float(r.uniform(-3, 3)), float(r.uniform(-9, 9))
        rows.append((k, base.tolist(), donor.tolist(), at, donor_at, angle, offset))
        want[k] = (base, donor, at, donor_at, angle, offset)
    df = spark.createDataFrame([(k, [tuple(p) for p in b], [tuple(p) for p in d], i, j, a, o) for k, b, d, i, j, a, o in rows], f"k int, b {PTS}, d {PTS}, i int, j int, a double, o double")
    for x in df.select("k", training.crossed(*[F.col(c) for c in ("b", "d", "i", "j", "a", "o")]).alias("p")).collect():
        base, donor, at, donor_at, angle, offset = want[x["k"]]
        p = np.array([tuple(q) for q in x["p"]])
        way = lambda m, i: math.atan2(*(m[min(i + 2, 48)] - m[max(i - 2, 0)])[::-1])
        w = way(base, at)
        assert np.allclose(p[donor_at], base[at] + offset * np.array([-math.sin(w), math.cos(w)]))
        assert abs(math.remainder(way(p, donor_at) - w - angle, 2 * math.pi)) < 1e-9
        assert np.allclose(np.hypot(*np.diff(p, axis=0).T), np.hypot(*np.diff(donor, axis=0).T))


def test_label_files_keep_hidden_points_empty(spark):
    points = spark.createDataFrame([("v", 3, "a", "head", 1.0, 2.0), ("v", 3, "b", "head", None, None), ("v", 12, "b", "tail", 5.0, 6.0), ("v", 12, "c", "tail", 5.0, 6.0)], "video string, frame int, individual string, bodypart string, x double, y double")
    out = training.collected_rows(points, ["a", "b"], ["head", "tail"])
    assert out.columns[:3] == ["folder", "video", "image"] and len(out.columns) == 11
    got = {x["image"]: x for x in out.collect()}
    assert got["img00003.png"]["a|head_y"] == 2.0 and got["img00003.png"]["b|head_x"] is None and got["img00012.png"]["b|tail_x"] == 5.0
