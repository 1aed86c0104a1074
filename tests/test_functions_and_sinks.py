"""Splines, latent vectors, table functions and upserting sinks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.functions import latents, spline, tables
from kinetrail.operators import series
from kinetrail.streaming import sinks

PTS = "id int, pts array<struct<x:double,y:double>>"


def curve(n, f):
    return [tuple(map(float, f(t))) for t in np.linspace(0, 1, n)]


# splines


def test_bands_solve_like_a_dense_system():
    rng = np.random.default_rng(0)
    k = 9
    a = rng.random((4, 30, k))
    band = np.abs(np.subtract.outer(np.arange(k), np.arange(k))) <= spline.BAND
    dense = np.einsum("nij,nik->njk", a, a) * band + 50 * np.eye(k)
    bands = np.stack([np.concatenate([np.diagonal(dense, -b, 1, 2), np.zeros((4, b))], axis=1) for b in range(4)], axis=2)
    right = rng.random((4, k, 2))
    assert np.allclose(spline.solve(bands, right), np.linalg.solve(dense, right))


def test_splines_follow_known_curves(spark):
    noise = np.random.default_rng(1).normal(0, 1.0, (300, 2))
    arc = [(200 * math.cos(math.pi * t), 200 * math.sin(math.pi * t)) for t in np.linspace(0, 1, 300)]
    rows = [(0, curve(40, lambda t: (100 * t, 50 * t))), (1, [(float(x + a), float(y + b)) for (x, y), (a, b) in zip(arc, noise)]), (2, curve(7, lambda t: (t, t))), (3, [(1.0, 1.0)] * 20), (4, None), (5, [*curve(20, lambda t: (t, t))[:-1], None]), (6, [])]
    out = {r["id"]: r["s"] for r in spline.smooth_resample(spark.createDataFrame(rows, PTS), "pts", 49, out="s").collect()}
    assert all(out[i] is None for i in (2, 3, 4, 5, 6))
    line = np.array([tuple(p) for p in out[0]["pts"]])
    assert np.allclose(line, np.stack([np.linspace(0, 100, 49), np.linspace(0, 50, 49)], axis=1), atol=0.5) and abs(out[0]["length"] - math.hypot(100, 50)) < 0.5
    p = np.array([tuple(x) for x in out[1]["pts"]])
    off = np.abs(np.hypot(*p.T) - 200)
    assert off.max() < 3 and off.mean() < 0.5 and abs(out[1]["length"] - math.pi * 200) < 8  # nearer to the circle than the noise
    steps = np.hypot(*np.diff(p, axis=0).T)
    assert steps.std() / steps.mean() < 0.01


@pytest.mark.parametrize("smooth", [1.0, 200.0, 1e6])
def test_residuals_stay_within_the_bound_and_use_it(smooth):
    rng = np.random.default_rng(2)
    x = np.linspace(0, 1, 120)
    points = np.stack([300 * x, 40 * np.sin(6 * x)], axis=1) + rng.normal(0, 0.8, (120, 2))
    c = spline.fit(np.concatenate([points, points[:60]]), np.array([120, 60]), np.array([smooth, smooth]))
    d = np.concatenate([[0], np.cumsum(np.hypot(*np.diff(points, axis=0).T))])
    j, w = spline.weights(d / d[-1], c.shape[1])
    residual = ((sum(w[:, a, None] * c[0][j + a] for a in range(4)) - points) ** 2).sum()
    closest = ((points - points.mean(0)) ** 2).sum()
    assert residual <= smooth * 1.001 or smooth == 1.0  # 24 coefficients cannot follow noise of that size any nearer
    assert residual > 0.9 * smooth or smooth == 1e6 and residual < closest


# latent vectors


def test_latent_vectors_round_trip_like_numpy(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(200, 10)) @ np.diag(np.arange(1, 11))
    df = spark.createDataFrame([(i, v.tolist(), (float(i), 1.0)) for i, v in enumerate(x)] + [(-1, None, (0.0, 0.0)), (-2, [None] + [1.0] * 9, (0.0, 0.0))], "id int, v array<double>, c struct<x:double,y:double>").repartition(3)
    a = latents.principal_components(df, "v", 10, 10)
    _, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(np.abs(a @ vectors[:, ::-1]), np.eye(10), atol=1e-8)
    out = df.withColumn("z", latents.project(F.col("v"), a)).withColumn("back", latents.recover(F.col("z"), a, F.col("c"))).withColumn("turned", latents.multiply(F.col("z"), latents.flip_matrix(a))).collect()
    for r in out:
        if r["id"] < 0:
            assert r["z"] is None and r["back"] is None
            continue
        v = x[r["id"]]
        assert np.allclose(r["z"], a @ v) and np.allclose(r["back"], v + np.tile([r["id"], 1.0], 5))
        assert np.allclose(r["turned"], a @ v.reshape(-1, 2)[::-1].ravel())
    with pytest.raises(Exception, match="must have"):
        df.select(latents.multiply(F.col("v"), np.eye(3))).collect()


# table functions


def test_table_functions_in_sql(spark):
    r = random.Random(4)
    rows = [(k, f) for k in range(5) for f in sorted(r.sample(range(30_000), 12_000 if k == 0 else 60))]
    df = spark.createDataFrame(rows, "track long, frame long").repartition(7)
    df.createOrReplaceTempView("kinetrail_table_functions")
    tables.register(spark)
    got = spark.sql("SELECT key AS track, a, b FROM bridged_runs(TABLE(SELECT track, frame FROM kinetrail_table_functions) PARTITION BY track ORDER BY (frame), 2, 3)")
    want = series.bridged_runs(df.withColumn("on", F.lit(True)), ["track"], "frame", "on", 2, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select("track", "a", "b").collect()))
    thin = {k: [] for k in range(5)}
    for k, f in rows:
        if not thin[k] or f - thin[k][-1] >= 10:
            thin[k].append(f)
    got = spark.sql("SELECT key, frame FROM thinned(TABLE(SELECT track, frame FROM kinetrail_table_functions) PARTITION BY track ORDER BY (frame), 10)").collect()
    assert sorted(map(tuple, got)) == sorted((k, f) for k in thin for f in thin[k])
    assert spark.sql("SELECT * FROM bridged_runs(TABLE(SELECT track, frame FROM kinetrail_table_functions WHERE false) PARTITION BY track ORDER BY (frame), 2, 3)").count() == 0


# sinks


def test_upserts_from_a_stream(spark, tmp_path):
    schema, folder, path = "k long, t long, v string, deleted boolean", tmp_path / "in", str(tmp_path / "out")
    batches = [[(1, 0, "a", None), (2, 0, "b", None), (2, 1, "c", None)], [(1, 5, "d", False), (3, 0, "e", None)], [(2, 9, None, True)]]

    def run(n):
        for i in range(n):
            if not (folder / str(i)).exists():
                spark.createDataFrame(batches[i], schema).coalesce(1).write.parquet(str(folder / str(i)))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))
        sinks.upserts(source, path, str(tmp_path / "checkpoint"), availableNow=True).awaitTermination()

    def at(upto=None):
        return {r["k"]: r["v"] for r in sinks.state(spark, path, schema, ["k"], ["t"], upto).collect()}

    run(1)
    assert at() == {1: "a", 2: "c"}
    run(2)
    run(3)
    assert at() == {1: "d", 3: "e"} and at(1) == {1: "d", 2: "c", 3: "e"} and at(0) == {1: "a", 2: "c"}
    before = at(2)
    sinks.write_batch(spark.createDataFrame(batches[1], schema), 1, path)  # replayed
    assert at() == before and spark.read.parquet(path).count() == 6
    whole = sinks.compact(spark, path, str(tmp_path / "whole"), schema, ["k"], ["t"])
    assert {r["k"]: r["v"] for r in whole.collect()} == before and whole.columns == ["k", "t", "v"]
