"""Properties, brute force and edge cases of the trajectory operators."""

import itertools
import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from kinetrail.functions import geometry as g
from kinetrail.operators import cluster, pose_features, relational, series, skeleton_graph, tracking


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 5), st.integers(1, 5), st.integers(0, 10**6))
def test_hungarian_is_optimal(n, m, seed):
    cost = np.random.default_rng(seed).random((n, m))
    pairs = tracking.hungarian(cost)
    assert len(pairs) == min(n, m) == len({i for i, _ in pairs}) == len({j for _, j in pairs})
    small = cost if n <= m else cost.T
    best = min(sum(small[i, p[i]] for i in range(len(small))) for p in itertools.permutations(range(small.shape[1]), len(small)))
    assert math.isclose(sum(cost[i, j] for i, j in pairs), best)


def wave_body(v=0.1, f=0.5, wave=0.7, amp=0.08, frames=400, fps=10.0, length=500.0, turn_at=None):
    """A travelling sine wave of known speed, frequency, wavelength and amplitude (in lengths)."""
    t = np.arange(frames) / fps
    s = np.linspace(0, 1, 49)
    way = np.where(t < (turn_at if turn_at else np.inf), t, 2 * (turn_at or 0) - t)
    x = (way * v)[:, None] - s[None] * 0.93
    y = amp * np.sin(2 * np.pi * (s[None] / wave * 0.93 - f * t[:, None]))
    return np.stack([x, y], -1) * length


def test_known_features():
    p = wave_body()
    out = pose_features.features(p, 10.0)
    assert abs(out["speed_bl_s"] * out["L_px"] / 500 - 0.1) < 0.03  # the centre also sways
    assert abs(out["freq_hz"] - 0.5) < 0.13 and abs(out["freq_zc_hz"] - 0.5) < 0.1
    assert abs(out["amp_bl"] * out["L_px"] / 500 - 0.08) < 0.02
    assert out["frac_move"] > 0.95 and out["frac_forward"] > 0.9 and out["rev_per_min"] == 0
    still = pose_features.features(wave_body(v=0.0, f=0.0), 10.0)
    assert still["frac_pause"] == 1.0 and still["frac_move"] == 0.0
    back = pose_features.features(wave_body(turn_at=20.0), 10.0)
    assert 0 < back["rev_per_min"] <= 3 and back["frac_backward"] > 0.3


def test_features_need_evidence():
    p = wave_body(frames=20)
    assert pose_features.features(p, 10.0) is None
    hidden = wave_body()
    hidden[:, 20] = np.nan
    assert pose_features.features(hidden, 10.0) is None
    cut = wave_body()
    cut[:, 45:] = np.nan
    assert pose_features.features(cut, 10.0) is None
    assert pose_features.features(cut, 10.0, body=500.0)["L_px"] == 500.0


def test_power_spectrum_of_a_sine():
    x = np.sin(2 * np.pi * 1.5 * np.arange(400) / 20)
    f, p = pose_features.power_spectrum(x, 20.0, 160)
    assert f[p.argmax()] == 1.5 and abs(p.sum() * f[1] - 0.5) < 0.01


def test_ward_against_brute_force():
    x = np.random.default_rng(1).random((14, 3))
    merges = cluster.ward_merges(x)
    groups, n = {i: [i] for i in range(14)}, 14
    for a, b, d, size in merges:
        def cost(p, q):
            u, v = x[groups[p]], x[groups[q]]
            return math.sqrt(2 * len(u) * len(v) / (len(u) + len(v))) * np.linalg.norm(u.mean(0) - v.mean(0))

        best = min(cost(p, q) for p, q in itertools.combinations(groups, 2))
        assert math.isclose(d, best, rel_tol=1e-9) and math.isclose(cost(int(a), int(b)), d, rel_tol=1e-9)
        groups[n] = groups.pop(int(a)) + groups.pop(int(b))
        assert len(groups[n]) == size
        n += 1
    assert sorted(cluster.leaf_order(merges, 14)) == list(range(14))
    assert len(set(cluster.cut_tree(merges, 14, 4))) == 4


def test_pca_against_svd(spark):
    x = np.random.default_rng(2).random((60, 5))
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, v array<double>")
    scores, ratio = cluster.pca(df, "id", "v", 2)
    _, s, vt = np.linalg.svd(x - x.mean(0), full_matrices=False)
    assert np.allclose(ratio, (s**2 / (s**2).sum())[:2])
    got = np.array([[r["pc1"], r["pc2"]] for r in scores.orderBy("id").collect()])
    assert np.allclose(np.abs(got), np.abs((x - x.mean(0)) @ vt[:2].T))


def test_suppression_keeps_no_dominated_pair(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i % 3), i, float(rng.random()), *map(float, rng.random(2)), [float(v) for v in rng.random(4)]) for i in range(60)]
    df = spark.createDataFrame(rows, "frame int, det_id long, score double, cx double, cy double, latent array<double>")
    kept = {r["det_id"] for r in tracking.suppress(df, cutoff=0.4, overlap=0.6).collect()}
    near = lambda a, b: math.hypot(a[3] - b[3], a[4] - b[4]) < 0.4 and sum((x - y) ** 2 for x, y in zip(a[5], b[5], strict=True)) < -math.log(0.6)
    for a, b in itertools.permutations(rows, 2):
        if a[0] == b[0] and a[1] in kept and b[1] in kept:
            assert not near(a, b)
    for a in rows:
        if a[1] not in kept:
            assert any(b[0] == a[0] and b[1] in kept and b[2] >= a[2] and near(a, b) for b in rows)


def test_tracks_are_one_to_one(spark):
    rows = [("v", f, k, 100.0 * k + f, 50.0, 2000.0, False) for f in range(30) for k in range(3) if (f, k) != (10, 1)]
    df = spark.createDataFrame(rows, "video string, frame int, comp_id int, cx double, cy double, area double, border boolean")
    out = tracking.track(df).collect()
    assert {(r["comp_id"], r["track_id"]) for r in out} == {(0, 0), (1, 1), (2, 2)}
    assert tracking.track(df.limit(0)).count() == 0


def test_trail_takes_the_straight_way():
    import pandas as pd

    arm = lambda x, y: [v for t in range(9) for v in (t * x * 10.0, t * y * 10.0)]
    e = pd.DataFrame({"edge_id": [0, 1, 2], "n0": [0, 0, 0], "n1": [1, 2, 3], "len": [80.0, 80.0, 90.0], "co": [arm(1, 0), arm(-1, 0), arm(0, 1)]})
    used, length, complete = skeleton_graph.trail(skeleton_graph.Graph(e), None)
    assert complete
    assert sorted(used) == [0, 1] and length == 160.0
    found, complete = skeleton_graph.paths(skeleton_graph.Graph(e), 4.0)
    assert complete
    assert (0, 1) in {tuple(sorted(p["edges"])) for p in found}


def test_interpolation_like_pandas(spark):
    import pandas as pd

    x = [None, None, 1.0, None, None, None, None, 6.0, None, 8.0, None, None, None]
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate(x)], "k string, f int, v double")
    got = [r["o"] for r in series.interpolate(df, ["k"], "f", "v", 2, "o").orderBy("f").collect()]
    want = pd.Series(x, dtype=float).interpolate(limit=2).tolist()
    assert all((a is None and math.isnan(b)) or math.isclose(a, b) for a, b in zip(got, want, strict=True))


def test_sequences_of_one_row_and_none(spark):
    one = spark.createDataFrame([("a", 0, 1.0, True)], "k string, f int, v double, b boolean")
    for df in (one, one.limit(0)):
        n = df.count()
        assert series.runs(df, ["k"], "f", "b", 1).count() == n
        assert series.hop_windows(df, ["k"], "f", 20, 10).count() == n
        assert series.ema(df, ["k"], "f", "v", 0.9, "o").count() == n
        assert series.box_filter(df, ["k"], "f", "v", 4, "o").count() == n
        assert series.absences(df, ["k"], "f", 5).count() == 0


def test_hop_windows_start_at_zero(spark):
    df = spark.range(45).select(F.lit("a").alias("k"), F.col("id").cast("int").alias("f"))
    got = {(r["t0"], r["n"]) for r in series.hop_windows(df, ["k"], "f", 20, 10).groupBy("t0").agg(F.count("*").alias("n")).collect()}
    assert got == {(0, 20), (10, 20), (20, 20)}
    assert {r["t0"] for r in series.hop_windows(df.where("f < 7"), ["k"], "f", 20, 10).collect()} == {0}


def line(spark, *pts):
    return spark.createDataFrame([([None if p is None else {"x": float(p[0]), "y": float(p[1])} for p in pts],)], "p array<struct<x:double,y:double>>")


def test_degenerate_midlines(spark):
    df = line(spark, (1, 1), (1, 1), (1, 1))
    p = F.col("p")
    r = df.select(g.arc_length(p).alias("l"), g.resample(p, 5).alias("r"), g.curvature(p).alias("k"), g.amplitude(p).alias("a"), g.wavelength(g.curvature(p)).alias("w")).first()
    assert r["l"] == 0 and len(r["r"]) == 5 and set(r["k"]) == {None} and r["a"] == 0 and r["w"] is None
    hidden = line(spark, None, None)
    r = hidden.select(g.visible(p).alias("n"), g.centroid(p).alias("c"), g.all_visible(p).alias("f")).first()
    assert (r["n"], r["c"], r["f"]) == (0, None, False)


def test_flip_invariance(spark):
    rng = np.random.default_rng(5)
    df = line(spark, *rng.random((49, 2))).crossJoin(line(spark, *rng.random((49, 2))).withColumnRenamed("p", "q"))
    p, q = F.col("p"), F.col("q")
    r = df.select(g.flip_distance(p, q).alias("a"), g.flip_distance(F.reverse(p), q).alias("b"), g.arc_length(p).alias("c"), g.arc_length(F.reverse(p)).alias("d")).first()
    assert math.isclose(r["a"], r["b"]) and math.isclose(r["c"], r["d"])


def test_nan_becomes_null_once(spark):
    df = line(spark, (1, 2), (float("nan"), 0), (3, 4))
    r = df.select(g.hidden_null(F.col("p")).alias("p")).first()["p"]
    assert r[1] is None and r[0]["x"] == 1


def test_flag_traps(spark):
    df = spark.createDataFrame([("cluster;from_cluster",), ("from_cluster",), ("",)], "f string")
    r = df.select(F.count_if(relational.flag_like("f", "cluster")).alias("like"), F.count_if(relational.has_flag(relational.flag_set("f"), "cluster")).alias("has"), F.max(F.size(relational.flag_set("f"))).alias("n")).first()
    assert (r["like"], r["has"], r["n"]) == (2, 1, 2)


@pytest.mark.parametrize("fn", [relational.median, relational.p90])
def test_medians_leave_nulls_out(spark, fn):
    df = spark.createDataFrame([(1.0,), (None,), (3.0,)], "x double")
    want = np.percentile([1.0, 3.0], 50 if fn is relational.median else 90)
    assert math.isclose(df.agg(fn("x").alias("m")).first()["m"], want)


def test_orientation_parity_equals_the_loop(spark):
    """Head/tail continuity with the free-end rule at an edge, decided frame by frame."""
    rng = np.random.default_rng(8)
    bodies = [rng.random((5, 2)) for _ in range(120)]
    rows = [("v", f, [{"x": float(x), "y": float(y)} for x, y in b]) for f, b in enumerate(bodies)]
    df = spark.createDataFrame(rows, "k string, f int, p array<struct<x:double,y:double>>")
    p = F.col("p")
    df = df.withColumn("prev", F.lag("p").over(series.by(["k"], "f")))
    df = df.withColumn("c", g.continuity(p, F.col("prev"), F.element_at(p, 1)["x"] > 0.7, F.element_at(p, -1)["x"] > 0.7)).select("k", "f", "c.*")
    got = [r["flipped"] for r in series.orientation_parity(df, ["k"], "f", "same", "flip").orderBy("f").collect()]
    d = lambda a, b: float(np.hypot(*(a - b)))
    want, prev = [], None
    for b in bodies:
        flipped = False
        if prev is not None:
            head, tail = b[0, 0] > 0.7, b[-1, 0] > 0.7
            if head != tail:
                free = b[-1] if head else b[0]
                near, far = d(free, prev[0]), d(free, prev[-1])
                flipped = (near < far) if head else (far < near)
            else:
                flipped = d(b[0], prev[-1]) + d(b[-1], prev[0]) < d(b[0], prev[0]) + d(b[-1], prev[-1])
        prev = b[::-1] if flipped else b
        want.append(bool(flipped))
    assert got == want
