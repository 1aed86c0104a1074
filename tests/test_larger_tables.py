"""What larger tables and odd values brought up: ties, prints, crowded frames and large groups."""

import itertools
import math
import random

import numpy as np
from compare import same
from pyspark.sql import functions as F

from kinetrail.functions.printing import printed
from kinetrail.operators import cluster, matching, relational, tracking
from kinetrail.plans import catalog


def test_numbers_are_printed_as_in_c(spark):
    rng = random.Random(0)
    values = [0.0, -0.0, 0.5, 1.5, 2.5, -2.5, -0.3, 9.135, 0.125, 0.375, 760.5, 8456.5 / 1000, 1.005, 2.675, 123456789.125, 1e14 + 0.5, float("inf"), -float("inf")]
    values += [k / 8 for k in range(-40, 40)] + [rng.randint(-999999, 999999) / 1000 for _ in range(2000)] + [rng.uniform(-1e6, 1e6) for _ in range(200)]
    df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
    rows = df.select("x", *[printed(F.col("x"), d).alias(f"p{d}") for d in range(4)]).collect()
    for r in rows:
        assert [r[f"p{d}"] for d in range(4)] == [None if r["x"] is None else f"{r['x']:.{d}f}" for d in range(4)], r["x"]
    assert len(rows) == len(values) + 1


def copied(spark, sf, folder, **tables):
    """A folder of tables: those given, of sf otherwise."""
    for name in ("customer", "events", "lineitem", "embeddings"):
        if name in tables:
            tables[name].write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_report_lines_round_like_sql(spark, sf, tmp_path):
    c = spark.read.parquet(f"{sf}/customer.parquet").withColumn("c_acctbal", F.col("c_custkey").cast("double") / 2 + F.col("c_custkey") * 5)
    same(spark, copied(spark, sf, tmp_path, customer=c), catalog.QUERIES["track_report"], catalog.ORACLES["track_report"])


def test_peak_of_equal_values_is_the_first(spark, sf, tmp_path):
    e = spark.read.parquet(f"{sf}/events.parquet")
    e = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("event_id", F.col("event_id") + F.col("k") * 100000).drop("k")
    same(spark, copied(spark, sf, tmp_path, events=e), catalog.QUERIES["track_stats"], catalog.ORACLES["track_stats"])


def test_ward_takes_no_matrix_of_distances():
    """Equal to updates on a matrix, in memory that grows with the rows."""
    import tracemalloc

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(60, 5)), np.repeat(rng.normal(size=(7, 5)), 3, 0)])
    merges = cluster.ward_merges(x)
    groups, height = {i: [i] for i in range(len(x))}, []
    for k, (a, b, d, size) in enumerate(merges):
        one, two = groups.pop(int(a)), groups.pop(int(b))
        gap = math.sqrt(2 * len(one) * len(two) / (len(one) + len(two))) * np.linalg.norm(x[one].mean(0) - x[two].mean(0))
        least = min(math.sqrt(2 * len(p) * len(q) / (len(p) + len(q))) * np.linalg.norm(x[p].mean(0) - x[q].mean(0)) for p, q in itertools.combinations([one, two, *groups.values()], 2))
        assert abs(d - gap) < 1e-9 and abs(d - least) < 1e-9 and size == len(one) + len(two)
        groups[len(x) + k] = one + two
        height.append(d)
    assert height == sorted(height)
    many = rng.normal(size=(3000, 16))
    tracemalloc.start()
    cluster.ward_merges(many)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 20e6  # a matrix of 3000 x 3000 doubles takes 72 MB


def test_a_chain_of_merges_is_cut():
    n = 3000
    merges = np.array([(0, 1, 0, 2)] + [(k + 1, n + k - 1, 0, k + 2) for k in range(1, n - 1)], float)
    assert cluster.cut_tree(merges, n, 2).tolist() == [1] * (n - 1) + [2]


def test_silhouette_over_several_tiles(spark):
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(150, 4)), np.repeat(rng.normal(size=(5, 4)), 10, 0)]) + 1000
    label = rng.integers(0, 3, len(x))
    df = spark.createDataFrame([(i, int(k), v.tolist()) for i, (k, v) in enumerate(zip(label, x, strict=True))], "id long, label int, v array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    rows = cluster.silhouette(df, "id", "label", "v", least=16, most=32).collect()
    assert len(rows) == len(x)
    for r in rows:
        means = [d[r["id"], label == k].sum() / ((label == k).sum() - (k == label[r["id"]])) for k in range(3)]
        a = means[label[r["id"]]]
        b = min(m for k, m in enumerate(means) if k != label[r["id"]])
        assert abs(r["a"] - a) < 1e-9 and abs(r["b"] - b) < 1e-9 and abs(r["s"] - (b - a) / max(a, b)) < 1e-9


def test_neighbours_within_reach(spark):
    """Nearest ones and counts against loops, with equal values, values exactly the reach apart and single rows."""
    rng = random.Random(3)
    rows = [(v, f, t, rng.randint(0, 40) / 10 if t else None) for v in range(2) for f in range(5) for t in range(30) if rng.random() < 0.7] + [(9, 0, 0, 1.0)]
    df = spark.createDataFrame(rows, "video int, frame int, track long, x double")
    loop_d, loop_n = {}, {}
    for v, f, t, x in rows:
        others = [(abs(y - x), o) for w, g, o, y in rows if (w, g) == (v, f) and o != t and y is not None and x is not None]
        if others:
            loop_d[v, f, t] = min(others)[0]
        close = [o for d, o in others if d <= 0.5]
        if close:
            loop_n[v, f, t] = (len(close), min(close))
    assert {tuple(r)[:3]: r["d"] for r in matching.nearest_along(df, ["video", "frame"], "track", "x").collect()} == loop_d
    assert {tuple(r)[:3]: (r["n"], r["least"]) for r in matching.within_reach(df, ["video", "frame"], "track", "x", 0.5).collect()} == loop_n


def test_frames_are_not_joined_with_themselves(spark, sf):
    for name in ("absorbed_mask", "clean_labels", "absorbed_gaps"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        unequal = [line for line in plan.splitlines() if "Join Inner" in line and "NOT (" in line]
        assert all("p#" in line and "q#" in line for line in unequal), (name, unequal)  # by squares, not by frames alone


def test_quantiles_are_exact_and_few_values_meet(spark):
    """Equal to percentile to the last bit: large and small groups, heavy ties, nulls, NaN, a null key and a group without values."""
    big = spark.range(60000).select(F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").alias("k"), F.when(F.col("id") % 3 == 1, F.floor(F.rand(5) * 7)).otherwise(F.randn(6) * 1e3).alias("v"))
    few = spark.createDataFrame([("c", float(i)) for i in range(3)] + [("d", 1.0), ("e", None), ("f", 2.0), ("f", None), ("g", float("nan")), ("g", 1.0), ("g", 5.0)], "k string, v double")
    df = big.unionByName(few).localCheckpoint()
    v = F.col("v")
    wanted = {"m": (v, 0.5), "p": (v, 0.9), "z": (F.when(v > 0, v), 0.5), "one": (v, 1.0), "none": (v, 0.0)}
    got = relational.quantiles(df, ["k"], wanted, {"n": F.count(F.lit(1))}, accuracy=1000)
    right = df.groupBy("k").agg(*[F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in wanted.items()], F.count(F.lit(1)).alias("n"))
    assert sorted(map(repr, got.select(*right.columns).collect())) == sorted(map(repr, right.collect()))


def test_large_groups_do_not_meet_whole(spark, sf):
    for name in ("global_threshold", "group_median_p90", "const_crossjoin"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
        assert "percentile(" not in plan.replace("percentile_approx(", ""), name


def test_objects_of_all_frames_are_dealt_over_tasks(spark):
    tracks, frames = spark.range(400).select(F.lit(0).alias("video"), F.col("id").alias("track")), spark.range(50).select(F.lit(0).alias("video"), F.col("id").alias("frame"))
    pairs = relational.product(tracks, frames, ["video"])
    assert pairs.distinct().count() == pairs.count() == 20000
    sizes = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 16000  # a join by the video makes all in one task


def test_crowded_frames_are_tracked_without_a_matrix(monkeypatch):
    """Greedy pairs by growing radius, and by row where all are in one place, equal those of the whole matrix; a crowd's memory is bounded."""
    import tracemalloc

    rng = np.random.default_rng(4)
    for kind, (n, m, most) in itertools.product(range(3), ((80, 120, 100), (60, 300, 900), (70, 70, 1), (40, 40, 10**6))):
        x, y, xs, ys = (np.round(rng.exponential(300, k)) if kind == 0 else rng.integers(0, 5, k) * 1.0 if kind == 1 else rng.normal(size=k) * 200 for k in (n, n, m, m))
        wait = rng.integers(1, 4, m)

        def cost(i, j):
            d = np.hypot(x[i] - xs[j], y[i] - ys[j])  # noqa: B023
            return np.where(d < 150, d + 0.5 * wait[j], np.inf)  # noqa: B023

        monkeypatch.setattr(tracking, "PAIRS", most)
        got = tracking.greedy_near(x, y, xs, ys, cost)
        assert sorted(zip(*(g.tolist() for g in got), strict=True)) == sorted(tracking.greedy_pairs(cost(np.arange(n)[:, None], np.arange(m)[None])))
    monkeypatch.undo()
    live, n = tracking.LiveTracks(200, 150.0, 450.0, 0.7, 0.9), 12000
    tracemalloc.start()
    for frame in range(2):
        live.step(frame, rng.exponential(500, n), rng.uniform(0, 1000, n), np.full(n, 2000.0), np.zeros(n, bool))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 800e6  # one matrix of doubles takes 1152 MB, and there were several


def test_tracks_do_not_depend_on_batches(spark, sf):
    def rows(n):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", n)
        return sorted(map(repr, catalog.QUERIES["track_greedy"](spark, sf).collect()))

    try:
        assert rows("7") == rows("10000")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_nearest_others_against_a_loop(spark):
    """Exact distances: a far point, a crowd in one place, equal places, hidden points, an object without others, and frames that nobody asks for."""
    rng = np.random.default_rng(4)
    x, y = np.round(rng.exponential(300, 700), 1), rng.integers(0, 5, 700) * 30.0
    x[:150], y[:150], x[150], x[151:155], y[151:155] = rng.normal(50, 1e-3, 150), rng.normal(50, 1e-3, 150), 1e6, 77.0, 60.0
    owner = rng.permutation(np.repeat(np.arange(350), 2))
    d = np.sqrt((x[:, None] - x[None]) ** 2 + (y[:, None] - y[None]) ** 2)
    d[owner[:, None] == owner[None]] = np.inf
    want = np.array([d[owner == k].min() for k in range(350)])
    asked = rng.random(350) < 0.8
    assert np.array_equal(matching.nearest_others(x, y, owner, asked, most=1000), np.where(asked, want, np.inf))
    rows = [("v", 0, int(k), [(float(a), float(b)) for a, b in zip(x[owner == k], y[owner == k], strict=True)] + [None]) for k in range(350)] + [("v", 1, 0, [(1.0, 1.0)]), ("v", 2, 0, [(1.0, 1.0)])]
    df = spark.createDataFrame(rows, "video string, frame int, track int, pts array<struct<x:double,y:double>>")
    got = {(r["frame"], r["track"]): r["d"] for r in matching.least_distances(df.where("frame < 2"), df, ["video", "frame"], "track", "pts").collect()}
    assert got == {(0, k): want[k] for k in range(350)} | {(1, 0): math.inf}


def test_a_frame_of_many_tracks_is_exported_in_flat_rows(spark, sf, tmp_path):
    """The query makes neither pairs of a frame's tracks nor an episode's row with all midlines for each of its tracks."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    e = e.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(9)))).select((F.col("event_id") + F.col("k") * 100000).alias("event_id"), "ts", (F.col("user_id") + F.col("k") * 1500).alias("user_id"), "event_type", (F.col("value") + F.pmod(F.hash("k", "event_id"), F.lit(999)) / 10).alias("value"), "props")
    folder = copied(spark, sf, tmp_path, events=e)
    same(spark, folder, catalog.QUERIES["episode_export"], catalog.ORACLES["episode_export"])
    plan = catalog.QUERIES["episode_export"](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "others" not in plan and "midline" not in plan


def test_splines_are_fitted_some_at_a_time(spark, monkeypatch):
    """However large the batches are; with the same result as all at once."""
    from kinetrail.functions import spline

    df = spark.range(0, 1200, 1, 1).select("id", F.transform(F.sequence(F.lit(0), F.lit(31)), lambda i: F.struct((i * 3.0).alias("x"), F.sin(i * 0.3 + F.col("id")).alias("y"))).alias("pts"))
    rows = df.toArrow()["pts"].combine_chunks()
    want = spline.splines_of(rows, spline.pa.array([0.02] * 1200), 49).to_pylist()
    seen = df.withColumn("pts", F.when(F.col("id") != 700, F.col("pts")))
    got = {r["id"]: r["spline"] for r in spline.smooth_resample(seen, "pts", 49, F.lit(0.02)).collect()}
    assert got.pop(700) is None and len(got) == 1199
    for k, s in got.items():
        assert s["length"] == want[k]["length"] and [tuple(p) for p in s["pts"]] == [(q["x"], q["y"]) for q in want[k]["pts"]]
    import tracemalloc

    import pyarrow as pa

    many = pa.RecordBatch.from_arrays([pa.concat_arrays([rows] * 5), pa.array([0.02] * 6000)], ["pts", "__bound"])
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: f)
    run = spline.smooth_resample(df.select("pts"), "pts", 49, F.lit(0.02))
    tracemalloc.start()
    assert sum(b.num_rows for b in run(iter([many]))) == 6000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6  # all at once take over 150 MB


def test_trails_measure_each_turn_once(monkeypatch):
    """Turns are looked up where branches meet again; counts would grow with the walks."""
    import pandas as pd

    from kinetrail.operators import skeleton_graph

    calls = []
    turn = skeleton_graph.turn
    monkeypatch.setattr(skeleton_graph, "turn", lambda u, v: calls.append(1) or turn(u, v))
    at = {n: np.array(p, float) for n, p in enumerate([(0, 0), (60, 0), (30, 25), (-40, 30), (-40, -30), (100, 30), (100, -30)])}
    ends = [(3, 0), (0, 4), (0, 1), (2, 0), (1, 2), (1, 5), (6, 1)]
    graph = skeleton_graph.Graph(pd.DataFrame([{"edge_id": i, "n0": a, "n1": b, "len": float(np.hypot(*(at[a] - at[b]))), "co": [*at[a], *at[b]]} for i, (a, b) in enumerate(ends)]))
    assert skeleton_graph.trail(graph, None)[2] and len(calls) <= 30


def test_hidden_points_of_dense_tracks():
    import pandas as pd

    from kinetrail.operators import pose_features

    pdf = pd.DataFrame({"frame": [3, 0, 1], "pts": [[1.0, None, 3.0, 4.0], None, np.array([5.0, np.nan, 7.0, 8.0])]})
    first, got = pose_features._dense(pdf, "frame", "pts", 2)
    want = np.full((4, 2, 2), np.nan)
    want[3], want[1] = [[1, np.nan], [3, 4]], [[5, np.nan], [7, 8]]
    assert first == 0 and np.array_equal(got, want, equal_nan=True)
