"""Rules of merges and scores against plain loops."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetrail.functions import geometry as g
from kinetrail.operators import merging, tracking


def loop_tracks(rows, gap=200, near=150.0, far=450.0):
    """rows: (frame, comp, x, y, area, border), by frame and component."""
    tracks, out = [], {}
    for frame, group in itertools.groupby(rows, key=lambda r: r[0]):
        group, pairs = list(group), []
        for i, (_, _, x, y, area, border) in enumerate(group):
            for t in tracks:
                wait, size = frame - t["last"], abs(math.log(area / t["area"]))
                if wait > gap or (not border and not t["border"] and size > 0.7):
                    continue
                d = math.hypot(x - t["x"], y - t["y"])
                if d < (near if wait == 1 else far):
                    pairs.append((d + 0.5 * wait + 200 * size, i, t["id"]))
        mine, used = {}, set()
        for _, i, t in sorted(pairs):
            if i not in mine and t not in used:
                mine[i] = t
                used.add(t)
        for i, (_, comp, x, y, area, border) in enumerate(group):
            if i not in mine:
                mine[i] = len(tracks)
                tracks.append({"id": len(tracks), "area": area})
            elif not border:
                tracks[mine[i]]["area"] = 0.9 * tracks[mine[i]]["area"] + 0.1 * area
            tracks[mine[i]] |= {"last": frame, "x": x, "y": y, "border": border}
            out[frame, comp] = mine[i]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_tracks_against_the_loop(seed):
    r = random.Random(seed)
    rows = [(f, c, r.uniform(0, 900), r.uniform(0, 900), r.uniform(50, 400), r.random() < 0.3) for f in sorted(r.sample(range(600), 80)) for c in range(r.randint(1, 6))]
    pdf = pd.DataFrame(rows, columns=["frame", "comp_id", "cx", "cy", "area", "border"])
    want = loop_tracks(rows)
    whole = tracking.LiveTracks(200, 150.0, 450.0, 0.7, 0.9)
    assert dict(zip(zip(pdf["frame"], pdf["comp_id"]), whole.run(pdf))) == want
    # in two batches, with the state handed over
    middle = int(np.searchsorted(pdf["frame"], 300))
    one = tracking.LiveTracks(200, 150.0, 450.0, 0.7, 0.9)
    ids = one.run(pdf[:middle])
    ids = np.concatenate([ids, tracking.LiveTracks(200, 150.0, 450.0, 0.7, 0.9, one.state()).run(pdf[middle:])])
    assert dict(zip(zip(pdf["frame"], pdf["comp_id"]), ids)) == want


def score_by_permutations(truth, found, lengths, border):
    def d(a, b):
        a, b = np.reshape(a, (-1, 2)), np.reshape(b, (-1, 2))
        return min(np.hypot(*(a - b).T).mean(), np.hypot(*(a - b[::-1]).T).mean())

    n, m = len(truth), len(found)
    options = [list(zip(range(n), p)) for p in itertools.permutations(range(m), n)] if n <= m else [list(zip(p, range(m))) for p in itertools.permutations(range(n), m)]
    pairs = min(options, key=lambda o: sum(d(truth[i], found[j]) for i, j in o)) if n and m else []
    errors = [d(truth[i], found[j]) / np.mean(lengths) for i, j in pairs]
    extra = sum(1 for j in range(m) if j not in {j for _, j in pairs} and not border[j])
    miss = n - len(pairs)
    return pairs, errors, miss, extra, bool(n and not miss and not extra and all(e < 0.05 for e in errors))


def test_scores_against_all_assignments(spark):
    r = np.random.default_rng(5)
    truth, found, want, roles = [], [], {}, {}
    for f in range(25):
        n, m = r.integers(0, 4), r.integers(0, 5)
        t = [r.normal(0, 5, 8).tolist() for _ in range(n)]
        p = [(np.array(t[j]) + r.normal(0, 0.3, 8)).tolist() if j < n and r.random() < 0.8 else r.normal(0, 5, 8).tolist() for j in range(m)]
        lengths, border = r.uniform(5, 15, n).tolist(), (r.random(m) < 0.3).tolist()
        role = ["base" if i % 2 == 0 else "donor" for i in range(n)]
        truth += [(f, x, length, k) for x, length, k in zip(t, lengths, role)]
        found += [(f, x, b) for x, b in zip(p, border)]
        if n or m:
            pairs, errors, miss, extra, every = score_by_permutations(t, p, lengths, border)
            want[f] = (n, m, len(pairs), miss, extra, sum(e < 0.05 for e in errors), sum(e < 0.10 for e in errors), every)
            for i, k in enumerate(role):
                roles[f, k] = roles.get((f, k), False) or any(a == i and e < 0.05 for (a, _), e in zip(pairs, errors))
    a = spark.createDataFrame(truth, "frame long, m array<double>, len double, role string")
    b = spark.createDataFrame(found, "frame long, m array<double>, border boolean")
    got = {x["frame"]: (x["n_gt"], x["n_pred"], x["n_match"], x["miss"], x["extra"], x["recovered"], x["ok"], x["all_recovered"]) for x in tracking.score_frames(a, b).collect()}
    assert got == want
    assert {(x["frame"], x["role"]): x["ok"] for x in tracking.recovered_roles(a, b).collect()} == roles


def test_prompt_points_like_numpy(spark):
    r = random.Random(9)
    rows, want = [], {}
    for k in range(40):
        n = r.choice([5, 11, 12, 13, 30, 49])
        pts = [(float(i), 0.5) if r.random() < 0.9 else None for i in range(n)]
        seen = [p for p in pts if p]
        want[k] = [seen[i] for i in np.linspace(4, len(seen) - 5, 7).round().astype(int)] if len(seen) >= 12 else []
        rows.append((k, pts))
    df = spark.createDataFrame(rows, "k long, pts array<struct<x:double,y:double>>")
    got = {x["k"]: [tuple(p) for p in x["q"]] for x in df.select("k", g.prompt_points(F.col("pts"), 7).alias("q")).collect()}
    assert got == want


def test_thinning_against_the_loop(spark):
    r = random.Random(2)
    rows = [(k, f, r.randint(0, 3)) for k in range(3) for f in sorted(r.sample(range(400), 150))]
    got = tracking.thin(spark.createDataFrame(rows, "k long, frame long, p long"), "k", "frame", 7, "p").collect()
    for k in range(3):
        kept = []
        for f, _ in sorted(((f, p) for q, f, p in rows if q == k), key=lambda x: (-x[1], (x[0] + 1) * 2654435761 % (1 << 32))):
            if all(abs(f - o) >= 7 for o in kept):
                kept.append(f)
        assert sorted(x["frame"] for x in got if x["k"] == k) == sorted(kept)


def test_links_against_the_loop(spark):
    r = np.random.default_rng(8)
    rows = [(0, int(f), int(10 * f + i), (r.normal(0, 3, 6) + 40 * i).tolist()) for f in sorted(r.choice(60, 35, replace=False)) for i in range(int(r.integers(1, 4)))]
    got = {x["det_id"]: x["tracklet"] for x in tracking.link(spark.createDataFrame(rows, "video int, frame long, det_id long, m array<double>"), reach=6.0).collect()}
    last, members = [], []
    for _, group in itertools.groupby(rows, key=lambda x: x[1]):
        group = list(group)
        live = [k for k, x in enumerate(last) if group[0][1] - x[1] <= 3]
        pairs = sorted((tracking.midline_distances(np.reshape(a[3], (1, -1, 2)), np.reshape(last[k][3], (1, -1, 2)))[0, 0], i, k) for i, a in enumerate(group) for k in live)
        mine = {}
        for d, i, k in pairs:
            if d <= 6.0 and i not in mine and k not in mine.values():
                mine[i] = k
        for i, a in enumerate(group):
            if i in mine:
                last[mine[i]] = a
                members[mine[i]].append(a[2])
            else:
                last.append(a)
                members.append([a[2]])
    assert got == {i: k for k, m in enumerate(members) if len(m) >= 3 for i in m}
    assert tracking.link_reach(100.0) == 60.0 and tracking.link_reach(1000.0) == 150.0


def test_shown_numbers(spark):
    df = spark.createDataFrame([(1.239,), (None,), (float("nan"),), (12.5,)], "x double")
    assert [x[0] for x in df.select(merging.shown(F.col("x"))).collect()] == ["1.24", "–", "–", "12.50"]


def test_the_mean_without_copies_like_the_loop(spark):
    from kinetrail.operators import series

    r = random.Random(6)
    rows = [(k, f, r.random()) for k in range(2) for f in range(500)]
    got = series.ema(spark.createDataFrame(rows, "k long, f long, v double"), ["k"], "f", "v", 0.9, "e").collect()
    for k in range(2):
        mean = None
        for x, (_, _, v) in zip(sorted((x for x in got if x["k"] == k), key=lambda x: x["f"]), (x for x in rows if x[0] == k), strict=True):
            mean = v if mean is None else 0.9 * mean + (1 - 0.9) * v
            assert x["e"] == mean
