"""Episode export and merge of detections against plain loops over random videos."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.operators import composites, labels, masks, matching

INF = float("inf")


def line(x, y, n=12, jitter=None, step=6.0):
    j = jitter or (lambda: 0.0)
    return [(x + step * i + j(), y + j()) for i in range(n)]


def points(p):
    return [None if q is None else {"x": float(q[0]), "y": float(q[1])} for q in p]


def mean_d(p, q):
    return sum(math.hypot(a[0] - b[0], a[1] - b[1]) for a, b in zip(p, q)) / len(p)


def flip_d(p, q):
    return min(mean_d(p, q), mean_d(p, q[::-1]))


def length(p):
    return sum(math.hypot(a[0] - b[0], a[1] - b[1]) for a, b in itertools.pairwise(p))


def runs_of(frames, gap, least):
    out = []
    for f in sorted(frames):
        if out and f - out[-1][1] <= gap:
            out[-1][1] = f
        else:
            out.append([f, f])
    return [(a, b) for a, b in out if b - a + 1 >= least]


# episodes


def episodes_by_loop(poses, flags, n_frames, fps, area, body, margin, reach, least, gap):
    width = min(max(area / max(body, 1.0), 4.0), 0.15 * body)
    tracks = sorted({t for t, _ in poses})
    frames = range(n_frames)
    d = {}
    for f in frames:
        there = [t for t in tracks if (t, f) in poses]
        for a, b in itertools.combinations(there, 2):
            x = min(math.hypot(p[0] - q[0], p[1] - q[1]) for p in poses[a, f][0] if p for q in poses[b, f][0] if q)
            for t in (a, b):
                d[t, f] = min(d.get((t, f), INF), x)
    contact = {f for (t, f), x in d.items() if x < 1.5 * width} | {f for f in frames if "cluster" in flags[f]}
    for t in tracks:
        mine = sorted(f for u, f in poses if u == t)
        for f0, f1 in itertools.pairwise(mine):
            if 1 < f1 - f0 <= 400 and min(d.get((t, f0), INF), d.get((t, f1), INF)) < 3 * width:
                contact |= set(range(f0 + 1, f1))
    merged = []
    for a, b in runs_of(contact, gap, least):
        if merged and a - merged[-1][1] <= 2 * margin:
            merged[-1] = (merged[-1][0], b)
        else:
            merged.append((a, b))
    out = []
    for e, (a, b) in enumerate(merged, 1):
        rows = []
        for t in tracks:
            if not any((t, f) in poses for f in range(max(0, a - margin), min(n_frames - 1, b + margin) + 1)):
                continue
            clean = {f: d.get((t, f), INF) for u, f in poses if u == t and poses[t, f][1] == "full" and d.get((t, f), INF) >= 3 * width}
            near = [f for f in [*range(a, a - margin - 1, -1), *range(b, b + margin + 1)] if f in clean]
            far = sorted(((x, f) for f, x in clean.items() if a - reach <= f <= b + reach), reverse=True)
            pf = near[0] if near else far[0][1] if far else None
            others = [(u, [None if q is None else (round(q[0], 1), round(q[1], 1)) for q in poses[u, pf][0]]) for u in tracks if u != t and (u, pf) in poses] if pf is not None else []
            rows.append((t, pf, others, round(d[t, pf], 1) if pf is not None and (t, pf) in d else None))
        prompted = [r[1] for r in rows if r[1] is not None]
        out.append((e, a, b, max(0, min([a, *prompted]) - 5), min(n_frames - 1, max([b, *prompted]) + 5), rows, len(prompted) < len(rows)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_episodes_against_the_loop(spark, seed):
    r = random.Random(seed)
    videos, rows, quality, heads = {}, [], [], []
    for v in ("a", "b"):
        n, poses = r.randint(300, 420), {}
        for t in range(3):
            pace = r.uniform(15, 25)
            for f in range(n):
                y = 55.0 * t + 40 * math.sin(f / pace + t)
                if r.random() < 0.9 and not (t == 2 and f % 97 < 20):
                    p = line(10 * t, y, jitter=lambda: r.uniform(-1, 1))
                    if r.random() < 0.2:
                        p[-1] = None
                    poses[t, f] = (p, "full" if r.random() < 0.7 else "head_cut")
        flags = ["cluster;x" if r.random() < 0.01 else "" for _ in range(n)]
        videos[v] = (poses, flags, n)
        rows += [(v, t, f, points(p), s) for (t, f), (p, s) in poses.items()]
        quality += [(v, f, x) for f, x in enumerate(flags)]
        heads.append((v, 20.0, n, 66.0, 700.0))
    poses = spark.createDataFrame(rows, "video string, track int, frame int, pts array<struct<x:double,y:double>>, status string")
    qc = spark.createDataFrame(quality, "video string, frame int, flags string")
    head = spark.createDataFrame(heads, "video string, fps double, n_frames int, median_length double, median_area double")
    got = composites.export_episodes(poses, qc, head, gate=30.0, margin=8, reach=40, least=3, gap=4).collect()
    for v, (p, flags, n) in videos.items():
        want = episodes_by_loop(p, flags, n, 20.0, 700.0, 66.0, 8, 40, 3, 4)
        mine = sorted((x for x in got if x["video"] == v), key=lambda x: x["id"])
        plain = [
            (x["id"], x["start"], x["end"], x["clip_start"], x["clip_end"], [(t["track"], t["prompt_frame"], [(o["track"], [q and (q["x"], q["y"]) for q in o["midline"]]) for o in t["others"]], t["clean_dist"]) for t in x["tracks"]], x["needs_manual_prompt"])
            for x in mine
        ]
        assert plain == want and want
        assert all(x["frames"] == x["end"] - x["start"] + 1 and x["note"].startswith(f"{sum(t['prompt_frame'] is not None for t in x['tracks'])} of {len(x['tracks'])}") for x in mine)


def test_videos_without_contact_have_no_episodes(spark):
    poses = spark.createDataFrame([("a", 0, 0, points(line(0, 0)), "full"), ("a", 1, 0, points(line(0, 900)), "full")], "video string, track int, frame int, pts array<struct<x:double,y:double>>, status string")
    qc = spark.createDataFrame([("a", 0, "")], "video string, frame int, flags string")
    head = spark.createDataFrame([("a", 20.0, 1, 66.0, 700.0)], "video string, fps double, n_frames int, median_length double, median_area double")
    assert composites.export_episodes(poses, qc, head, gate=60.0).count() == 0
    assert composites.export_episodes(poses.limit(0), qc.limit(0), head.limit(0), gate=60.0).count() == 0


# merge


def merge_by_loop(dets, lab, flags, k, body, area, score, new_frames, new_score):
    width = area / body
    found = {f: [d for d in ds if d[1] >= score and 0.6 * body <= length(d[2]) <= 1.3 * body] for f, ds in dets.items()}
    tracklets = []
    for f in sorted(found):
        live = [i for i, t in enumerate(tracklets) if f - t["last"] <= 3]
        pairs = sorted((flip_d(d[2], tracklets[i]["items"][tracklets[i]["last"]][2]), n, i) for n, d in enumerate(found[f]) for i in live)
        used_d, used_t = set(), set()
        for x, n, i in pairs:
            if x <= max(60.0, 0.15 * body) and n not in used_d and i not in used_t:
                tracklets[i]["items"][f], tracklets[i]["last"] = found[f][n], f
                used_d.add(n)
                used_t.add(i)
        tracklets += [{"items": {f: d}, "last": f} for n, d in enumerate(found[f]) if n not in used_d]
    tracklets = [t for t in tracklets if len(t["items"]) >= 3]
    assign, fresh = {}, []
    for i, t in enumerate(tracklets):
        best = None
        for c in range(k):
            ds = [flip_d(d[2], lab[c, f]) for f, d in t["items"].items() if (c, f) in lab]
            if len(ds) >= 3 and np.median(ds) < 0.3 * body and (best is None or np.median(ds) < best[0]):
                best = (np.median(ds), c)
        if best:
            assign[i] = best[1]
        elif len(t["items"]) >= new_frames and np.median([d[1] for d in t["items"].values()]) >= new_score:
            fresh.append(i)
    for j, i in enumerate(fresh):
        assign[i] = k + j
    out, touched = dict(lab), {}
    cands = {}
    for i, c in assign.items():
        for f, d in tracklets[i]["items"].items():
            cands.setdefault((c, f), []).append(d)
    for c, f in sorted(cands):
        _, s, w = max(cands[c, f], key=lambda d: (d[1], -d[0]))
        if (c, f) in out:
            if not flags[f] & {"skeleton_branches", "loop_or_empty", "length_outlier"} or s < 0.5 or flip_d(w, out[c, f]) <= width:
                continue
            kind = "fix"
        else:
            kind = "fill"
        before = [g for g in range(f - 1, f - 30, -1) if (c, g) in out]
        after = [g for g in range(f + 1, f + 30) if (c, g) in out]
        ref = out[c, before[0]] if before else out[c, after[0]] if after else None
        out[c, f] = w if ref is None or mean_d(w, ref) <= mean_d(w[::-1], ref) else w[::-1]
        touched[c, f] = kind
    return out, touched, k + len(fresh)


@pytest.mark.parametrize("seed", range(3))
def test_merge_against_the_loop(spark, seed):
    r = random.Random(seed)
    tables, rows, labs, quality, heads, n = {}, [], [], [], [], 0
    for v, k in (("a", 2), ("b", 1)):
        dets, lab, flags = {}, {}, {}
        for f in range(160):
            flags[f] = {x for x in ("length_outlier", "split") if r.random() < 0.25}
            dets[f] = []
            for t in range(3):
                p = line(0, 220.0 * t + 30 * math.sin(f / 9), jitter=lambda: r.uniform(-2, 2))
                if t < k and r.random() < 0.6 and not 60 < f < 110:
                    q = line(0, 220.0 * t + 30 * math.sin(f / 9) + (40 if r.random() < 0.2 else 0), jitter=lambda: r.uniform(-2, 2))
                    lab[t, f] = q if f % 40 < 20 else q[::-1]
                for _ in range(r.choice([0, 1, 1, 1, 2])):
                    q = [(x, y + r.uniform(-1, 1)) for x, y in p]
                    q = q if r.random() < 0.5 else q[::-1]
                    if r.random() < 0.05:
                        q = line(0, 220.0 * t, step=20.0)
                    dets[f].append((n, round(r.uniform(0.2, 1), 6), q))
                    n += 1
        tables[v] = (dets, lab, flags, k)
        rows += [(v, f, i, [c for p in q for c in p], s) for f, ds in dets.items() for i, s, q in ds]
        labs += [(v, t, f, points(p)) for (t, f), p in lab.items()]
        quality += [(v, f, ";".join(sorted(x, reverse=True)), "-", 9) for f, x in flags.items()]
        heads.append((v, k, 66.0, 66.0 * 12))
    out = composites.merge_detections(
        spark.createDataFrame(rows, "video string, frame int, det_id long, m array<double>, score double"),
        spark.createDataFrame(labs, "video string, track int, frame int, pts array<struct<x:double,y:double>>"),
        spark.createDataFrame(quality, "video string, frame int, flags string, status string, worms long"),
        spark.createDataFrame(heads, "video string, n_tracks int, median_length double, median_area double"),
        new_frames=20,
    )
    got, qc = out["labels"].collect(), out["quality"].collect()
    tracks = {(x["video"], x["track"]): x for x in out["tracks"].collect()}
    counts = {x["video"]: x for x in out["counts"].collect()}
    kinds_seen = set()
    for v, (dets, lab, flags, k) in tables.items():
        want, touched, k2 = merge_by_loop(dets, lab, flags, k, 66.0, 66.0 * 12, 0.3, 20, 0.5)
        mine = {(x["track"], x["frame"]): x for x in got if x["video"] == v}
        assert {key: x["kind"] for key, x in mine.items() if x["kind"]} == touched
        kinds_seen |= set(touched.values())
        assert {key: [(p["x"], p["y"]) for p in x["pts"]] for key, x in mine.items()} == want
        assert all((x["curvature"] is not None) == (x["kind"] is not None) for x in mine.values())
        assert counts[v]["filled"] == sum(x == "fill" for x in touched.values()) and counts[v]["n_tracks"] == k2 > k
        for t in range(k2):
            frames = [f for c, f in want if c == t]
            x = tracks[v, t]
            assert (x["n_frames"], x["first_frame"], x["last_frame"], x["rewritten"]) == (len(frames), min(frames), max(frames), sum(c == t for c, _ in touched))
        for x in (x for x in qc if x["video"] == v):
            kinds = [touched.get((t, x["frame"]), "-") for t in range(k2)]
            assert x["status"].split(";") == kinds
            hit = any(y != "-" for y in kinds)
            assert x["flags"] == (";".join(sorted({*flags[x["frame"]], "from_detections"})) if hit else ";".join(sorted(flags[x["frame"]], reverse=True)))
            assert x["worms"] == (sum(y != "-" for y in kinds) if hit else 9)
    assert kinds_seen == {"fill", "fix"}


def test_chain_keeps_its_predecessor_only_within_reach(spark):
    a, b = line(0, 0), line(0, 0)[::-1]
    schema = "k int, frame int, pts array<struct<x:double,y:double>>"
    lab = spark.createDataFrame([(1, 0, points(a)), (1, 100, points(b))], schema)
    found = spark.createDataFrame([(1, f, points(p), 1.0, f) for f, p in ((1, b), (2, a), (40, a), (60, b), (80, b), (200, b))], schema + ", score double, id long")
    flagged = spark.createDataFrame([], "frame int")
    got = {x["frame"]: (x["kind"], x["flipped"]) for x in labels.fill_and_fix(lab, found, flagged, ["k"], "frame", "pts", "score", "id", 1.0).collect()}
    assert got == {0: (None, False), 1: ("fill", True), 2: ("fill", False), 40: ("fill", False), 60: ("fill", True), 80: ("fill", True), 100: (None, False), 200: ("fill", False)}


# distances and masks


@pytest.mark.parametrize("gate", [5.0, 40.0, 400.0])
def test_gated_distances_are_those_of_all_pairs(spark, gate):
    r = random.Random(1)
    rows = [(f, i, points([None if r.random() < 0.1 else (r.uniform(-300, 300), r.uniform(-300, 300)) for _ in range(r.randint(0, 5))])) for f in range(4) for i in range(25)]
    df = spark.createDataFrame(rows, "frame int, id int, pts array<struct<x:double,y:double>>")
    near = {(x["frame"], x["a"], x["b"]): x["d"] for x in matching.near_distances(df, ["frame"], "id", "pts", gate).collect()}
    every = {}
    for (f, i, p), (g, j, q) in itertools.combinations(rows, 2):
        ds = [math.hypot(a["x"] - b["x"], a["y"] - b["y"]) for a in p if a for b in q if b]
        if f == g and ds and min(ds) < gate:
            every[f, i, j] = min(ds)
    assert near.keys() == every.keys() and all(math.isclose(near[k], every[k]) for k in near)


def test_masks_against_pixels(spark):
    r = random.Random(3)
    rows = [(f, o, r.randint(0, 3), x, x + r.randint(-1, 9)) for f in range(5) for o in range(4) for _ in range(12) for x in [r.randint(-5, 30)] if not (f == 4 and o > 1)]
    dark = [(f, r.randint(0, 3), x, x + r.randint(0, 12)) for f in range(4) for _ in range(10) for x in [r.randint(-5, 30)]]
    objects = [(f, o, [None, 0.7, 1.3, 1.31][o]) for f in range(5) for o in range(4)]
    per_object, per_frame = masks.mask_statistics(spark.createDataFrame(rows, "f int, o int, y int, x0 int, x1 int"), spark.createDataFrame(dark, "f int, y int, x0 int, x1 int"), spark.createDataFrame(objects, "f int, o int, length double"), ["f"], "o", 10.0)
    px = {(f, o): {(y, x) for g, p, y, a, b in rows if (g, p) == (f, o) for x in range(a, b)} for f in range(5) for o in range(4)}
    dk = {f: {(y, x) for g, y, a, b in dark if g == f for x in range(a, b)} for f in range(5)}
    for x in per_object.collect():
        mine = px[x["f"], x["o"]]
        assert x["area"] == len(mine) / 10 and math.isclose(x["inside"], len(mine & dk[x["f"]]) / max(len(mine), 1))
    for x in per_frame.collect():
        assert x["overlap"] == sum(len(px[x["f"], a] & px[x["f"], b]) for a, b in itertools.combinations(range(4), 2)) / 10 and x["n_plausible"] == 2
