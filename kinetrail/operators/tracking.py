"""Inherently sequential operators: grouped pandas functions over one key each (a video, or a frame).

Each function sorts its group itself, so results do not depend on partitioning. A group is one video's detections, or one
frame's; keys are spread over the cluster.
"""

from __future__ import annotations

import bisect
import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def greedy_pairs(cost: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs by ascending finite cost; ties by row, then column."""
    i, j = np.nonzero(np.isfinite(cost))
    out, rows, cols = [], set(), set()
    for k in np.lexsort((j, i, cost[i, j])):
        if i[k] not in rows and j[k] not in cols:
            out.append((int(i[k]), int(j[k])))
            rows.add(i[k])
            cols.add(j[k])
    return out


#: Pairs that are measured at once, those up to which a frame is measured whole, and the first radius of a search for them.
PAIRS, WHOLE, RADIUS = 1 << 21, 1 << 16, 1.0


def greedy_listed(cost: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """greedy_pairs of listed pairs: in rounds, all pairs that come first both for their row and for their column are taken."""
    order = np.lexsort((j, i, cost))
    i, j, rows, cols = i[order], j[order], [], []
    while len(i):
        at = np.arange(len(i))
        (_, row), (_, col) = np.unique(i, return_inverse=True), np.unique(j, return_inverse=True)
        first, second = np.empty(len(i), np.int64), np.empty(len(i), np.int64)
        first[row[::-1]], second[col[::-1]] = at[::-1], at[::-1]
        take = (first[row] == at) & (second[col] == at)
        rows.append(i[take])
        cols.append(j[take])
        stay = ~(np.isin(i, i[take]) | np.isin(j, j[take]))
        i, j = i[stay], j[stay]
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def greedy_near(x: np.ndarray, y: np.ndarray, xs: np.ndarray, ys: np.ndarray, cost) -> tuple[np.ndarray, np.ndarray]:
    """greedy_pairs where a pair costs no less than its distance, without a matrix: all pairs that cost at most a radius come before the others, so
    they are found by squares and settled, then the radius is doubled for what is free. cost(i, j) gives costs of pairs, infinite where there is none.
    Where even the least radius has too many pairs (many components in one place), each row looks for its best free column, as often as that is taken."""
    rows, cols, out, radius = np.arange(len(x)), np.arange(len(xs)), [], RADIUS
    whole = float(max(np.ptp(np.concatenate([x, xs])), np.ptp(np.concatenate([y, ys])))) + 1.0 if len(x) and len(xs) else 0.0
    while len(rows) and len(cols):
        last = len(rows) * len(cols) <= (PAIRS if radius > 256 else min(PAIRS, WHOLE))  # what is left is measured whole
        if last:
            i, j = np.repeat(rows, len(cols)), np.tile(cols, len(rows))
            c = cost(i, j)
            some = np.isfinite(c)
            found = [(c[some], i[some], j[some])]
        else:
            side = radius * (1 + 1e-9)  # a distance that is rounded to the radius is found as well
            a, b = np.floor(xs[cols] / side).astype(np.int64), np.floor(ys[cols] / side).astype(np.int64)
            low, wide = b.min(), int(b.max() - b.min()) + 3
            key = a * wide + (b - low)
            order = np.argsort(key, kind="stable")
            key, p, q = key[order], np.floor(x[rows] / side).astype(np.int64), np.floor(y[rows] / side).astype(np.int64) - low
            fits = (q >= -1) & (q <= wide - 2)
            ranges = [(np.searchsorted(key, (p + k) * wide + np.maximum(q - 1, 0)), np.searchsorted(key, (p + k) * wide + np.minimum(q + 1, wide - 1), "right")) for k in (-1, 0, 1)]
            begin, end = (np.concatenate(z) for z in zip(*ranges, strict=True))
            n, of = np.where(np.tile(fits, 3), end - begin, 0), np.tile(rows, 3)
            found, passed = [], 0
            for part in np.split(np.arange(len(n)), np.flatnonzero(np.diff(np.cumsum(n) // PAIRS)) + 1):
                m = n[part]
                i = np.repeat(of[part], m)
                j = cols[order[np.repeat(begin[part] - (np.cumsum(m) - m), m) + np.arange(m.sum())]]
                c = cost(i, j)
                some = np.flatnonzero(c <= radius)
                found.append((c[some], i[some], j[some]))
                passed += len(some)
                if passed > 4 * PAIRS:
                    break
        if radius > 2 * whole and not last or not last and passed > 4 * PAIRS:
            out.append(greedy_by_row(rows, cols, cost))
            break
        r, k = greedy_listed(*(np.concatenate(z) for z in zip(*found, strict=True)))
        out.append((r, k))
        if last:
            break
        rows, cols, radius = np.setdiff1d(rows, r, True), np.setdiff1d(cols, k, True), 2 * radius
    return tuple(np.concatenate(z) for z in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def greedy_by_row(rows: np.ndarray, cols: np.ndarray, cost) -> tuple[np.ndarray, np.ndarray]:
    """greedy_pairs in memory of rows and columns: the least of the rows' best pairs is taken if its column is free, else its row looks again."""

    def best(i: int) -> tuple[float, int, int] | None:
        c = cost(np.full(len(free), i), free)
        k = int(c.argmin()) if len(c) else 0
        return (float(c[k]), int(i), int(free[k])) if len(c) and np.isfinite(c[k]) else None

    free, taken, found = np.sort(cols), set(), []
    heap = [b for b in map(best, rows) if b]
    heapq.heapify(heap)
    while heap:
        c, i, j = heapq.heappop(heap)
        if j not in taken:
            taken.add(j)
            free = np.delete(free, np.searchsorted(free, j))
            found.append((i, j))
        elif b := best(i):
            heapq.heappush(heap, b)
    r, k = np.array(found, np.int64).reshape(-1, 2).T
    return r, k


def hungarian(cost: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of least total cost (shortest augmenting paths with potentials); every row or every column is assigned."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in hungarian(cost.T))
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, -1)
    for row in range(n):
        least, came, used = np.full(m, np.inf), np.full(m, m), np.zeros(m + 1, bool)
        owner[m], col = row, m
        while True:
            used[col] = True
            i = owner[col]
            slack = cost[i] - u[i] - v[:m]
            better = ~used[:m] & (slack < least)
            least[better], came[better] = slack[better], col
            free = np.where(used[:m], np.inf, least)
            nxt = int(free.argmin())
            delta = free[nxt]
            for k in np.flatnonzero(used):
                u[owner[k]] += delta
                v[k] -= delta
            least[~used[:m]] -= delta
            col = nxt
            if owner[col] < 0:
                break
        while col != m:
            prev = came[col]
            owner[col] = owner[prev]
            col = prev
    return sorted((int(owner[j]), j) for j in range(m) if owner[j] >= 0)


class LiveTracks:
    """Tracks of one video that can still be continued, in the order in which they began: id, last frame, place, area, border."""

    FIELDS = ("ids", "lasts", "xs", "ys", "areas", "borders")

    def __init__(self, gap: int, near: float, far: float, area_log: float, keep: float, state: tuple | None = None):
        self.gap, self.near, self.far, self.area_log, self.keep = gap, near, far, area_log, keep
        self.started, *columns = state or (0, *[[]] * 6)
        self.ids, self.lasts, self.xs, self.ys, self.areas, self.borders = (np.array(c, t) for c, t in zip(columns, (np.int64, np.int64, float, float, float, bool), strict=True))

    def state(self) -> tuple:
        return (self.started, *(getattr(self, c).tolist() for c in self.FIELDS))

    def step(self, frame: int, x: np.ndarray, y: np.ndarray, area: np.ndarray, border: np.ndarray) -> np.ndarray:
        """Track ids of a frame's components."""
        area = np.maximum(area, 1e-9)
        kept = frame - self.lasts <= self.gap
        for c in self.FIELDS:
            setattr(self, c, getattr(self, c)[kept])
        wait = frame - self.lasts
        gate = np.where(wait == 1, self.near, self.far)

        def cost(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            d = np.hypot(x[i] - self.xs[j], y[i] - self.ys[j])
            ratio = np.abs(np.log(area[i] / self.areas[j]))
            ok = (wait[j] > 0) & (d < gate[j]) & ((ratio <= self.area_log) | border[i] | self.borders[j])
            return np.where(ok, d + 0.5 * wait[j] + 200 * ratio, np.inf)

        if len(x) * len(wait) <= WHOLE:
            i, j = np.array(greedy_pairs(cost(np.arange(len(x))[:, None], np.arange(len(wait))[None])), np.int64).reshape(-1, 2).T
        else:  # places that are not numbers have no partner
            r, k = np.flatnonzero(np.isfinite(x) & np.isfinite(y)), np.flatnonzero(np.isfinite(self.xs) & np.isfinite(self.ys))
            i, j = greedy_near(x[r], y[r], self.xs[k], self.ys[k], lambda a, b: cost(r[a], k[b]))
            i, j = r[i], k[j]
        out = np.full(len(x), -1, np.int64)
        out[i] = self.ids[j]
        self.lasts[j], self.xs[j], self.ys[j], self.borders[j] = frame, x[i], y[i], border[i]
        whole = ~border[i]  # a body that the border cuts tells nothing of its area
        self.areas[j[whole]] = self.keep * self.areas[j[whole]] + (1 - self.keep) * area[i[whole]]
        new = np.flatnonzero(out < 0)
        out[new] = self.started + np.arange(len(new))
        self.started += len(new)
        for c, v in zip(self.FIELDS, (out[new], np.full(len(new), frame), x[new], y[new], area[new], border[new]), strict=True):
            setattr(self, c, np.concatenate([getattr(self, c), v]))
        return out

    def run(self, pdf: pd.DataFrame) -> np.ndarray:
        """Track ids of components that are sorted by frame."""
        frames, border = pdf["frame"].to_numpy(np.int64), pdf["border"].to_numpy(bool)
        x, y, area = pdf[["cx", "cy", "area"]].to_numpy(float).T
        parts = np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(frames)) + 1) if len(pdf) else []
        return np.concatenate([np.zeros(0, np.int64), *(self.step(int(frames[r[0]]), x[r], y[r], area[r], border[r]) for r in parts)])


def track(df: DataFrame, video: str = "video", gap: int = 200, near: float = 150.0, far: float = 450.0, area_log: float = 0.7, keep: float = 0.9) -> DataFrame:
    """Track ids for components (frame, comp_id, cx, cy, area, border) of each video, in frame order: candidates within the
    gate (near for the next frame, far after a gap) and of similar area unless a border is involved, taken by ascending
    d + gap / 2 + 200 |log area ratio|; what remains starts a track. A track's area is a running mean over components off the border."""

    def run(batches):
        now = tracker = rest = None

        def ids(pdf: pd.DataFrame) -> pd.DataFrame:
            nonlocal now, tracker
            parts = []
            for rows in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(pd.factorize(pdf[video], use_na_sentinel=False)[0])) + 1) if len(pdf) else []:
                key = pdf[video].iloc[rows[0]]
                if tracker is None or not (key == now or (pd.isna(key) and pd.isna(now))):
                    now, tracker = key, LiveTracks(gap, near, far, area_log, keep)
                parts.append(tracker.run(pdf.iloc[rows]))
            return pd.DataFrame({video: pdf[video], "frame": pdf["frame"], "comp_id": pdf["comp_id"], "track_id": np.concatenate([np.zeros(0, np.int64), *parts])})

        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            ends = np.flatnonzero(np.diff(pd.factorize(pdf[video], use_na_sentinel=False)[0]) | np.diff(pdf["frame"].to_numpy()))
            done = int(ends[-1]) + 1 if len(ends) else 0  # the last frame may go on in the next batch
            yield ids(pdf.iloc[:done])
            rest = pdf.iloc[done:]
        if rest is not None:
            yield ids(rest)

    kinds = dict(df.dtypes)
    # sorted by Spark and read in batches: a task holds one frame and the tracks that live; small videos stay in tasks of their own
    rows = df.select(video, "frame", "comp_id", "cx", "cy", "area", "border").repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), video).sortWithinPartitions(video, "frame", "comp_id")
    return rows.mapInPandas(run, f"{video} {kinds[video]}, frame {kinds['frame']}, comp_id {kinds['comp_id']}, track_id long")


def link_reach(body: float) -> float:
    """How far apart midlines of one body may be in following frames."""
    return max(60.0, 0.15 * body)


def midline_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Flip-invariant mean point distances of midlines a (n, p, 2) and b (m, p, 2)."""
    one = np.sqrt(((a[:, None] - b[None]) ** 2).sum(-1)).mean(-1)
    two = np.sqrt(((a[:, None] - b[None, :, ::-1]) ** 2).sum(-1)).mean(-1)
    return np.minimum(one, two)


def _midlines(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(m, float).reshape(-1, 2) for m in column])


def link(df: DataFrame, video: str = "video", gap: int = 3, reach: float | str = 60.0, least: int = 3) -> DataFrame:
    """Tracklets of detections (frame, det_id, m): each frame's detections join the live tracklets by ascending midline distance; short ones are left out. reach may name a column that is the same for all of a video."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "det_id"], kind="stable").reset_index(drop=True)
        m = _midlines(pdf["m"]) if len(pdf) else np.zeros((0, 1, 2))
        ids, last = np.zeros(len(pdf), np.int64), []
        far = pdf[reach].iloc[0] if isinstance(reach, str) else reach
        frames = pdf["frame"].to_numpy()
        for rows in np.split(np.arange(len(pdf)), np.flatnonzero(np.diff(frames)) + 1) if len(pdf) else []:
            live = [k for k, r in enumerate(last) if frames[rows[0]] - frames[r] <= gap]
            taken = {}
            if live:
                cost = midline_distances(m[rows], m[[last[k] for k in live]])
                cost[cost > far] = np.inf
                taken = {i: live[c] for i, c in greedy_pairs(cost)}
            for i, r in enumerate(rows):
                k = taken.get(i)
                if k is None:
                    k = len(last)
                    last.append(r)
                last[k], ids[r] = r, k
        out = pd.DataFrame({video: pdf[video], "frame": pdf["frame"], "det_id": pdf["det_id"], "tracklet": ids})
        return out[out.groupby("tracklet")["frame"].transform("size") >= least] if len(out) else out

    kinds = dict(df.dtypes)
    return df.groupBy(video).applyInPandas(run, f"{video} {kinds[video]}, frame {kinds['frame']}, det_id {kinds['det_id']}, tracklet long")


def suppress(df: DataFrame, frame: str = "frame", floor: float = 0.0, cutoff: float = 1.0, overlap: float = 0.5) -> DataFrame:
    """Non-maximum suppression per frame: by descending score (ties: id), a detection goes if an accepted one has its
    centre within cutoff and a squared latent distance below -log(overlap). Columns: det_id, score, cx, cy, latent."""
    bound = -np.log(overlap)

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["score"] > floor].sort_values(["score", "det_id"], ascending=[False, True], kind="stable")
        keep: list[int] = []
        xy = pdf[["cx", "cy"]].to_numpy(float)
        latent = np.stack([np.asarray(v, float) for v in pdf["latent"]]) if len(pdf) else np.zeros((0, 1))
        for i in range(len(pdf)):
            if keep:
                near = np.hypot(*(xy[keep] - xy[i]).T) < cutoff
                if (near & (((latent[keep] - latent[i]) ** 2).sum(1) < bound)).any():
                    continue
            keep.append(i)
        return pdf.iloc[keep][[frame, "det_id", "score"]]

    kinds = dict(df.dtypes)
    return df.groupBy(frame).applyInPandas(run, f"{frame} {kinds[frame]}, det_id {kinds['det_id']}, score double")


def cluster_detections(df: DataFrame, frame: str = "frame", reach: float = 60.0) -> DataFrame:
    """Greedy clusters per frame: by descending score (ties: id), a detection joins the first cluster whose first member is within reach."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "det_id"], ascending=[False, True], kind="stable").reset_index(drop=True)
        m = _midlines(pdf["m"]) if len(pdf) else np.zeros((0, 1, 2))
        first: list[int] = []
        out = np.zeros(len(pdf), np.int64)
        for i in range(len(pdf)):
            hit = np.flatnonzero(midline_distances(m[i : i + 1], m[first])[0] <= reach) if first else []
            if len(hit):
                out[i] = hit[0]
            else:
                out[i] = len(first)
                first.append(i)
        return pd.DataFrame({frame: pdf[frame], "det_id": pdf["det_id"], "cluster": out})

    kinds = dict(df.dtypes)
    return df.groupBy(frame).applyInPandas(run, f"{frame} {kinds[frame]}, det_id {kinds['det_id']}, cluster long")


def distinct_midlines(df: DataFrame, frame: str = "frame", reach: float = 6.0) -> DataFrame:
    """df without the midlines that lie within reach of one before them (by score, then id) that stays."""
    c = cluster_detections(df, frame, reach).join(df.select(frame, "det_id", "score"), [frame, "det_id"])
    first = c.groupBy(frame, "cluster").agg(F.max_by("det_id", F.struct("score", -F.col("det_id"))).alias("det_id"))
    return df.join(first.select(frame, "det_id"), [frame, "det_id"], "left_semi")


def matched(truth: pd.DataFrame, found: pd.DataFrame) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(optimal pairs, their distances relative to the mean true length) of one frame."""
    if not len(truth) or not len(found):
        return [], np.zeros(0)
    cost = midline_distances(_midlines(truth["m"]), _midlines(found["m"]))
    pairs = hungarian(cost)
    return pairs, np.array([cost[i, j] for i, j in pairs]) / truth["len"].to_numpy(float).mean()


def score_frames(truth: DataFrame, found: DataFrame, frame: str = "frame", recovered: float = 0.05, ok: float = 0.10) -> DataFrame:
    """Per frame: assignment of found to true midlines of least total distance; errors relative to the frame's mean true
    length. miss and extra are what is left without partner (extras at the border are not counted); all_recovered: neither
    of these, and all errors below `recovered`. Columns truth: m, len; found: m, border."""

    def run(key, t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        pairs, err = matched(t, p)
        used = {j for _, j in pairs}
        extra = sum(1 for j, b in enumerate(p["border"]) if j not in used and not b) if len(p) else 0
        miss, good = len(t) - len(pairs), int((err < recovered).sum())
        row = {frame: key[0], "n_gt": len(t), "n_pred": len(p), "n_match": len(pairs), "miss": miss, "extra": extra, "recovered": good, "ok": int((err < ok).sum()), "all_recovered": bool(len(t) and not miss and not extra and good == len(pairs)), "err_mean": float(err.mean()) if len(err) else None}
        return pd.DataFrame([row])

    kind = dict(truth.dtypes)[frame]
    return truth.groupBy(frame).cogroup(found.groupBy(frame)).applyInPandas(run, f"{frame} {kind}, n_gt long, n_pred long, n_match long, miss long, extra long, recovered long, ok long, all_recovered boolean, err_mean double")


def recovered_roles(truth: DataFrame, found: DataFrame, frame: str = "frame", role: str = "role", recovered: float = 0.05) -> DataFrame:
    """Per frame and role of a true midline: whether one of that role has a partner with an error below `recovered`."""

    def run(key, t: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        pairs, err = matched(t, p)
        hit = np.zeros(len(t), bool)
        hit[[i for (i, _), e in zip(pairs, err, strict=True) if e < recovered]] = True
        out = pd.DataFrame({role: t[role].to_numpy(), "ok": hit}).groupby(role, as_index=False)["ok"].max()
        return out.assign(**{frame: key[0]})[[frame, role, "ok"]]

    kinds = dict(truth.dtypes)
    return truth.groupBy(frame).cogroup(found.groupBy(frame)).applyInPandas(run, f"{frame} {kinds[frame]}, {role} {kinds[role]}, ok boolean")


def thin(df: DataFrame, key: str, frame: str, gap: int, priority: str) -> DataFrame:
    """Rows of each key so that all kept frames are at least `gap` apart, taken by descending priority (ties: a hash order of the frame)."""

    def run(k, pdf: pd.DataFrame) -> pd.DataFrame:
        mixed = (pdf[frame].to_numpy(np.uint64) + np.uint64(1)) * np.uint64(2654435761) % np.uint64(1 << 32)
        frames = pdf[frame].to_numpy()
        kept: list[int] = []
        taken: list[int] = []  # kept frames, sorted
        for i in np.lexsort((mixed, -pdf[priority].to_numpy(float))):
            at = bisect.bisect_left(taken, frames[i])
            if all(abs(frames[i] - f) >= gap for f in taken[max(0, at - 1) : at + 1]):
                taken.insert(at, frames[i])
                kept.append(i)
        return pdf.iloc[sorted(kept)]

    return df.groupBy(key).applyInPandas(run, df.schema)
