"""Smoothing splines of midlines, for all midlines of an Arrow batch at once.

A midline is a cubic B-spline on uniform knots over its normalised chord length, fitted by least squares with a penalty on
second differences of its coefficients. The penalty is the greatest one whose sum of squared residuals stays within `smooth`
(the discrepancy rule), found by bisection for all midlines together; every step is one banded factorisation over the batch.

Against fits that place knots one by one: within `smooth` both are equally near to the points, but this one is smooth between them
everywhere, tends to a straight line (not to a cubic) as smooth grows, and can follow no more than COEFFICIENTS - 3 bends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

COEFFICIENTS, SAMPLES, LEAST = 24, 500, 8
BAND = 3
MANY = 1024  # midlines that are fitted at once, in some MB; those of a whole batch would take hundreds


def weights(u: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first coefficient, the four weights) of the cubic basis at each u of 0..1."""
    x = np.clip(u, 0, 1) * (k - 3)
    j = np.minimum(x.astype(np.int64), k - 4)
    t = (x - j)[:, None]
    w = np.concatenate([(1 - t) ** 3, 3 * t**3 - 6 * t**2 + 4, -3 * t**3 + 3 * t**2 + 3 * t + 1, t**3], axis=1) / 6
    return j, w


def penalty(k: int) -> np.ndarray:
    """Bands (k, 4) of D'D for second differences D; entry [i, d] belongs to row i + d and column i."""
    d = np.diff(np.eye(k), 2, axis=0)
    p = d.T @ d
    return np.stack([np.concatenate([np.diagonal(p, -b), np.zeros(b)]) for b in range(BAND + 1)], axis=1)


def solve(bands: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solutions (n, k, m) of n symmetric positive definite systems with bands (n, k, 4) and right sides (n, k, m)."""
    n, k, _ = bands.shape
    low, diag, x = np.zeros((n, k, BAND + 1)), np.zeros((n, k)), right.copy()
    for i in range(k):
        first = max(0, i - BAND)
        for j in range(first, i):
            v = bands[:, j, i - j] - sum((low[:, i, i - m] * low[:, j, j - m] * diag[:, m] for m in range(max(first, j - BAND), j)), np.zeros(n))
            low[:, i, i - j] = v / diag[:, j]
        diag[:, i] = bands[:, i, 0] - sum((low[:, i, i - m] ** 2 * diag[:, m] for m in range(first, i)), np.zeros(n))
        for m in range(first, i):
            x[:, i] -= low[:, i, i - m, None] * x[:, m]
    x /= diag[:, :, None]
    for i in range(k - 1, -1, -1):
        for m in range(i + 1, min(k, i + BAND + 1)):
            x[:, i] -= low[:, m, m - i, None] * x[:, m]
    return x


def fit(points: np.ndarray, sizes: np.ndarray, smooth: np.ndarray, k: int = COEFFICIENTS) -> np.ndarray:
    """Coefficients (n, k, 2) of n midlines, whose points follow one another."""
    n = len(sizes)
    owner = np.repeat(np.arange(n), sizes)
    first = np.cumsum(sizes) - sizes
    step = np.zeros(len(points))
    step[1:] = np.hypot(*(points[1:] - points[:-1]).T)
    step[first] = 0
    along = np.concatenate([np.zeros(0), *[np.cumsum(s) for s in np.split(step, first[1:])]])  # apart, so that none's rounding depends on those before it
    total = np.bincount(owner, step, n)
    j, w = weights(along / np.maximum(total, 1e-12)[owner], k)
    gram, right = np.zeros((n, k, BAND + 1)), np.zeros((n, k, 2))
    for a in range(4):
        np.add.at(right, (owner, j + a), w[:, a, None] * points)
        for b in range(a, 4):
            np.add.at(gram, (owner, j + a, b - a), w[:, a] * w[:, b])
    square = np.bincount(owner, (points**2).sum(1), n)
    p = penalty(k)
    tiny = 1e-9 * np.maximum(gram[:, :, 0].sum(1) / k, 1e-9)

    def of(log: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        bands = gram + (10.0**log)[:, None, None] * p
        bands[:, :, 0] += tiny[:, None]
        c = solve(bands, right)
        held = (c**2 * gram[:, :, :1]).sum((1, 2)) + 2 * sum((c[:, d:] * c[:, : k - d] * gram[:, : k - d, d, None]).sum((1, 2)) for d in range(1, BAND + 1))
        return c, square - 2 * (c * right).sum((1, 2)) + held

    low, high = np.full(n, -6.0), np.full(n, 8.0)
    for _ in range(40):
        mid = (low + high) / 2
        inside = of(mid)[1] <= smooth
        low, high = np.where(inside, mid, low), np.where(inside, high, mid)
    return of(low)[0]


def resampled(coefficients: np.ndarray, n: int, samples: int = SAMPLES) -> tuple[np.ndarray, np.ndarray]:
    """(n points at equal arc distances, length) of each spline, from `samples` points on it."""
    j, w = weights(np.linspace(0, 1, samples), coefficients.shape[1])
    xy = sum(w[:, a, None] * coefficients[:, j + a] for a in range(4))
    along = np.concatenate([np.zeros((len(xy), 1)), np.cumsum(np.hypot(*np.moveaxis(np.diff(xy, axis=1), -1, 0)), axis=1)], axis=1)
    length = along[:, -1]
    unit = along / np.maximum(length, 1e-12)[:, None]
    want = np.linspace(0, 1, n)
    at = np.stack([np.clip(np.searchsorted(u, want, "right") - 1, 0, samples - 2) for u in unit]) if len(unit) else np.zeros((0, n), np.int64)
    a, b = np.take_along_axis(unit, at, 1), np.take_along_axis(unit, at + 1, 1)
    t = np.clip((want - a) / np.maximum(b - a, 1e-15), 0, 1)[..., None]
    return np.take_along_axis(xy, at[..., None], 1) * (1 - t) + np.take_along_axis(xy, at[..., None] + 1, 1) * t, length


def splines_of(lines: pa.Array, bounds: pa.Array, n: int) -> pa.Array:
    """struct(pts, length) of an Arrow array of midlines (lists of points)."""
    ends = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lines), 0).to_numpy(zero_copy_only=False))]).astype(np.int64)
    p = lines.flatten()
    rows = np.stack([pc.fill_null(pc.struct_field(p, c).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False) for c in ("x", "y")], axis=1)  # the fields of a null point are null
    ok = np.array([b - a >= LEAST and np.isfinite(rows[a:b]).all() and bool((rows[a:b] != rows[a]).any()) for a, b in zip(ends[:-1], ends[1:], strict=True)], bool)
    keep = np.flatnonzero(ok)
    out, lengths = np.zeros((0, n, 2)), np.full(len(ok), np.nan)
    if len(keep):
        points = np.concatenate([rows[ends[i] : ends[i + 1]] for i in keep])
        out, lengths[keep] = resampled(fit(points, np.diff(ends)[keep], bounds.to_numpy(zero_copy_only=False).astype(float)[keep]), n)
    flat = out.reshape(-1, 2)
    xy = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(flat[:, 0])), pa.array(np.ascontiguousarray(flat[:, 1]))], ["x", "y"])
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(ok, n, 0))]), pa.int32()), xy)
    return pa.StructArray.from_arrays([lists, pa.array(lengths)], ["pts", "length"], mask=pa.array(~ok))


def smooth_resample(df: DataFrame, pts: str, n: int, smooth: Column | None = None, out: str = "spline") -> DataFrame:
    """df with a struct (pts, length): the smoothing spline of each midline at n points of equal arc distance. smooth bounds the sum of
    squared residuals (twice the number of points where None or null). Null for fewer than eight points, hidden ones, or no length."""
    usual = 2.0 * F.size(pts)
    rows = df.withColumn("__bound", F.coalesce(smooth.cast("double"), usual) if smooth is not None else usual)
    spline = T.StructType([T.StructField("pts", T.ArrayType(T.StructType([T.StructField(c, T.DoubleType()) for c in "xy"]))), T.StructField("length", T.DoubleType())])
    schema = T.StructType([f for f in df.schema if f.name != out] + [T.StructField(out, spline)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(a, MANY) for whole in batches for a in range(0, whole.num_rows, MANY)):
            found = splines_of(batch.column(pts), batch.column("__bound"), n)
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in schema if f.name != out] + [found], [f.name for f in schema])

    return rows.mapInArrow(run, schema)
