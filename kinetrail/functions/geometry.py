"""Functions on midlines: columns of array<struct<x,y>> whose hidden points are null.

All are built-in expressions (no Python per row). Where a value is used several times it is bound with `let`, so that no
lambda evaluates it again for each element.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def index(n: Column) -> Column:
    """0..n-1; empty for n < 1."""
    return F.when(n > 0, F.sequence(F.lit(0), (n - 1).cast("int"))).otherwise(F.array().cast("array<int>"))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def points(flat: Column) -> Column:
    """x0,y0,x1,y1,... as points."""
    return let(flat, lambda m: F.transform(index(F.size(m) / 2), lambda i: F.struct(F.get(m, 2 * i).alias("x"), F.get(m, 2 * i + 1).alias("y"))))


def hidden_null(pts: Column) -> Column:
    """NaN coordinates (hidden points) to null points, once, at ingest."""
    return F.transform(pts, lambda p: F.when(~(F.isnan(p["x"]) | F.isnan(p["y"])), p))


def dist(p: Column, q: Column) -> Column:
    return F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))


def steps(pts: Column) -> Column:
    """Lengths of the segments."""
    return let(pts, lambda p: F.transform(index(F.size(p) - 1), lambda i: dist(F.get(p, i + 1), F.get(p, i))))


def arc_length(pts: Column) -> Column:
    return total(steps(pts))


def mean_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, dist)) / F.size(a)


def flip_distance(a: Column, b: Column) -> Column:
    """Mean point distance, whichever way round b is."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.least(mean_distance(s["a"], s["b"]), mean_distance(s["a"], F.reverse(s["b"]))))


def min_distance(a: Column, b: Column) -> Column:
    """Least distance of any point of a from any point of b; null points are left out."""
    return F.array_min(F.flatten(F.transform(a, lambda p: F.transform(b, lambda q: dist(p, q)))))


def orient_like(pts: Column, ref: Column) -> Column:
    """pts, reversed if that is nearer to ref; unchanged without a ref."""
    return F.when(ref.isNull() | (mean_distance(pts, ref) <= mean_distance(F.reverse(pts), ref)), pts).otherwise(F.reverse(pts))


def continuity(pts: Column, prev: Column, head_at_edge: Column, tail_at_edge: Column) -> Column:
    """Costs (same, flip) of keeping or reversing pts after prev: distances of the ends, or, where exactly one end is cut by
    the edge, of the free end alone."""
    first, last, before, behind = F.element_at(pts, 1), F.element_at(pts, -1), F.element_at(prev, 1), F.element_at(prev, -1)
    both = F.struct((dist(first, before) + dist(last, behind)).alias("same"), (dist(first, behind) + dist(last, before)).alias("flip"))
    head_cut = F.struct(dist(last, behind).alias("same"), dist(last, before).alias("flip"))
    tail_cut = F.struct(dist(first, before).alias("same"), dist(first, behind).alias("flip"))
    return F.when(head_at_edge & ~tail_at_edge, head_cut).when(tail_at_edge & ~head_at_edge, tail_cut).otherwise(both)


def centroid(pts: Column) -> Column:
    """Mean of the visible points."""
    return let(F.filter(pts, lambda p: p.isNotNull()), lambda v: F.when(F.size(v) > 0, F.struct((total(F.transform(v, lambda p: p["x"])) / F.size(v)).alias("x"), (total(F.transform(v, lambda p: p["y"])) / F.size(v)).alias("y"))))


def visible(pts: Column) -> Column:
    return F.size(F.filter(pts, lambda p: p.isNotNull()))


def all_visible(pts: Column, first: int = 0, last: int | None = None) -> Column:
    part = pts if last is None else F.slice(pts, first + 1, last - first + 1)
    return F.forall(part, lambda p: p.isNotNull())


def with_lengths(pts: Column) -> Column:
    """Points p and the arc length cs at each."""
    cs = F.aggregate(steps(pts), F.array(F.lit(0.0)), lambda acc, d: F.concat(acc, F.array(F.element_at(acc, -1) + d)))
    return F.struct(pts.alias("p"), cs.alias("cs"))


def at_length(s: Column, t: Column) -> Column:
    """The point of s (from with_lengths) at arc length t."""
    end = F.greatest(F.least(F.size(F.filter(s["cs"], lambda c: c <= t)), F.size(s["cs"]) - 1), F.lit(1))  # of the segment

    def between(v: Column) -> Column:
        c, a, b = v["c"], v["a"], v["b"]
        w = F.when(v["d"] > c, (t - c) / (v["d"] - c)).otherwise(F.lit(0.0))
        return let(w, lambda w: F.struct((a["x"] + (b["x"] - a["x"]) * w).alias("x"), (a["y"] + (b["y"] - a["y"]) * w).alias("y")))

    return let(let(end, lambda j: F.struct(F.get(s["cs"], j - 1).alias("c"), F.get(s["cs"], j).alias("d"), F.get(s["p"], j - 1).alias("a"), F.get(s["p"], j).alias("b"))), between)


def resample(pts: Column, n: int) -> Column:
    """n points at equal arc distances, by linear interpolation; end points are kept."""

    def run(s: Column) -> Column:
        return let(F.element_at(s["cs"], -1), lambda length: F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: let(k * length / (n - 1), lambda t: at_length(s, t))))

    return F.when(F.size(pts) > 1, let(with_lengths(pts), run))


def reflected(i: Column, n: Column) -> Column:
    """Index i of a sequence of n mirrored at its ends, end samples included (any i)."""
    m = F.pmod(i, 2 * n)
    return F.when(m < n, m).otherwise(2 * n - 1 - m)


def filter1d(values: Column, weights: list[float]) -> Column:
    """Weighted sum around each element, reflected at the ends; the window of an even count reaches one more to the left."""
    left = len(weights) // 2

    def run(v: Column) -> Column:
        n = F.size(v)

        def at(i: Column) -> Column:
            out = F.lit(0.0)
            for k, w in enumerate(weights):
                out = out + F.lit(float(w)) * F.get(v, reflected(i + (k - left), n).cast("int"))
            return out

        return F.transform(index(n), at)

    return let(values, run)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    radius = int(truncate * sigma + 0.5)
    w = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def gradient(values: Column) -> Column:
    """Central differences, one-sided at the ends."""

    def run(v: Column) -> Column:
        n = F.size(v)
        return F.transform(v, lambda x, i: F.when(i == 0, F.get(v, i + 1) - x).when(i == n - 1, x - F.get(v, i - 1)).otherwise((F.get(v, i + 1) - F.get(v, i - 1)) / 2.0))

    return let(values, run)


def curvature(pts: Column, sigma: float = 1.5) -> Column:
    """Signed curvature times length along a midline smoothed by a Gaussian; null where the speed is zero."""
    w = gaussian_weights(sigma)

    def parts(p: Column) -> Column:
        x, y = filter1d(F.transform(p, lambda q: q["x"]), w), filter1d(F.transform(p, lambda q: q["y"]), w)
        return F.struct(x.alias("x"), y.alias("y"), arc_length(p).alias("len"))

    def first(s: Column) -> Column:
        return F.struct(gradient(s["x"]).alias("dx"), gradient(s["y"]).alias("dy"), s["len"].alias("len"))

    def second(s: Column) -> Column:
        return F.struct(s["dx"].alias("dx"), s["dy"].alias("dy"), gradient(s["dx"]).alias("ddx"), gradient(s["dy"]).alias("ddy"), s["len"].alias("len"))

    def kappa(s: Column) -> Column:
        def at(dx: Column, i: Column) -> Column:
            dy, ddx, ddy = F.get(s["dy"], i), F.get(s["ddx"], i), F.get(s["ddy"], i)
            return F.try_divide((dx * ddy - dy * ddx) * s["len"], F.pow(dx * dx + dy * dy, 1.5))

        return F.transform(s["dx"], at)

    return let(let(let(let(pts, parts), first), second), kappa)


def zero_crossings(values: Column) -> Column:
    """Places, with linear interpolation, where the sign changes from one element to the next."""

    def run(v: Column) -> Column:
        cross = F.filter(index(F.size(v) - 1), lambda i: (F.get(v, i) < 0) != (F.get(v, i + 1) < 0))
        return F.transform(cross, lambda i: i + F.get(v, i) / (F.get(v, i) - F.get(v, i + 1)))

    return let(values, run)


def wavelength(values: Column) -> Column:
    """Twice the mean spacing of the zero crossings, in elements; null with fewer than two."""
    return let(zero_crossings(values), lambda z: F.when(F.size(z) >= 2, 2 * (F.element_at(z, -1) - F.get(z, 0)) / (F.size(z) - 1)))


def amplitude(pts: Column) -> Column:
    """Half the extent across the principal axis."""

    def centred(p: Column) -> Column:
        c = centroid(p)
        return F.transform(p, lambda q: F.struct((q["x"] - c["x"]).alias("u"), (q["y"] - c["y"]).alias("v")))

    def across(p: Column) -> Column:
        uu, vv, uv = (total(F.transform(p, f)) for f in (lambda q: q["u"] * q["u"], lambda q: q["v"] * q["v"], lambda q: q["u"] * q["v"]))
        return let(0.5 * F.atan2(2 * uv, uu - vv), lambda t: let(F.transform(p, lambda q: -q["u"] * F.sin(t) + q["v"] * F.cos(t)), lambda w: (F.array_max(w) - F.array_min(w)) / 2.0))

    return let(let(pts, centred), across)


def tangent(pts: Column, head: int, tail: int) -> Column:
    """Unit vector from point `tail` to point `head`."""
    a, b = F.get(pts, F.lit(head)), F.get(pts, F.lit(tail))
    n = F.hypot(a["x"] - b["x"], a["y"] - b["y"])
    return F.struct(F.try_divide(a["x"] - b["x"], n).alias("x"), F.try_divide(a["y"] - b["y"], n).alias("y"))


def rigid(pts: Column, angle: Column, dx: Column, dy: Column) -> Column:
    """Rotation about the centroid, then a shift."""
    turn = lambda s: F.transform(s["p"], lambda q: F.struct((s["c"]["x"] + (q["x"] - s["c"]["x"]) * F.cos(s["t"]) - (q["y"] - s["c"]["y"]) * F.sin(s["t"]) + s["dx"]).alias("x"), (s["c"]["y"] + (q["x"] - s["c"]["x"]) * F.sin(s["t"]) + (q["y"] - s["c"]["y"]) * F.cos(s["t"]) + s["dy"]).alias("y")))
    return let(F.struct(pts.alias("p"), centroid(pts).alias("c"), angle.alias("t"), dx.alias("dx"), dy.alias("dy")), turn)


def end_statuses(length: Column, body: Column, head_at_edge: Column, tail_at_edge: Column, tolerance: float = 0.05) -> Column:
    """Which part of a body of length `body` a visible midline of `length` is: full, head_cut, tail_cut, both_ends_cut or visible_longer_than_body."""
    return F.when(~head_at_edge & ~tail_at_edge, "full").when(head_at_edge & tail_at_edge, "both_ends_cut").when(length > body * (1 + tolerance), "visible_longer_than_body").when(tail_at_edge, "tail_cut").otherwise("head_cut")


def arc_labels(pts: Column, body: Column, status: Column, n: int) -> Column:
    """n points at equal arc distances of the whole body; those beyond the visible midline are null. A cut head is counted from the tail on."""

    def run(s: Column) -> Column:
        seen = F.element_at(s["line"]["cs"], -1)
        exact = lambda t: F.when(F.abs(t) < 1e-9, F.lit(0.0)).when(F.abs(t - seen) < 1e-9, seen).otherwise(t)  # noqa: E731  ends are hit despite rounding
        place = lambda k: F.when(s["status"] == "full", k * seen / (n - 1)).when(s["status"] == "head_cut", seen - (n - 1 - k) * s["body"] / (n - 1)).otherwise(k * s["body"] / (n - 1))
        return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: let(let(place(k), exact), lambda t: F.when((t >= 0) & (t <= seen), at_length(s["line"], t))))

    placed = let(F.struct(with_lengths(pts).alias("line"), body.alias("body"), status.alias("status")), run)
    nothing = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lit(None).cast("struct<x:double,y:double>"))
    return F.when(status.isin("both_ends_cut", "visible_longer_than_body"), nothing).otherwise(placed)


def evenly(n: Column, k: int | Column) -> Column:
    """k places of 0..n-1 at equal distances, ends included, truncated; all of them where n <= k."""
    k = F.lit(k)
    return F.when(n <= k, index(n)).otherwise(F.transform(index(k), lambda i: F.floor(i * (n - 1) / F.greatest(k - 1, F.lit(1))).cast("int")))


def rounded_places(first: Column, last: Column, n: int) -> Column:
    """n places from first to last at equal distances, rounded half to even."""
    step = (last - first) / max(n - 1, 1)
    return F.transform(index(F.lit(n)), lambda i: F.bround(first + i * step, 0).cast("int"))


def prompt_points(pts: Column, n: int, margin: int = 4, least: int = 12) -> Column:
    """n visible points spread along a midline without its tips: `margin` visible points at each end are left out. None below `least` visible points."""
    nothing = F.array().cast("array<struct<x:double,y:double>>")
    return let(
        F.filter(pts, lambda p: p.isNotNull()),
        lambda v: F.when(F.size(v) < least, nothing).otherwise(F.transform(rounded_places(F.lit(float(margin)), F.size(v) - 1.0 - margin, n), lambda i: F.get(v, i))),
    )


def at_edge(p: Column, width: Column, height: Column, edge: float = 40.0) -> Column:
    """Whether a point lies within `edge` of the frame's border."""
    return edge_distance(p, width, height) <= edge


def edge_distance(p: Column, width: Column, height: Column) -> Column:
    """Distance of a point from the nearest border of its frame."""
    return F.least(p["x"], p["y"], width - 1 - p["x"], height - 1 - p["y"])


def end_widths(profile: Column, part: int = 5) -> Column:
    """Mean widths (head, tail) of the first and last `part` points of a width profile."""
    mean = lambda v: total(v) / F.size(v)
    return let(profile, lambda w: F.struct(mean(F.slice(w, 1, part)).alias("head"), mean(F.slice(w, F.size(w) - part + 1, part)).alias("tail")))


def sign_bit(x: Column) -> Column:
    """Whether a double has its sign bit set: also for -0.0."""
    return F.when(x == 0, F.startswith(x.cast("string"), F.lit("-"))).otherwise(x < 0)


def middle(values: Column) -> Column:
    """The middle element (the later one of two)."""
    return F.get(values, F.floor(F.size(values) / 2).cast("int"))


def cyclic(values: Column, k: Column) -> Column:
    """Element k of endlessly repeated values."""
    return F.get(values, F.pmod(k, F.size(values)).cast("int"))


def profile_ratio(values: Column, part: int) -> Column:
    """Mean of the first `part` values over the mean of the middle third (taper)."""
    def run(v: Column) -> Column:
        third = F.slice(v, F.floor(F.size(v) / 3).cast("int") + 1, F.greatest(F.floor(F.size(v) / 3).cast("int"), F.lit(1)))
        return F.try_divide(total(F.slice(v, 1, part)) / part, total(third) / F.size(third))

    return let(values, run)
