"""Boundary of the pixel and model operators.

Decoding, networks and editors stay outside of the engine: a plug-in is a function from one frame's gray array to
midlines or components, registered by name and run over binary frame rows in batches. The plug-ins here need numpy only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PLUGINS: dict[str, Callable[[np.ndarray], list[dict]]] = {}
COMPONENTS = "video string, frame int, comp_id int, area int, cx double, cy double, touches_border boolean"


def plugin(name: str):
    def add(f):
        PLUGINS[name] = f
        return f

    return add


def otsu(gray: np.ndarray) -> int:
    """The threshold of greatest variance between the classes below and above it."""
    p = np.bincount(gray.ravel(), minlength=256) / gray.size
    weight, mean = np.cumsum(p), np.cumsum(p * np.arange(256))
    with np.errstate(all="ignore"):
        between = (mean[-1] * weight - mean) ** 2 / (weight * (1 - weight))
    return int(np.nan_to_num(between, posinf=0).argmax())


def label(mask: np.ndarray) -> tuple[np.ndarray, int]:
    """Eight-connected components by union of row runs; labels 1..n in reading order."""
    rows = []
    parent: list[int] = []

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    last: list[tuple[int, int, int]] = []
    for y, line in enumerate(mask):
        edge = np.flatnonzero(np.diff(np.concatenate([[0], line.astype(np.int8), [0]]))).reshape(-1, 2)
        now = []
        for a, b in edge.tolist():
            me = len(parent)
            parent.append(me)
            for c, d, other in last:
                if c <= b and a <= d:
                    parent[max(find(me), find(other))] = min(find(me), find(other))
            now.append((a, b, me))
            rows.append((y, a, b, me))
        last = now
    out, names = np.zeros(mask.shape, np.int32), {}
    for y, a, b, me in rows:
        out[y, a:b] = names.setdefault(find(me), len(names) + 1)
    return out, len(names)


@plugin("dark_components")
def dark_components(gray: np.ndarray, least: int = 800, border: int = 3) -> list[dict]:
    """Components darker than the Otsu threshold, from the largest on."""
    labels, n = label(gray <= otsu(gray))
    h, w = gray.shape
    out = []
    for k in range(1, n + 1):
        y, x = np.nonzero(labels == k)
        if len(x) >= least:
            edge = bool(x.min() < border or y.min() < border or x.max() >= w - border or y.max() >= h - border)
            out.append({"area": len(x), "cx": float(x.mean()), "cy": float(y.mean()), "touches_border": edge})
    return sorted(out, key=lambda c: (-c["area"], c["cx"]))


def components(frames: DataFrame, name: str = "dark_components") -> DataFrame:
    """Component rows of frames (video, frame, width, height, gray) by a registered plug-in. A frame that fails has none."""
    run_one = PLUGINS[name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                gray = np.frombuffer(r["gray"], np.uint8)
                if len(gray) != r["width"] * r["height"]:
                    continue
                out += [(r["video"], r["frame"], k, c["area"], c["cx"], c["cy"], c["touches_border"]) for k, c in enumerate(run_one(gray.reshape(r["height"], r["width"])))]
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(types)], [c.split()[0] for c in COMPONENTS.split(", ")])

    return frames.select("video", "frame", "width", "height", "gray").mapInArrow(run, COMPONENTS)
