"""A data source for label tensors: `spark.read.format("label_tensor").load(root)` after `register(spark)`.

A tensor (frames, points, 2) or (frames, tracks, points, 2) is read in ranges of frames, each by a task of its own that takes only its
bytes from the store (any that Arrow's file systems reach, by the path that Spark was given). With the option `pushdown`, filters on
`video` choose files and filters on `frame` choose ranges before any task is planned; Spark demands that
spark.sql.python.filterPushdown.enabled is set for that. `label_tensors` reads with it wherever the setting allows.

Options: name (labels49.npy), framesPerTask (100,000), pushdown (false). Columns: video (the file's folder), track, frame, pts; NaN points are null,
rows without any point are left out.
"""

from __future__ import annotations

import ast
import io
import struct
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "video string, track string, frame int, pts array<struct<x:double,y:double>>"
POINTS = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
STEP = 512  # frames that a task holds at once


@dataclass
class Frames(InputPartition):
    """Frames first..end-1 of one tensor."""

    path: str
    video: str
    first: int
    end: int
    begin: int  # byte of frame 0
    shape: tuple[int, ...]  # of a frame: tracks, points, 2
    dtype: str


def store_of(uri: str):
    """(Arrow file system, path)."""
    from pyarrow import fs

    return (fs.LocalFileSystem(), uri.removeprefix("file://").removeprefix("file:")) if "://" not in uri or uri.startswith("file:") else fs.FileSystem.from_uri(uri)


def header(stream) -> tuple[int, tuple[int, ...], str]:
    """(first byte of the data, shape, dtype) of a .npy stream; C order only."""
    start = stream.read(12)
    if start[:6] != b"\x93NUMPY":
        raise ValueError("not a .npy file")
    width = 2 if start[6] == 1 else 4
    size = struct.unpack("<H" if width == 2 else "<I", start[8 : 8 + width])[0]
    text = (start[8 + width :] + stream.read(size + 8 + width - 12)).decode("latin1")
    h = ast.literal_eval(text.strip())
    if h["fortran_order"] or np.dtype(h["descr"]).hasobject:
        raise ValueError("label tensors are plain numbers in C order")
    return 8 + width + size, tuple(h["shape"]), h["descr"]


class LabelReader(DataSourceReader):
    def __init__(self, root: str, name: str, per_task: int):
        self.root, self.name, self.per_task = root, name, max(1, per_task)
        self.videos: set[str] | None = None
        self.first, self.end = 0, 1 << 62

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, root = store_of(self.root)
        out: list[InputPartition] = []
        for info in sorted(store.get_file_info(fs.FileSelector(root, recursive=True)), key=lambda i: i.path):
            parts = info.path.split("/")
            if info.type != fs.FileType.File or parts[-1] != self.name or self.videos is not None and parts[-2] not in self.videos:
                continue
            with store.open_input_file(info.path) as stream:
                begin, shape, dtype = header(stream)
            if len(shape) not in (3, 4) or shape[-1] != 2:
                raise ValueError(f"{info.path}: a label tensor has the shape (frames, [tracks,] points, 2), not {shape}")
            frame = shape[1:] if len(shape) == 4 else (1, *shape[1:])
            prefix = self.root[: self.root.index("://") + 3] if "://" in self.root and not self.root.startswith("file:") else ""
            for a in range(max(0, self.first), min(shape[0], self.end), self.per_task):
                out.append(Frames(prefix + info.path, parts[-2], a, min(a + self.per_task, shape[0], self.end), begin, frame, dtype))
        return out

    def read(self, part: Frames | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # Spark asks once where there is no partition
            return
        store, path = store_of(part.path)
        size = int(np.prod(part.shape)) * np.dtype(part.dtype).itemsize
        with store.open_input_file(path) as stream:
            for a in range(part.first, part.end, STEP):
                b = min(a + STEP, part.end)
                values = np.frombuffer(stream.read_at((b - a) * size, part.begin + a * size), part.dtype).reshape(b - a, *part.shape).astype(float)
                yield self.rows(part.video, a, values)

    @staticmethod
    def rows(video: str, first: int, values: np.ndarray) -> pa.RecordBatch:
        seen = np.isfinite(values).all(-1)
        f, k = np.nonzero(seen.any(-1))
        there = seen[f, k]
        flat = values[f, k].reshape(-1, 2)
        xy = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["x", "y"], mask=pa.array(~there.ravel()))
        pts = pa.ListArray.from_arrays(pa.array(np.arange(len(f) + 1) * values.shape[2], pa.int32()), xy)
        return pa.RecordBatch.from_arrays([pa.array([video] * len(f), pa.string()), pa.array(k.astype(str).tolist(), pa.string()), pa.array((f + first).astype(np.int32)), pts.cast(POINTS)], ["video", "track", "frame", "pts"])


class PushingReader(LabelReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            column = getattr(f, "attribute", ())
            if column == ("video",) and isinstance(f, (EqualTo, In)):
                wanted = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.videos = wanted if self.videos is None else self.videos & wanted
            elif column == ("frame",) and isinstance(f, EqualTo):
                self.first, self.end = max(self.first, f.value), min(self.end, f.value + 1)
            elif column == ("frame",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif column == ("frame",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.end = min(self.end, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f


class LabelTensors(DataSource):
    @classmethod
    def name(cls) -> str:
        return "label_tensor"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> LabelReader:
        kind = PushingReader if self.options.get("pushdown", "false") == "true" else LabelReader
        return kind(self.options["path"], self.options.get("name", "labels49.npy"), int(self.options.get("framesPerTask", 100_000)))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LabelTensors)


def label_tensors(spark: SparkSession, root: str, name: str = "labels49.npy", frames_per_task: int = 100_000) -> DataFrame:
    """The rows of all tensors under root."""
    register(spark)
    pushdown = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("label_tensor").option("name", name).option("framesPerTask", frames_per_task).option("pushdown", pushdown).load(root)


def write_label_tensors(poses: DataFrame, root: str, points: int, name: str = "labels49.npy") -> DataFrame:
    """Writes root/<video>/<name> for each video of poses (video, track from 0, frame, pts), by a task per video; returns (video, frames, tracks).
    A tensor is a video's whole; frames and tracks without a row are NaN."""

    def write(table: pa.Table) -> pa.Table:
        frame, track = table.column("frame").to_numpy(), table.column("track").to_numpy()
        out = np.full((int(frame.max()) + 1, int(track.max()) + 1, points, 2), np.nan, np.float32)
        for f, k, p in zip(frame, track, table.column("pts").to_pylist(), strict=True):
            out[f, k] = [[np.nan, np.nan] if q is None else [q["x"], q["y"]] for q in p]
        buffer = io.BytesIO()
        np.save(buffer, out)
        video = table.column("video")[0].as_py()
        store, path = store_of(f"{root}/{video}/{name}")
        store.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with store.open_output_stream(path) as stream:
            stream.write(buffer.getbuffer())
        return pa.table({"video": [video], "frames": pa.array([out.shape[0]], pa.int64()), "tracks": pa.array([out.shape[1]], pa.int64())})

    return poses.select("video", "track", "frame", "pts").groupBy("video").applyInArrow(write, "video string, frames long, tracks long")
