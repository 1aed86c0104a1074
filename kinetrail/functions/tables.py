"""Table functions for SQL text: rows of one partition in, rows out, as Arrow batches.

After register(spark):

    SELECT * FROM bridged_runs(TABLE(SELECT track, frame FROM near) PARTITION BY track ORDER BY (frame), 2, 2)
    SELECT * FROM thinned(TABLE(SELECT track, frame FROM near) PARTITION BY track ORDER BY (frame), 10)

The first column of the table is its key, the second one the frame. Only ends of runs are kept between batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf


def _number(x) -> int:
    return int(x[0].as_py()) if isinstance(x, (pa.Array, pa.ChunkedArray)) else int(x)


@arrow_udtf(returnType="key long, a long, b long")
class BridgedRuns:
    """Inclusive runs of frames that lie at most gap apart, of at least `least` frames from end to end."""

    def __init__(self):
        self.key, self.a, self.b, self.least = None, None, None, 1

    def eval(self, table: pa.RecordBatch, gap: pa.Array, least: pa.Array) -> Iterator[pa.Table]:
        if not table.num_rows:
            return
        far, self.least, self.key = _number(gap), _number(least), table.column(0)[0].as_py()
        frames = table.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.flatnonzero(np.diff(frames) > far) + 1
        a, b = frames[np.concatenate([[0], starts])], frames[np.concatenate([starts - 1, [len(frames) - 1]])]
        if self.a is not None:
            if a[0] - self.b <= far:
                a[0] = self.a
            else:
                a, b = np.concatenate([[self.a], a]), np.concatenate([[self.b], b])
        self.a, self.b = int(a[-1]), int(b[-1])
        yield self.rows(a[:-1], b[:-1])

    def terminate(self) -> Iterator[pa.Table]:
        if self.a is not None:
            yield self.rows(np.array([self.a]), np.array([self.b]))

    def rows(self, a: np.ndarray, b: np.ndarray) -> pa.Table:
        long = b - a + 1 >= self.least
        return pa.table({"key": pa.array([self.key] * int(long.sum()), pa.int64()), "a": pa.array(a[long], pa.int64()), "b": pa.array(b[long], pa.int64())})


@arrow_udtf(returnType="key long, frame long")
class Thinned:
    """Frames in order, each at least gap after the one taken before."""

    def __init__(self):
        self.last = None

    def eval(self, table: pa.RecordBatch, gap: pa.Array) -> Iterator[pa.Table]:
        if not table.num_rows:
            return
        step, taken = _number(gap), []
        frames = table.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        at = 0 if self.last is None else int(np.searchsorted(frames, self.last + step))
        while at < len(frames):
            taken.append(int(frames[at]))
            at = int(np.searchsorted(frames, frames[at] + step))
        self.last = taken[-1] if taken else self.last
        yield pa.table({"key": pa.array([table.column(0)[0].as_py()] * len(taken), pa.int64()), "frame": pa.array(taken, pa.int64())})


def register(spark: SparkSession) -> None:
    spark.udtf.register("bridged_runs", BridgedRuns)
    spark.udtf.register("thinned", Thinned)
