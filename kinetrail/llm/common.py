"""What several operators share: the cluster's shared folder, files by URI, and ragged numpy arrays."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI under spark.checkpoint.dir, which all executors share; a temporary root only where none is set and one machine does all (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="kinetrail-shared-")
        spark.sparkContext.setCheckpointDir(root)
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def released(run):
    """run (a function from batches to batches), which gives its worker's unused memory back when it is done: workers stay for later tasks of other kinds."""

    def whole(batches):
        import ctypes

        import pyarrow as pa

        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return whole


def open_fs(uri: str):
    """(pyarrow filesystem, path) of a URI; works on executors, where Hadoop's own API is out of reach for Python."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        path = uri.removeprefix("file:")
        return fs.LocalFileSystem(), "/" + path.lstrip("/") if uri.startswith("file:") else path
    return fs.FileSystem.from_uri(uri)


def text_or_empty(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def chunk_count(frame: DataFrame, size: Column, chunk_bytes: int) -> int:
    """Chunks of about chunk_bytes that frame's rows fill; one pass over the sizes."""
    total = frame.agg(F.sum(size.cast("long")).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // chunk_bytes))


def spans_to_index(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Flat indices start..start+length-1 of all spans, one after another."""
    lengths = np.asarray(lengths, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0, dtype=np.int64) + np.repeat(np.asarray(starts, np.int64) - ends + lengths, lengths)


def flat_text(array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary array; null is empty."""
    import pyarrow as pa

    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    array = array.cast(pa.large_binary())
    if array.null_count:
        array = array.fill_null(b"")
    _, offsets, data = array.buffers()
    offsets = np.frombuffer(offsets, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class WordCache:
    """Token ids of words seen, in one flat array; encode_new(words) gives (flat ids, lengths) of words not seen before. Holds at most max_words after a batch."""

    def __init__(self, encode_new, max_words: int = 200_000):
        self.encode_new, self.max_words = encode_new, max_words
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each word)."""
        if len(self.index) > self.max_words:
            self.clear()
        import pyarrow as pa

        coded = pa.array(words, pa.string()).dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        if new := [w for w in distinct if w not in self.index]:
            flat, lengths = self.encode_new(new)
            self.index.update(zip(new, range(len(self.index), len(self.index) + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.flat = np.concatenate([self.flat, flat])
        at = np.fromiter(map(self.index.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        lengths = self.lengths[at]
        return self.flat[spans_to_index(self.starts[at], lengths)], lengths


def pieces_of(batch, text: str, most: int = 1 << 20):
    """batch in slices of about `most` bytes of text, one row at least."""
    _, offsets = flat_text(batch.column(text))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def pack(values: np.ndarray) -> bytes:
    """An array by byte planes, compressed; sorted integers are kept as differences."""
    import zlib

    values = np.ascontiguousarray(values)
    if not len(values):
        return b""
    return zlib.compress(np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes(), 1)


def unpack(data: bytes | None, dtype) -> np.ndarray:
    import zlib

    if not data:
        return np.zeros(0, dtype)
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def pack_sorted(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=values.dtype.type(0)))


def unpack_sorted(data: bytes | None, dtype=np.uint64) -> np.ndarray:
    return np.cumsum(unpack(data, dtype), dtype=dtype)


def lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in sorted keys, whether it is there) of each wanted value."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.searchsorted(keys, wanted)
    at[at == len(keys)] = 0
    return at, keys[at] == wanted


def count_sorted(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and the sum of each one's weights."""
    order = np.argsort(keys)
    keys, weights = keys[order], weights[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(weights, first) if len(first) else weights


def table_of(**columns):
    """A pyarrow table of columns; empty ones keep the types of `pa.array`s given."""
    import pyarrow as pa

    return pa.table(columns)
