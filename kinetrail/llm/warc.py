"""WARC archives from pages: a deterministic sharded writer, and a reader.

Records are dealt to shards by boundaries of page_id that a histogram of payload bytes gives (four bins a shard, and heavy
bins are cut again until they fit or hold one id; the driver gets a number per bin), sorted within, and written as one gzip member each;
a file begins with a warcinfo record and is closed once its compressed size passes the limit. Headers and digests are made
anew from the payload, dates come from a parameter, record ids from the content, so equal input gives equal files. Files are written under temporary names and renamed; the manifest, which Spark commits
last, names the files that count.

Equal payloads: digests are grouped first with pre-aggregation; only those that occur again are joined back, as (page_id,
digest) without payload, so a payload that a third of all pages share moves no page twice.

Defined cases: a null html is the empty payload; null page ids come in shards of their own after all others, are always
responses and refer to nothing; very long payloads are one record like others; other columns, whatever their names, are left out; of rows with the same page_id and payload the first is the response and the others revisit it; a null url is written as an
empty target; an empty table makes no file.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import open_fs

MANIFEST = "shard int, seq int, path string, n_records long, n_bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def shard_bounds(pages: DataFrame, id: str, size, shard_bytes: int, cut: int = 1024) -> np.ndarray:
    """First ids of the shards after the first one. A row's cell is known by its least id; heavy cells are cut into `cut` each round."""
    spark = pages.sparkSession
    ends = pages.agg(F.min(id).alias("a"), F.max(id).alias("b"), F.sum(size).alias("n")).first()
    if ends["a"] is None or (ends["n"] or 0) <= shard_bytes:
        return np.zeros(0, np.int64)
    a, b = int(ends["a"]), int(ends["b"])
    width = max(1, -(-(b - a + 1) // max(cut, 4 * int(ends["n"]) // shard_bytes)))
    # differences stay within 64 bits: ids below and above zero have cells of their own
    start = F.when(F.col(id) < 0, F.lit(a)).otherwise(F.lit(max(a, 0)))
    rows = pages.where(F.col(id).isNotNull()).select(F.col(id).alias("id"), size.alias("size"), start.alias("low"))
    cells: list[tuple[np.ndarray, np.ndarray]] = []
    while True:
        rows = rows.withColumn("low", F.expr(f"low + (id - low) div {width}L * {width}L"))
        found = rows.groupBy("low").agg(F.sum("size").alias("size")).toArrow()
        low, held = (found.column(c).to_numpy() for c in ("low", "size"))
        heavy = (held > shard_bytes) & (width > 1)
        cells.append((low[~heavy], held[~heavy]))
        if not heavy.any():
            break
        rows = rows.join(spark.createDataFrame(pa.table({"low": low[heavy]})), "low")
        width = -(-width // cut)
    low, held = (np.concatenate(x) for x in zip(*cells, strict=True))
    order = np.argsort(low)
    low, held = low[order], held[order]
    # a shard takes cells until the next one would not fit
    total, out, at = np.cumsum(held), [], 0
    while (at := max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + shard_bytes, "right")))) < len(low):
        out.append(int(low[at]))
    return np.array(out, np.int64)


def record_id(page_id, kind: str, digest: str, nth: int) -> str:
    """Of the nth record of its kind with this page and payload."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}\n{kind}\n{digest}\n{nth}'.encode()).digest()[:16], version=5)}>"


def framed(fields: dict, body: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + body + b"\r\n\r\n"


def information(name: str, date: str) -> bytes:
    body = b"software: kinetrail\r\nformat: WARC File Format 1.1\r\n"
    return framed({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(name, "warcinfo", "", 0), "WARC-Date": date, "WARC-Filename": name, "Content-Type": "application/warc-fields", "Content-Length": len(body)}, body)


def record(page_id, url: str, kind: str, refers_to, digest: str, payload: bytes, date: str, nth: int = 0) -> bytes:
    body = payload if kind == "response" else b""
    fields = {
        "WARC-Type": kind, "WARC-Record-ID": record_id(page_id, kind, digest, nth), "WARC-Date": date, "WARC-Target-URI": " ".join(url.split()), "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(body).hexdigest()}",
        "X-Page-Id": "" if page_id is None else page_id, "X-Payload-Length": len(payload), "Content-Type": "text/html; charset=utf-8", "Content-Length": len(body),
    }
    if kind == "revisit":
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to, "response", digest, 0), "X-Refers-To-Page": refers_to}
    return framed(fields, body)


def member(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Writer:
    def __init__(self, folder: str, shard: int, file_bytes: int, begin):
        """begin(name) gives the bytes that a file begins with."""
        self.fs, self.root = open_fs(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.shard, self.limit, self.begin, self.seq, self.out, self.rows = shard, file_bytes, begin, 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.temporary = f"{self.root}/_{uuid.uuid4().hex}"
            self.name = f"pages-{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.out, self.n, self.size, self.hash = self.fs.open_output_stream(self.temporary, compression=None), 0, 0, hashlib.sha256()
            data = self.begin(self.name) + data
        self.out.write(data)
        self.hash.update(data)
        self.n, self.size = self.n + 1, self.size + len(data)
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temporary, f"{self.root}/{self.name}")
            self.rows.append((self.shard, self.seq, self.name, self.n, self.size, self.hash.hexdigest()))
            self.out, self.seq = None, self.seq + 1


def write_warc(pages: DataFrame, folder: str, id: str = "page_id", url: str = "url", html: str = "html", min_revisit: int = 100, shard_bytes: int = 32 << 20, file_bytes: int = 16 << 20, date: str = "2020-01-01T00:00:00Z", level: int = 6) -> None:
    """Writes pages into folder, a URI that all executors reach."""
    rows = pages.select(F.col(id).cast("long").alias("page_id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    size = F.octet_length("html").cast("long")
    bounds = shard_bounds(rows, "page_id", size, shard_bytes)
    rows = rows.withColumn("digest", F.sha2("html", 256))
    long_rows = rows.where(F.octet_length("html") >= min_revisit).select("page_id", "digest").where("page_id is not null")
    again = long_rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first")).where("n > 1").drop("n")
    revisits = long_rows.join(again, "digest").where(F.col("page_id") != F.col("first")).select("page_id", "digest", "first").distinct()
    # the pages and what is known of them meet in the shard, sorted, so that the payloads move once
    kinds = revisits.select("page_id", F.lit("").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "first", F.lit(0).alias("kind"))
    both = rows.select("page_id", "url", "html", "digest", F.lit(None).cast("long").alias("first"), F.lit(1).alias("kind")).unionByName(kinds)
    lost = rows.where("page_id is null").agg(F.sum(size).alias("n")).first()["n"] or 0
    with_id, without = len(bounds) + 1, max(1, -(-int(lost) // shard_bytes))
    n = with_id + without

    @F.pandas_udf("int")
    def shard_of(page_id: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, page_id.to_numpy(), "right").astype(np.int32))

    shard = F.when(F.col("page_id").isNull(), with_id + F.pmod(F.xxhash64("digest"), F.lit(without))).otherwise(shard_of(F.coalesce("page_id", F.lit(0))))
    both = both.withColumn("shard", shard.cast("int"))
    dealt = both.repartitionById(n, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "digest", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin = lambda name: member(information(name, date), level)
        writer, rows, last, first, nth = None, [], None, None, {}
        for batch in batches:
            for r in batch.to_pylist():
                if writer is None or writer.shard != r["shard"]:
                    if writer is not None:
                        writer.close()
                        rows += writer.rows
                    writer, last, first = Writer(folder, r["shard"], file_bytes, begin), None, None
                key = (r["page_id"], r["digest"])
                if key not in nth:
                    nth = {key: {"response": 0, "revisit": 0}}
                if r["kind"] == 0:
                    last, first = key, r["first"]
                    continue
                payload = r["html"].encode()
                to = first if key == last else None
                kind = "response" if to is None else "revisit"
                data = record(r["page_id"], r["url"], kind, to, r["digest"], payload, date, nth[key][kind])
                nth[key][kind] += 1
                writer.add(member(data, level))
                if key != last and r["page_id"] is not None and len(payload) >= min_revisit:
                    last, first = key, r["page_id"]  # a repeated row revisits this one
        if writer is not None:
            writer.close()
            rows += writer.rows
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], types[i]) for i in range(6)], [x.split()[0] for x in MANIFEST.split(", ")])

    dealt.select("shard", "page_id", "url", "html", "digest", "first", "kind").mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_manifest")


def members(stream, size: int = 1 << 20) -> Iterator[bytes]:
    """Decompressed gzip members of a stream, one by one."""
    rest = b""
    while rest or (rest := stream.read(size)):
        z = zlib.decompressobj(31)
        out = [z.decompress(rest)]
        while not z.eof:
            if not (rest := stream.read(size)):
                raise ValueError("the archive ends within a record")
            out.append(z.decompress(rest))
        rest = z.unused_data
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the files that the manifest names; payload is null for revisits. Digests are checked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])
        for batch in batches:
            for name in batch.column("path").to_pylist():
                rows: list[tuple] = []
                held = 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for data in members(f):
                        h, body = parse(data)
                        if h["WARC-Type"] == "warcinfo":
                            continue
                        digest, kind = h["WARC-Payload-Digest"].partition(":")[2], h["WARC-Type"]
                        if hashlib.sha256(body).hexdigest() != h["WARC-Block-Digest"].partition(":")[2] or kind == "response" and digest != h["WARC-Block-Digest"].partition(":")[2]:
                            raise ValueError(f"wrong digest in {name}")
                        rows.append((int(h["X-Page-Id"]) if h["X-Page-Id"] else None, h["WARC-Target-URI"], kind, int(h["X-Refers-To-Page"]) if kind == "revisit" else None, digest, int(h["X-Payload-Length"]), body if kind == "response" else None))
                        held += len(data)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema[i].type) for i in range(7)], schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], schema[i].type) for i in range(7)], schema=schema)

    manifest = spark.read.parquet(f"{folder}/_manifest").select("path")
    return manifest.repartition(max(1, manifest.count())).mapInArrow(run, RECORDS)  # a task per file
