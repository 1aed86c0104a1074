"""Exact substring dedup by a distributed merge sort of suffixes that never compares a known common prefix again.

A byte goes if a string of `length` bytes that covers it also starts earlier. Every such string contains an anchor: the
leftmost least hash among its k-grams (k is half the length), which equal strings have at the same place. So only
suffixes that start at anchors are sorted, and only of anchors whose k-gram more than one chunk has.

1. Chunks of documents (LEAST_CHUNKS at least) send the hashes of their anchors' k-grams; those that several chunks sent
   are named back.
2. Each chunk sorts the suffixes of anchors whose k-gram occurs twice. Neighbours' common prefixes, and those of the bytes to
   the left of the anchors, read backwards, tell which strings are equal; all but the first of each go. What is not settled
   is sent as front-coded runs, cut at common splitters, with the bytes to the left.
3. A range merges its runs with a loser tree whose entries carry the length of the prefix shared with the last winner;
   bytes are compared only beyond it. The common prefixes that come out tell again which strings are equal; the first of
   each is kept and the others are named to their chunks.
4. Chunks unite what was found and cut their texts.

Hashes only say where to look: every string that goes was found equal to another byte by byte, in the sorted orders. A
passage that a third of all documents holds reaches its range once per chunk, as each chunk settles its own copies first.

Defined cases: a null or empty text has no bytes; documents without id come before all others; rows with equal ids are ordered by a
hash of the text, and repeated rows (same id and text) are one document, each with the same result; texts shorter than
`length` are kept whole; an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunk_count, lookup, pack, pack_sorted, spans_to_index, unpack, unpack_sorted
from .words import mix, powers

BASE = 0x5851F42D4C957F2D
INVERSE = pow(BASE, -1, 1 << 64)
SLICE = 1 << 20
LEAST_CHUNKS = 4
RESULT = "doc_id long, n_bytes long, spans array<struct<a:long,b:long>>, kept binary"


def window_hashes(flat: np.ndarray, width: int, at: np.ndarray | None = None) -> np.ndarray:
    """Hash of each run of width bytes (or of those that start at `at`)."""
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum((flat.astype(np.uint64) + np.uint64(1)) * powers(len(flat), BASE), out=total[1:])
    down = powers(len(flat) + 1, INVERSE)
    if at is None:
        n = max(0, len(flat) - width + 1)
        return mix((total[width : width + n] - total[:n]) * down[:n])
    return mix((total[at + width] - total[at]) * down[at])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class Chunk:
    """Documents of a chunk, in order, without repeated rows, and their anchors: document, place, first and last window start, k-gram hash."""

    def __init__(self, table: pa.Table, length: int):
        ids = [-(1 << 63) if x is None else x for x in table.column("id").to_pylist()]
        texts = [(x or "").encode() for x in table.column("text").to_pylist()]
        self.nulls = {i for i, x in zip(ids, table.column("id").to_pylist(), strict=True) if x is None}
        keyed = sorted((i, int.from_bytes(hashlib.blake2b(t, digest_size=8).digest(), "big"), t) for i, t in zip(ids, texts, strict=True))
        self.docs = [x for k, x in enumerate(keyed) if not k or x[:2] != keyed[k - 1][:2]]
        self.copies = np.unique([x[:2] for x in keyed], axis=0, return_counts=True)[1] if keyed and len(self.docs) < len(keyed) else np.ones(len(self.docs), np.int64)
        self.data = np.frombuffer(b"".join(x[2] for x in self.docs), np.uint8)
        self.sizes = np.array([len(x[2]) for x in self.docs], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.length, self.k = length, length // 2
        parts = []
        a = 0
        while a < len(self.docs):
            b = max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + SLICE)))
            parts.append(self._anchors(a, b))
            a = b
        self.doc, self.at, self.low, self.high, self.gram = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)

    def _anchors(self, a: int, b: int):
        lo, hi = self.starts[a], self.starts[b - 1] + self.sizes[b - 1]
        flat, n = self.data[lo:hi], hi - lo
        room = np.maximum(self.sizes[a:b] - self.length + 1, 0)
        start = spans_to_index(self.starts[a:b] - lo, room)
        if not len(start):
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)
        grams = window_hashes(flat, self.k)
        placed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
        least = sliding_min(placed, self.length - self.k + 1)
        at = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.concatenate([[True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(start)) - 1
        at, low, high = at[first], start[first], start[last]
        doc = np.searchsorted(self.starts[a:b], low + lo, "right") - 1 + a
        # an empty document shares its start with the next one, to which the window belongs
        return doc, at + lo, low + lo, high + lo, grams[at]

    def suffixes(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes from the anchors `which` on, as far as their strings reach, plus one, padded with zeros to `length`; and their sizes."""
        sizes = self.high[which] + self.length - self.at[which]
        out = np.zeros((len(which), self.length), np.uint8)
        out.ravel()[spans_to_index(np.arange(len(which)) * self.length, sizes)] = self.data[spans_to_index(self.at[which], sizes)] + 1
        return out, sizes

    def lefts(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes before the anchors, as far as their strings reach, read backwards, plus one, padded; and their sizes."""
        sizes = self.at[which] - self.low[which]
        return backwards(self.data[spans_to_index(self.low[which], sizes)], sizes, self.length - self.k), sizes


def backwards(flat: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """Rows of bytes, one after another in flat, read backwards, plus one, padded with zeros. (No byte of UTF-8 is 255, so a shorter row sorts first.)"""
    out = np.zeros((len(sizes), width), np.uint8)
    inside = spans_to_index(np.zeros(len(sizes), np.int64), sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), np.repeat(sizes, sizes) - 1 - inside] = flat + 1
    return out


def common_prefixes(rows: np.ndarray) -> np.ndarray:
    """Bytes that each sorted, padded row shares with the one before it."""
    same = (rows[1:] == rows[:-1]) & (rows[1:] > 0)
    out = np.zeros(len(rows), np.int64)
    out[1:] = np.where(same.all(axis=1), rows.shape[1], np.argmin(same, axis=1))
    return out


def later_strings(known: np.ndarray, sizes: np.ndarray, left: np.ndarray, left_sizes: np.ndarray, rank: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, bytes before it) of all strings that equal one of an anchor of lower rank. The anchors' suffixes are in sorted order, each
    sharing `known` bytes with the one before; a string that begins o bytes before its anchor equals another if the suffixes
    share length - o bytes and the bytes before share o."""
    who, before = [], []
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(left.view(f"S{left.shape[1]}").ravel(), kind="stable")
    shared = common_prefixes(left[order])
    for o in range(int(length - sizes.max()), int(left_sizes.max()) + 1):
        some = np.flatnonzero((length - sizes <= o) & (left_sizes >= o))
        if len(some) < 2:
            continue
        by_left = np.empty(len(known), np.int64)
        by_left[order] = np.cumsum(shared < o)
        key = np.cumsum(known < length - o)[some] * (len(known) + 1) + by_left[some]
        by = np.lexsort((rank[some], key))
        again = some[by[1:][key[by[1:]] == key[by[:-1]]]]
        who.append(again)
        before.append(np.full(len(again), o))
    return (np.concatenate(who), np.concatenate(before)) if who else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def spans_of(start: np.ndarray, length: int, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of the union of windows, which are ordered by document and start."""
    if not len(start):
        return doc, start, start
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (start[1:] > start[:-1] + length)])
    first = np.flatnonzero(new)
    return doc[first], start[first], start[np.append(first[1:], len(start)) - 1] + length


def encode_run(rows: np.ndarray, sizes: np.ndarray, left: np.ndarray, left_sizes: np.ndarray, doc: np.ndarray, at: np.ndarray) -> dict:
    """A sorted run of padded suffixes; only what differs from the one before is kept. left: bytes before the anchors, one after another."""
    same = common_prefixes(rows)
    flat = rows.ravel()[spans_to_index(np.arange(len(rows)) * rows.shape[1] + same, sizes - same)]
    return {"a": pack(np.stack([same, sizes, left_sizes, doc, at]).astype(np.int32).ravel()), "b": pack(flat), "c": pack(left)}


class Run:
    """Decodes a front-coded run."""

    def __init__(self, chunk: int, a: bytes, b: bytes, c: bytes, keys: bytes):
        self.chunk = chunk
        self.same, self.sizes, self.left_sizes, self.doc, self.at = unpack(a, np.int32).reshape(5, -1).astype(np.int64)
        tails, ends = unpack(b, np.uint8).tobytes(), np.cumsum(self.sizes - self.same).tolist()
        self.suffixes: list[bytes] = []
        last, begin = b"", 0
        for h, end in zip(self.same.tolist(), ends, strict=True):
            last = last[:h] + tails[begin:end]
            self.suffixes.append(last)
            begin = end
        self.left = unpack(c, np.uint8)
        self.left_at = np.cumsum(self.left_sizes) - self.left_sizes
        table = unpack(keys, np.uint64).reshape(3, -1)
        order = np.searchsorted(table[0], self.doc.astype(np.uint64))
        self.id, self.hash = table[1][order], table[2][order]


def common_prefix(a: bytes, b: bytes, known: int) -> int:
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    return n - ((int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length() + 7) // 8


def merge_runs(runs: list[Run]) -> tuple[list[int], list[int], list[int]]:
    """(run, place in it, prefix shared with the one before) of all suffixes in order, by a loser tree on known prefixes."""
    width = 1 << max(0, (len(runs) - 1).bit_length())
    current: list[bytes | None] = [r.suffixes[0] for r in runs] + [None] * (width - len(runs))
    known, place = [0] * width, [0] * width
    shared = [r.same.tolist() for r in runs]
    tree = [0] * width

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix is then the one it shares with the winner."""
        x, y = current[a], current[b]
        if x is None:
            return b, a
        if y is None or known[a] > known[b]:
            return a, b
        if known[b] > known[a]:
            return b, a
        h = common_prefix(x, y, known[a])
        if h == len(x) or (h < len(y) and x[h] < y[h]):
            known[b] = h
            return a, b
        known[a] = h
        return b, a

    winners = list(range(width))
    level = width
    while level > 1:
        up = []
        for i in range(0, level, 2):
            w, tree[(level + i) // 2] = play(winners[i], winners[i + 1])
            up.append(w)
        winners, level = up, level // 2
    best = winners[0]
    out_run, out_place, out_known = [], [], []
    while current[best] is not None:
        out_run.append(best)
        out_place.append(place[best])
        out_known.append(known[best])
        place[best] += 1
        i = place[best]
        if i < len(shared[best]):
            current[best], known[best] = runs[best].suffixes[i], shared[best][i]
        else:
            current[best] = None
        node = (width + best) // 2
        while node:
            best, tree[node] = play(best, tree[node])
            node //= 2
    return out_run, out_place, out_known


def _packed_spans(doc: np.ndarray, a: np.ndarray, b: np.ndarray) -> bytes:
    return pack(np.stack([doc, a, b]).astype(np.int64).ravel())


def merged_spans(runs: list[Run], length: int, k: int) -> dict[int, bytes]:
    """Spans to remove in each chunk (packed), from the repeated strings of all runs of a range."""
    run, place, known = (np.array(x, np.int64) for x in merge_runs(runs))
    first = np.cumsum([0] + [len(r.sizes) for r in runs])  # of each run, in the fields
    sizes, left_sizes, doc, at, id, hash, left_at = (np.concatenate([getattr(r, c) for r in runs])[first[run] + place] for c in ("sizes", "left_sizes", "doc", "at", "id", "hash", "left_at"))
    chunk = np.array([r.chunk for r in runs])[run]
    lefts = np.concatenate([r.left for r in runs])
    left_at += np.cumsum([0] + [len(r.left) for r in runs])[run]
    group = np.cumsum(known < k)
    some = np.flatnonzero(np.bincount(group)[group] > 1)
    out: dict[int, list] = {}
    bounds = np.flatnonzero(np.concatenate([[True], group[some][1:] != group[some][:-1]])) if len(some) else some
    step = 20_000  # anchors at once, whole groups
    a = 0
    while a < len(some):
        after = bounds[np.searchsorted(bounds, a + step) :]
        b = int(after[0]) if len(after) else len(some)
        part = some[a:b]
        a = b
        rank = np.empty(len(part), np.int64)
        rank[np.lexsort((at[part], hash[part], id[part].view(np.int64)))] = np.arange(len(part))
        left = backwards(lefts[spans_to_index(left_at[part], left_sizes[part])], left_sizes[part], length - k)
        # neighbours in different groups share less than any of their strings needs
        who, before = later_strings(np.where(np.diff(part, prepend=-2) == 1, known[part], 0), sizes[part], left, left_sizes[part], rank, length)
        who = part[who]
        start = at[who] - before
        for c in np.unique(chunk[who]):
            mine = chunk[who] == c
            by = np.lexsort((start[mine], doc[who[mine]]))
            out.setdefault(int(c), []).append(np.stack(spans_of(start[mine][by], length, doc[who[mine]][by])))
    return {c: pack(np.concatenate(x, axis=1).ravel()) for c, x in out.items()}


def suffix_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 100, chunk_bytes: int = 16 << 20, sample_rows: int = 500, seed: int = 17) -> DataFrame:
    """A row per document: n_bytes, the removed spans (bytes, half open) and the kept bytes.

    chunk_bytes bounds what a task holds of texts; sample_rows bounds the sample that the ranges' splitters are taken from
    (they balance the work and decide nothing else).
    """
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    n = max(LEAST_CHUNKS, chunk_count(rows, F.octet_length("text"), chunk_bytes))
    chunks = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))
    splitters = _splitters(rows, n, length, sample_rows, seed)
    k = length // 2

    def ask(key, table):
        grams = np.unique(Chunk(table, length).gram)
        ends = [0, *np.searchsorted(grams, (np.arange(1, n, dtype=object) * (1 << 64) // n).astype(np.uint64)).tolist(), len(grams)]
        out = [(i, pack_sorted(grams[a:b])) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
        return pa.table({"chunk": pa.array([key[0].as_py()] * len(out), pa.int32()), "bucket": pa.array([x[0] for x in out], pa.int32()), "a": pa.array([x[1] for x in out], pa.binary())})

    def shared(key, table):
        sent = [unpack_sorted(x) for x in table.column("a").to_pylist()]
        grams, counts = np.unique(np.concatenate(sent), return_counts=True)
        grams = grams[counts > 1]
        out = [(c, pack_sorted(x[lookup(grams, x)[1]])) for c, x in zip(table.column("chunk").to_pylist(), sent, strict=True)]
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int32()), "bucket": pa.array([key[0].as_py()] * len(out), pa.int32()), "a": pa.array([x[1] for x in out], pa.binary())})

    names = {"chunk": pa.int32(), "range": pa.int32(), "kind": pa.string(), "a": pa.binary(), "b": pa.binary(), "c": pa.binary(), "keys": pa.binary()}

    def runs(key, table, replies):
        out: list[dict] = []
        if table.num_rows:
            chunk = key[0].as_py()
            c = Chunk(table, length)
            abroad = lookup(np.sort(np.concatenate([np.zeros(0, np.uint64)] + [unpack_sorted(x) for x in replies.column("a").to_pylist()])), c.gram)[1]
            _, inverse, counts = np.unique(c.gram, return_inverse=True, return_counts=True)
            mine = np.flatnonzero(abroad | (counts[inverse] > 1))
            rows, sizes = c.suffixes(mine)
            order = np.argsort(rows.view(f"S{length}").ravel(), kind="stable")
            mine, rows, sizes = mine[order], rows[order], sizes[order]
            left, left_sizes = c.lefts(mine)
            # anchors of a chunk are in document order
            who, before = later_strings(common_prefixes(rows), sizes, left, left_sizes, mine, length)
            del left
            doc, start = c.doc[mine[who]], c.at[mine[who]] - before
            by = np.lexsort((start, doc))
            doc, a, b = spans_of(start[by], length, doc[by])
            out.append({"chunk": chunk, "range": chunk % n, "kind": "local", "a": _packed_spans(doc, a - c.starts[doc], b - c.starts[doc])})
            settled = np.bincount(who, minlength=len(mine)) == c.high[mine] - c.low[mine] + 1
            some = np.flatnonzero(abroad[mine] & ~settled)
            if len(some):
                mine, rows, sizes = mine[some], rows[some], sizes[some]
                head = np.ascontiguousarray(rows[:, :8]).view(">u8").ravel().astype(np.uint64)
                ends = [0, *np.searchsorted(head, splitters).tolist(), len(mine)]
                for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)):
                    if b > a:
                        m = mine[a:b]
                        used = np.unique(c.doc[m])
                        keys = np.array([[d, c.docs[d][0] % (1 << 64), c.docs[d][1]] for d in used.tolist()], np.uint64).T
                        before = c.at[m] - c.low[m]
                        out.append({"chunk": chunk, "range": i, "kind": "run", "keys": pack(keys.ravel())} | encode_run(rows[a:b], sizes[a:b], c.data[spans_to_index(c.low[m], before)], before, c.doc[m], c.at[m] - c.starts[c.doc[m]]))
        return pa.table({x: pa.array([o.get(x) for o in out], t) for x, t in names.items()})

    def merge(key, table):
        rows = table.to_pylist()
        found = [(r["chunk"], r["a"]) for r in rows if r["kind"] == "local"]
        sent = [Run(r["chunk"], r["a"], r["b"], r["c"], r["keys"]) for r in rows if r["kind"] == "run"]
        if len(sent) > 1:
            found += merged_spans(sent, length, k).items()
        return pa.table({"chunk": pa.array([x[0] for x in found], pa.int32()), "a": pa.array([x[1] for x in found], pa.binary())})

    def cut(key, table, found):
        out: dict[str, list] = {"doc_id": [], "n_bytes": [], "spans": [], "kept": []}
        if table.num_rows:
            c = Texts(table, length)
            spans = np.concatenate([np.zeros((3, 0), np.int64)] + [unpack(x, np.int64).reshape(3, -1) for x in found.column("a").to_pylist()], axis=1)
            spans = spans[:, np.lexsort((spans[1], spans[0]))]
            edge = np.searchsorted(spans[0], np.arange(len(c.docs) + 1))
            for i, (doc_id, _, data) in enumerate(c.docs):
                merged: list[dict] = []
                kept, last = [], 0
                for a, b in spans[1:, edge[i] : edge[i + 1]].T.tolist():
                    if merged and a <= merged[-1]["b"]:
                        merged[-1]["b"] = max(merged[-1]["b"], b)
                    else:
                        merged.append({"a": a, "b": b})
                for s in merged:
                    kept.append(data[last : s["a"]])
                    last = s["b"]
                kept.append(data[last:])
                for _ in range(int(c.copies[i])):
                    out["doc_id"].append(None if doc_id in c.nulls else doc_id)
                    out["n_bytes"].append(len(data))
                    out["spans"].append(merged)
                    out["kept"].append(b"".join(kept))
        span = pa.struct([("a", pa.int64()), ("b", pa.int64())])
        types = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "spans": pa.list_(span), "kept": pa.binary()}
        return pa.table({x: pa.array(out[x], t) for x, t in types.items()})

    asked = chunks.groupBy("chunk").applyInArrow(ask, "chunk int, bucket int, a binary")
    replies = asked.groupBy("bucket").applyInArrow(shared, "chunk int, bucket int, a binary")
    sent = chunks.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(runs, "chunk int, range int, kind string, a binary, b binary, c binary, keys binary")
    found = sent.groupBy("range").applyInArrow(merge, "chunk int, a binary")
    return chunks.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(cut, RESULT)


class Texts(Chunk):
    """The documents alone, without their anchors."""

    def _anchors(self, a: int, b: int):
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),)


def _splitters(rows: DataFrame, n: int, length: int, sample_rows: int, seed: int) -> np.ndarray:
    """n - 1 heads of suffixes (8 bytes as a number) that cut a sample's suffixes into equal parts."""
    if n < 2:
        return np.zeros(0, np.uint64)
    total = rows.count()
    sample = rows.sample(fraction=min(1.0, 2 * sample_rows / max(1, total)), seed=seed).limit(sample_rows).toArrow()
    c = Chunk(sample, length)
    if not len(c.at):
        return np.zeros(0, np.uint64)
    heads = np.sort(np.ascontiguousarray(c.data[c.at[:, None] + np.arange(8)]).view(">u8").ravel().astype(np.uint64) + np.uint64(0x0101010101010101))
    return np.unique(heads[(np.arange(1, n) * len(heads)) // n])
