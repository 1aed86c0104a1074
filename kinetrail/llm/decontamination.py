"""Benchmark decontamination by winnowing.

The benchmark is the stated query set: it is cut into blocks of bounded bytes, each block is fingerprinted once on the
driver and broadcast, and the documents stream past block after block in one pass without any shuffle. More benchmark
means more blocks, never a larger broadcast.

Fingerprints: the minimum hash of every `window` consecutive k-grams of words, with k + window - 1 = span, so that every
shared span of `span` words has a fingerprint in common. Fingerprints of both sides are joined together with the hash of a whole window
of `span` words around them, so items that share a fingerprint but no window with a document cost nothing. The benchmark's windows
are kept once each, with the items that hold them; a document's window is compared with its match word by word, so hashes decide
nothing in the end, and overlapping hits extend to whole spans. An item with fewer words than span is one window: it is looked
up by the hash of all its words (winnowing with a window of one), for each such length that occurs.

Defined cases: null texts have no words and no hits; an item without words is never found; repeated items are found under
each of their ids; a null item_id is found but has no name in the list; an empty benchmark leaves every document clean;
repeated documents are judged one by one; all columns of the documents are kept, but one named `__leak` is replaced.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_text, lookup, pieces_of, released, spans_to_index
from .components import written
from .words import Words


def winnow(grams: np.ndarray, window: int) -> np.ndarray:
    """Positions of the minima of all windows (the leftmost of equal ones)."""
    n = len(grams)
    if n == 0:
        return np.zeros(0, np.int64)
    if window == 1:
        return np.arange(n)
    padded = np.concatenate([grams, np.full(window - 1, np.iinfo(np.uint64).max, np.uint64)])
    best, at = padded[:n].copy(), np.arange(n)
    for j in range(1, window):
        less = padded[j : n + j] < best
        best = np.where(less, padded[j : n + j], best)
        at = np.where(less, np.arange(n) + j, at)
    picked = np.zeros(n + window, bool)
    picked[at] = True
    at = np.flatnonzero(picked[:n])
    return at[grams[at] != np.iinfo(np.uint64).max]


def same_windows(one: Words, p: np.ndarray, other: Words, q: np.ndarray, m: int) -> np.ndarray:
    """Whether the m words from p on of one are those from q on of the other, byte by byte."""
    ok = np.ones(len(p), bool)
    for i in range(m):
        at = np.flatnonzero(ok)
        a, b = p[at] + i, q[at] + i
        size = one.end[a] - one.start[a]
        equal = size == other.end[b] - other.start[b]
        at, a, b, size = at[equal], a[equal], b[equal], size[equal]
        ok[:] = False
        if len(at):
            differ = one.data[spans_to_index(one.start[a], size)] != other.data[spans_to_index(other.start[b], size)]
            ok[at] = np.add.reduceat(differ, np.cumsum(size) - size) == 0
    return ok


class Windows:
    """The distinct windows of m words of a block's items: sorted hashes, a place of each, and the set of items that hold it."""

    def __init__(self, words: Words, m: int, at: np.ndarray):
        self.m, self.words = m, words
        keys = words.grams(m)[at]
        order = np.lexsort((at, keys))
        keys, at = keys[order], at[order]
        # equal hashes of different words (none in practice) stay apart: a window joins the one before it only if their words agree
        new = np.ones(len(at), bool)
        if len(at) > 1:
            twin = np.flatnonzero(keys[1:] == keys[:-1])
            new[1 + twin[same_windows(words, at[1 + twin], words, at[twin], m)]] = False
        first = np.flatnonzero(new)
        self.keys, self.at = keys[first], at[first]
        items = words.text[at]
        sets: dict[tuple, int] = {}
        self.set_of = np.array([sets.setdefault(tuple(np.unique(items[a:b]).tolist()), len(sets)) for a, b in zip(first, np.append(first[1:], len(at))[: len(first)], strict=True)], np.int64)
        self.sets = list(sets)
        self.most = int(np.unique(self.keys, return_counts=True)[1].max(initial=0))  # windows of one hash

    def found(self, words: Words, grams: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in words, set of items) of the windows at places that the block holds."""
        out = []
        lo = np.searchsorted(self.keys, grams[places])
        for k in range(self.most):
            at = np.minimum(lo + k, len(self.keys) - 1)
            some = np.flatnonzero((lo + k < len(self.keys)) & (self.keys[at] == grams[places]))
            some = some[same_windows(words, places[some], self.words, self.at[at[some]], self.m)]
            out.append((places[some], self.set_of[at[some]]))
        return (np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])) if out else (np.zeros(0, np.int64), np.zeros(0, np.int64))


class Index:
    """A block of the benchmark, ready for lookups."""

    def __init__(self, ids: list, texts: list, span: int, k: int):
        self.ids, self.span, self.k, self.window = ids, span, k, span - k + 1
        words = Words(*flat_text(pa.array(texts, pa.large_string())))
        counts = np.diff(words.first)
        ends = words.grams(span) != np.iinfo(np.uint64).max  # whole windows
        self.prints = np.unique(words.grams(k)[winnow(words.grams(k), self.window)])
        self.tables = [Windows(words, span, np.flatnonzero(ends))]
        for m in sorted({int(m) for m in counts if 0 < m < span}):
            self.tables.append(Windows(words, m, words.first[:-1][counts == m]))

    def hits(self, words: Words) -> Iterator[tuple[np.ndarray, int, np.ndarray, list[tuple]]]:
        """(places, length, set of items of each, sets) of the hit windows, for each length."""
        for table in self.tables:
            grams = words.grams(table.m)
            whole = grams != np.iinfo(np.uint64).max
            if table.m == self.span:
                short = words.grams(self.k)
                prints = winnow(short, self.window)
                prints = prints[lookup(self.prints, short[prints])[1]]  # fingerprints that both sides have
                at = np.unique((prints[:, None] - np.arange(self.window)).ravel())  # the windows around them
                at = at[at >= 0]
                at = at[whole[at]]
            else:
                at = np.flatnonzero(whole)
            places, sets = table.found(words, grams, at)
            yield places, table.m, sets, table.sets


PASSES = 2  # passes over the documents, each with the index of a block, that a task holds at once


def benchmark_blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list]:
    """Rows of the benchmark in blocks of at most block_bytes of text (or of one item)."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where(F.col("t").isNotNull()).toLocalIterator():
        own = len(row["t"].encode())
        if block and size + own > block_bytes:
            yield block
            block, size = [], 0
        block.append((row["i"], row["t"]))
        size += own
    if block:
        yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", span: int = 10, k: int = 5, block_bytes: int = 16 << 20) -> DataFrame:
    """docs with n_words, the hit spans (first word and end, merged) and the items found, as one struct `__leak`.

    block_bytes bounds what is broadcast at once; every block is searched.
    """
    spark = docs.sparkSession
    out = docs.withColumn("__leak", F.expr("named_struct('n_words', 0L, 'spans', cast(array() as array<struct<a:int,b:int>>), 'items', cast(array() as array<string>))"))
    n = 0
    for block in benchmark_blocks(benchmark, item_id, item_text, block_bytes):
        out = out.mapInArrow(released(_pass(spark.sparkContext.broadcast(block), text, span, k)), out.schema)
        n += 1
        if n % PASSES == 0:
            out = written(out, "leaks")
    if not n:  # no item has a text: words are still counted
        out = out.mapInArrow(released(_pass(spark.sparkContext.broadcast([]), text, span, k)), out.schema)
    return out


def _pass(shared, text: str, span: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([x[0] for x in shared.value], [x[1] for x in shared.value], span, k)
        for whole in batches:
            for batch in pieces_of(whole, text, 2 << 20):
                words = Words(*flat_text(batch.column(text)))
                spans, items = defaultdict(list), defaultdict(set)
                for places, m, sets, named in index.hits(words):
                    of = words.text[places]
                    places = places - words.first[of]
                    order = np.lexsort((places, of))
                    of, places = of[order], places[order]
                    apart = np.concatenate([np.ones(min(1, len(of)), bool), (of[1:] != of[:-1]) | (places[1:] > places[:-1] + m)])
                    first = np.flatnonzero(apart)
                    for t, x, y in zip(of[first].tolist(), places[first].tolist(), (places[np.append(first[1:], len(places)) - 1] + m).tolist() if len(first) else [], strict=True):
                        spans[t].append((x, y))
                    for t, held in np.unique(np.stack([of, sets[order]], axis=1), axis=0).tolist():
                        items[t].update(index.ids[i] for i in named[held])
                leak = batch.schema.field("__leak")
                before = batch.column("__leak").to_pylist() if batch.num_rows else []
                rows = []
                for t, old in enumerate(before):
                    merged: list[dict] = []
                    for a, b in sorted([(s["a"], s["b"]) for s in old["spans"]] + spans[t]) if spans[t] else []:
                        if merged and a <= merged[-1]["b"]:
                            merged[-1]["b"] = max(merged[-1]["b"], b)
                        else:
                            merged.append({"a": a, "b": b})
                    names = sorted({*old["items"], *(str(x) for x in items[t] if x is not None)}) if items[t] else old["items"]
                    rows.append({"n_words": int(words.first[t + 1] - words.first[t]), "spans": merged or old["spans"], "items": names})
                yield batch.set_column(batch.schema.get_field_index("__leak"), leak, pa.array(rows, leak.type))

    return run


def remove_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """docs without the contaminated ones, same columns."""
    return decontaminate(docs, benchmark, **options).where(F.size("__leak.spans") == 0).drop("__leak")
