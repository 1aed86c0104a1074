"""Language identification by rank-order profiles.

Texts become words of letters (runs of letters, lower-cased letter by letter), each with a blank at both ends; their runs of
1 to 3 characters are counted. A language's profile is its `top` most frequent n-grams over all its training texts, in
order. A text's own most frequent n-grams are ranked the same way, and its distance to a language is the sum, over them,
of how far each is out of place there; an n-gram that the profile lacks is `top` places out. The least distance wins.
Equally frequent n-grams of a text share the mean of their places, so that short texts are not ranked by the alphabet.

Counting: each task counts n-grams per language piece by piece, adds counts up until there are many, and sends
(language, n-gram, count); these are summed by language and n-gram, and the top ones per language are found by partial
limits in every task before they meet. An n-gram is three code points of 21 bits in one integer, so nothing is hashed. The
profiles are `top` rows per language; they are named to all tasks, and more than `most_languages` languages are an error.

Defined cases: a null text, or one without letters, is `und` with score 0 and teaches nothing, as does a row with a null
language; without anything learned every text is `und`; equal distances go to the language that sorts first; rows that
repeat are judged one by one and counted as often as they occur; an empty table gives an empty result; very long texts
are counted in slices, whole. All columns are kept; a column named `__lang` is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import count_sorted, flat_text, lookup, pieces_of, released

BITS = 21
SLICE = 1 << 20  # characters that are counted at once
HELD = 1 << 18  # n-grams that a task holds before it sends their counts
_TABLE: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Lower-case letter of each code point; 0 for what is no letter."""
    if not _TABLE:
        out = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                small = c.lower()
                out[i] = ord(small) if len(small) == 1 else i
        _TABLE.append(out)
    return _TABLE[0]


def _keys(points: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram, group) of all runs of 1 to 3 characters; points hold 0 before, after and between words."""
    solid = (points != 0) | np.concatenate([[True], points[:-1] != 0])
    p, g = points[solid].astype(np.int64), group[solid]
    one = p != 0
    out, groups = [p[one]], [g[one]]
    if len(p) > 1:
        out.append(p[:-1] << BITS | p[1:] | (1 << 2 * BITS))  # the mark keeps a leading blank apart from shorter runs
        groups.append(np.where(p[:-1] != 0, g[:-1], g[1:]))
    if len(p) > 2:
        mid = p[1:-1] != 0
        out.append((p[:-2] << 2 * BITS | p[1:-1] << BITS | p[2:] | (1 << 62))[mid])
        groups.append(g[1:-1][mid])
    return np.concatenate(out), np.concatenate(groups)


def _code_points(array) -> tuple[np.ndarray, np.ndarray]:
    """(letters or 0, text of each) of an Arrow string array, with a 0 before each text and at the end."""
    data, offsets = flat_text(array)
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets] if len(data) else np.zeros(len(offsets), np.int64)
    sizes = np.diff(starts) + 1
    out = np.zeros(len(chars) + len(sizes) + 1, np.uint32)
    inner = np.ones(len(out), bool)
    inner[np.cumsum(sizes) - sizes] = False
    inner[-1] = False
    out[inner] = letters()[chars]
    return out, np.concatenate([np.repeat(np.arange(len(sizes)), sizes), [max(len(sizes) - 1, 0)]])


def _count(grams: np.ndarray, groups: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, n-gram, count), sorted by group and n-gram."""
    if not len(grams):
        return groups.astype(np.int64), grams, np.zeros(0, np.int64)
    order = np.lexsort([grams, groups])
    grams, groups = grams[order], groups[order]
    first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (groups[1:] != groups[:-1])]))
    n = np.diff(np.append(first, len(grams))) if weights is None else np.add.reduceat(weights[order], first)
    return groups[first], grams[first], n


def _small_count(points: np.ndarray, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What _count(*_keys(...)) gives, by numbers that are as short as the piece's own letters allow."""
    present = np.flatnonzero(np.bincount(points, minlength=1))
    present = present if len(present) and present[0] == 0 else np.concatenate([[0], present])
    width = max(1, int(len(present) - 1).bit_length())
    if 3 * width + 2 + max(1, int(n_groups).bit_length()) > 62:
        return _count(*_keys(points, group))
    short = np.zeros(int(present[-1]) + 1, np.int64)
    short[present] = np.arange(len(present))
    solid = (points != 0) | np.concatenate([[True], points[:-1] != 0])
    p, g = short[points[solid]], group[solid].astype(np.int64) << (3 * width + 2)
    keys = [p[p != 0] + g[p != 0]]
    keys.append((1 << 3 * width | p[:-1] << width | p[1:]) + np.where(p[:-1] != 0, g[:-1], g[1:]))
    mid = p[1:-1] != 0
    keys.append(((2 << 3 * width | p[:-2] << 2 * width | p[1:-1] << width | p[2:]) + g[1:-1])[mid])
    keys = np.sort(np.concatenate(keys))
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]]))
    n = np.diff(np.append(first, len(keys)))
    keys = keys[first]
    groups, kind, mask = keys >> (3 * width + 2), keys >> 3 * width & 3, (1 << width) - 1
    a, b, c = (present[keys >> s & mask].astype(np.int64) for s in (2 * width, width, 0))
    return groups, np.choose(kind, [c, 1 << 2 * BITS | b << BITS | c, 1 << 62 | a << 2 * BITS | b << BITS | c]), n


def counted(array, group: np.ndarray, n_groups: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(group, n-gram, count) over an Arrow string array whose texts belong to groups."""
    points, text = _code_points(array)
    group = group[text] if len(group) else np.zeros(len(points), np.int64)
    if len(points) <= 2 * SLICE:
        return _small_count(points, group, n_groups)
    out, a = [], 0
    blank = np.flatnonzero(points == 0)
    while a < len(points) - 1:  # slices end at a blank that the next one begins with; a word that is longer makes a longer slice
        b = int(blank[min(np.searchsorted(blank, a + SLICE), len(blank) - 1)])
        out.append(_small_count(points[a : b + 1], group[a : b + 1], n_groups))
        a = b
    groups, grams, n = (np.concatenate(x) for x in zip(*out, strict=True))
    return _count(grams, groups, n)


def learn(docs: DataFrame, lang: str = "lang", text: str = "text", top: int = 300) -> DataFrame:
    """(lang, gram, rank from 0): the profile of every language over all rows of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for name, (grams, n) in held.items():
                yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(grams), pa.string()), "gram": grams, "n": n})
            held.clear()

        for whole in batches:
            for batch in pieces_of(whole, "text"):
                coded = batch.column("lang").dictionary_encode()
                names = coded.dictionary.to_pylist()
                groups, grams, n = counted(batch.column("text"), coded.indices.to_numpy().astype(np.int64), len(names))
                bounds = np.searchsorted(groups, np.arange(len(names) + 1))
                for k, name in enumerate(names):
                    a, b = bounds[k], bounds[k + 1]
                    old = held.get(name, (grams[:0], n[:0]))
                    held[name] = count_sorted(np.concatenate([old[0], grams[a:b]]), np.concatenate([old[1], n[a:b]]))
                if sum(len(x[0]) for x in held.values()) > HELD:
                    yield from sent()
        yield from sent()

    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = rows.mapInArrow(released(run), "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("place", place).where(F.col("place") <= top).select("lang", "gram", (F.col("place") - 1).alias("rank"))  # limited in every task first


class Profiles:
    """Languages' ranks of all n-grams of their profiles, ready for lookups."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int):
        self.names = sorted({r[0] for r in rows})
        self.grams = np.array(sorted({r[1] for r in rows}), np.int64)
        self.top = top
        at = {name: i for i, name in enumerate(self.names)}
        self.ranks = np.full((len(self.grams) + 1, len(self.names)), np.nan)  # the last row is for unknown n-grams
        for name, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), at[name]] = rank

    def judge(self, texts) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text of an Arrow string array."""
        size = len(texts)
        groups, grams, n = counted(texts, np.arange(size), size)
        order = np.lexsort([grams, -n, groups])
        groups, grams, n = groups[order], grams[order], n[order]
        place = np.arange(len(groups)) - np.searchsorted(groups, groups)
        change = np.concatenate([np.ones(min(1, len(n)), bool), (n[1:] != n[:-1]) | (groups[1:] != groups[:-1])])
        tie = np.cumsum(change) - 1
        shared = np.bincount(tie, place)[tie] / np.bincount(tie)[tie] if len(tie) else place.astype(float)
        in_top = place < self.top
        groups, grams, shared = groups[in_top], grams[in_top], shared[in_top]
        at, known = lookup(self.grams, grams)
        out = np.abs(self.ranks[np.where(known, at, len(self.grams))] - shared[:, None])
        out = np.minimum(np.where(np.isnan(out), self.top, out), self.top)
        own = np.bincount(groups, minlength=size)
        if not self.names:
            return ["und"] * size, np.zeros(size)
        distance = np.stack([np.bincount(groups, out[:, k], size) for k in range(len(self.names))], axis=1)
        best = np.argmin(np.round(distance, 6), axis=1)
        score = np.where(own > 0, 1 - distance[np.arange(size), best] / np.maximum(own * self.top, 1), 0.0)
        return [self.names[k] if m else "und" for k, m in zip(best, own, strict=True)], np.clip(score, 0, 1)


def identify(docs: DataFrame, profiles: DataFrame, text: str = "text", top: int = 300, most_languages: int = 2000) -> DataFrame:
    """docs with a struct `__lang` (pred, score). profiles come from learn() with the same top."""
    rows = [(r["lang"], r["gram"], r["rank"]) for r in profiles.limit(top * most_languages + 1).collect()]
    if len(rows) > top * most_languages:
        raise ValueError(f"more than {most_languages} languages")
    shared = docs.sparkSession.sparkContext.broadcast(rows)
    schema = T.StructType([f for f in docs.schema if f.name != "__lang"] + [T.StructField("__lang", T.StructType([T.StructField("pred", T.StringType()), T.StructField("score", T.DoubleType())]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(shared.value, top)
        for whole in batches:
            for batch in pieces_of(whole, text):
                names, scores = known.judge(batch.column(text))
                found = pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["pred", "score"])
                yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in schema if f.name != "__lang"] + [found], [f.name for f in schema])

    return docs.mapInArrow(released(run), schema)


def language_id(docs: DataFrame, train: Column, lang: str = "lang", text: str = "text", top: int = 300) -> DataFrame:
    """docs with `__lang`, learned from those of its rows for which train holds."""
    return identify(docs, learn(docs.where(train), lang, text, top), text, top)
