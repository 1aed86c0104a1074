"""SentencePiece BPE encoding and decoding with vectorised merge rounds.

The words of a batch lie in flat numpy arrays of symbols. In each round the minimum pair rank of every word is taken
(segmented minimum), the leftmost pair of that rank is merged in all words at once, the arrays are compacted, and words
without a pair leave. Where a piece can take part in no better pair (known from the vocabulary), all its
occurrences in the word are merged in one round, leftmost first, which gives the same result in fewer rounds.

Texts are cut into words only where no piece of the vocabulary reaches across: before a word-start mark that follows
another character, and around line ends. That is checked against the vocabulary when the model is loaded. Each worker
keeps the ids of recent words, within a bound.

Defined cases: a null or empty text has no pieces, only begin and end; very long texts and words are taken whole; repeated
rows are coded one by one; an empty table gives an empty result; other columns are kept, but those named as the results are replaced.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import WordCache, flat_text, pieces_of, released, spans_to_index

MARK = "▁"
NONE = np.iinfo(np.int32).max
UNKNOWN = 1 << 20  # symbol of a character without a piece: UNKNOWN + code point
codecs.register_error("piece", lambda e: ("�", e.start + 1))


class Model:
    """A BPE model file's vocabulary, as arrays."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kinds = proto.normalizer_spec, pb.ModelProto.SentencePiece
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.add_dummy_prefix or not norm.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte fallback, identity normalisation and a dummy prefix are supported")
        if any(p.type in (kinds.USER_DEFINED, kinds.UNUSED) for p in proto.pieces):
            raise ValueError("user-defined and unused pieces are not supported")
        self.bos, self.eos = proto.trainer_spec.bos_id, proto.trainer_spec.eos_id
        n = len(proto.pieces)
        ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL}
        self.bytes = np.zeros(256, np.uint32)
        surface = []
        self.is_byte, self.is_control, self.marked = np.zeros(n, bool), np.zeros(n, bool), np.zeros(n, bool)
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                b = int(p.piece[1:-1], 16)
                self.bytes[b], self.is_byte[i] = i, True
                surface.append(bytes([b]))
            elif p.type == kinds.CONTROL:
                self.is_control[i] = True
                surface.append(b"")
            elif p.type == kinds.UNKNOWN:
                surface.append(proto.trainer_spec.unk_surface.encode())
            else:
                self.marked[i] = p.piece.startswith(MARK)
                surface.append(p.piece.replace(MARK, " ").encode())
        self.surface = np.frombuffer(b"".join(surface), np.uint8)
        self.surface_len = np.array([len(s) for s in surface], np.int64)
        self.surface_at = np.cumsum(self.surface_len) - self.surface_len
        long = [p for p in ids if len(p) > 1]
        self.chars = {c: i for c, i in ids.items() if len(c) == 1}
        symbol = dict(ids) | {c: UNKNOWN + ord(c) for p in long for c in p if c not in ids}
        order = {s: k for k, s in enumerate(sorted({proto.pieces[ids[p]].score for p in long}, reverse=True))}
        rank = {p: order[proto.pieces[ids[p]].score] for p in long}
        table = sorted(((symbol[p[:k]] << 32) | symbol[p[k:]], rank[p], ids[p]) for p in long for k in range(1, len(p)) if p[:k] in symbol and p[k:] in symbol)
        self.keys, self.ranks, self.merged = (np.array(x, t) for x, t in zip(zip(*table, strict=True), (np.int64, np.int32, np.int32), strict=True))
        own = np.full(n, -1, np.int64)
        for p in long:
            own[ids[p]] = rank[p]
        self.alone = np.ones(n, bool)  # pieces that are part of no pair of their own rank or a better one
        for part in (self.keys >> 32, self.keys & 0xFFFFFFFF):
            known = part < n
            part, best = part[known], self.ranks[known]
            self.alone[part[best <= own[part]]] = False
        marks = any(re.search(f"[^{MARK}]{MARK}", p) for p in long)
        lines = any("\n" in p for p in long)
        self.word = re.compile(".+" if marks else f"{MARK}*[^{MARK}]+|{MARK}+" if lines else f"{MARK}*[^{MARK}\n]+|{MARK}+|\n", re.DOTALL)

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged piece of each pair of symbols; rank NONE where there is none."""
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids, ids of each word)."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        kinds, inverse = np.unique(points, return_inverse=True)
        symbols = np.array([self.chars.get(chr(c), UNKNOWN + int(c)) for c in kinds], np.int64)[inverse] if len(points) else np.zeros(0, np.int64)
        flat, word = self._merge(symbols, np.repeat(np.arange(len(words)), lengths))
        if len(odd := np.flatnonzero(flat >= UNKNOWN)):
            sizes = np.ones(len(flat), np.int64)
            coded = {int(c): self.bytes[list(chr(c - UNKNOWN).encode("utf-8", "surrogatepass"))] for c in np.unique(flat[odd])}
            sizes[odd] = [len(coded[int(c)]) for c in flat[odd]]
            out = np.repeat(flat, sizes)
            at = np.cumsum(sizes) - sizes
            out[spans_to_index(at[odd], sizes[odd])] = np.concatenate([coded[int(c)] for c in flat[odd]])
            flat, word = out, np.repeat(word, sizes)
        return flat.astype(np.uint32), np.bincount(word, minlength=len(words)).astype(np.int64)

    def _merge(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their words once no pair remains."""
        ready = []
        rank, to = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int32)

        def refresh(at: np.ndarray) -> None:
            at = at[(at >= 0) & (at < len(sym))]
            inner = at[at < len(sym) - 1]
            inner = inner[word[inner] == word[inner + 1]]
            rank[at] = NONE
            rank[inner], to[inner] = self.pair(sym[inner], sym[inner + 1])

        refresh(np.arange(len(sym)))
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            best = np.minimum.reduceat(rank, first)
            size = np.diff(np.append(first, len(sym)))
            if (over := best == NONE).any():
                gone = np.repeat(over, size)
                ready.append((sym[gone], word[gone]))
                sym, word, rank, to = (x[~gone] for x in (sym, word, rank, to))
                best, size = best[~over], size[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == np.repeat(best, size))
            run = np.concatenate([[True], (at[1:] != at[:-1] + 1)])
            start = np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            lead = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            at = at[lead | (self.alone[to[at]] & ((np.arange(len(at)) - start) % 2 == 0))]
            sym[at] = to[at]
            left = np.ones(len(sym), bool)
            left[at + 1] = False
            at = at - np.arange(len(at))
            sym, word, rank, to = (x[left] for x in (sym, word, rank, to))
            refresh(np.concatenate([at, at - 1]))
        if not ready:
            return sym, word
        sym, word = (np.concatenate(x) for x in zip(*ready, strict=True))
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def encode_batch(self, texts: list[str | None], cache: WordCache) -> tuple[np.ndarray, np.ndarray]:
        """(flat ids with begin and end, ids of each text)."""
        words: list[str] = []
        counts = np.zeros(len(texts), np.int64)
        for i, t in enumerate(texts):
            if t:
                found = self.word.findall(MARK + t.replace(" ", MARK))
                counts[i] = len(found)
                words += found
        flat, lengths = cache.lookup(words)
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
        sizes = np.diff(ends, prepend=0)
        out = np.empty(len(flat) + 2 * len(texts), np.uint32)
        at = np.cumsum(sizes + 2) - sizes - 2
        out[at], out[at + sizes + 1] = self.bos, self.eos
        out[spans_to_index(at + 1, sizes)] = flat
        return out, sizes + 2

    def decode_batch(self, flat: np.ndarray, sizes: np.ndarray) -> list[str]:
        """Texts of ids, as the library's decode gives them: control ids vanish, the first piece loses one mark, invalid bytes become U+FFFD."""
        text = np.repeat(np.arange(len(sizes)), sizes)
        solid = np.flatnonzero(~self.is_control[flat])
        first = solid[np.concatenate([[True], text[solid[1:]] != text[solid[:-1]]])] if len(solid) else solid
        cut = np.zeros(len(flat), np.int64)
        cut[first] = self.marked[flat[first]]
        lengths = self.surface_len[flat] - cut
        data = self.surface[spans_to_index(self.surface_at[flat] + cut, lengths)].tobytes()
        ends = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], np.cumsum(sizes)])].tolist()
        return [data[a:b].decode("utf-8", "piece") for a, b in zip(ends[:-1], ends[1:], strict=True)]


@lru_cache(2)
def model(path: str) -> Model:
    return Model(path)


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes * 4)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat, "<u4"))])


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the column `ids`: each text's ids, begin and end included, as packed little-endian unsigned 32-bit integers.

    path is the model file's place on every executor. decoded names a column for the ids' text, made from the ids in the same pass.
    """
    schema = T.StructType([f for f in docs.schema if f.name not in (ids, decoded)] + [T.StructField(ids, T.BinaryType())] + ([T.StructField(decoded, T.StringType())] if decoded else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        cache = WordCache(m.encode_words)
        for whole in batches:
            for batch in pieces_of(whole, text):
                flat, sizes = m.encode_batch(batch.column(text).to_pylist(), cache)
                columns = {f.name: batch.column(f.name) for f in schema if f.name not in (ids, decoded)} | {ids: _binary(flat, sizes)}
                if decoded:
                    columns[decoded] = pa.array(m.decode_batch(flat, sizes), pa.string())
                yield pa.RecordBatch.from_pydict(columns)

    return docs.mapInArrow(released(run), schema)


def decode(frame: DataFrame, path: str, ids: str = "ids", text: str = "text") -> DataFrame:
    """frame with the column `text` decoded from packed ids; null ids give a null text."""
    schema = T.StructType([f for f in frame.schema if f.name != text] + [T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for whole in batches:
            for batch in pieces_of(whole, ids):
                data, offsets = flat_text(batch.column(ids))
                texts = m.decode_batch(np.frombuffer(data.tobytes(), "<u4"), np.diff(offsets) // 4)
                valid = batch.column(ids).is_valid().to_pylist()
                out = pa.array([t if v else None for t, v in zip(texts, valid, strict=True)], pa.string())
                yield pa.RecordBatch.from_pydict({f.name: batch.column(f.name) for f in schema if f.name != text} | {text: out})

    return frame.mapInArrow(released(run), schema)
