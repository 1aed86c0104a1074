"""Token ids of documents in binary shards with Elias-Fano document boundaries.

Documents are range-sorted by id; every task tokenizes its range and writes shards of bounded size: a head, the ids in two
or four bytes each, and two Elias-Fano sequences, the documents' ids and where each document ends. Shards are written
under temporary names and renamed; only those that the manifest lists count, so a repeated task leaves no trace.

Pieces of texts are encoded once per worker and reused where the tokenizer allows it: where it drops white space, never
matches across it, and parts letters from other characters (its file says so: WORD_SPLIT), the ids of a text are those of such pieces,
one after another. With any other tokenizer texts are encoded whole.

Defined cases: other columns are left out; a very long text is encoded like others, in a slice of its own; a null text is empty and has the end id alone; documents without id come first; equal ids are ordered by
text; repeated rows are written each; an empty table makes no shard.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WordCache, open_fs, pieces_of
from .elias_fano import EliasFano, encode

MAGIC = b"KTIDS001"
HEAD = struct.Struct("<8sIIQQ")  # magic, bytes of an id, documents without id, documents, ids
MANIFEST = "part int, seq int, path string, n_docs long, n_ids long"


@lru_cache(2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: Letters whose lower case and class are the same for Python and the tokenizer; the tokenizer parts runs of them from what
#: is between, except at apostrophes (contractions) and in special tokens. Other texts are cut at spaces and line ends only.
OTHER = re.compile(r"<\||[^\x00-\x7fß-öø-ÿ]")
LETTERS = re.compile(r"[a-zß-öø-ÿ]+")
PLAIN = re.compile(r"[a-zß-öø-ÿ]+|[^ \na-zß-öø-ÿ]+")
QUOTED = re.compile(r"[^ \n]*'[^ \n]*|[a-zß-öø-ÿ]+|[^ \na-zß-öø-ÿ']+")


def pieces_of_text(text: str) -> list[str]:
    low = text.lower()
    if OTHER.search(low):
        return [w for w in text.replace("\n", " ").split(" ") if w]
    return (QUOTED if "'" in low else PLAIN).findall(low)


#: Fixed value: the pattern by which a tokenizer must split texts, all else being dropped, for pieces to be coded apart.
WORD_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def splits_words(t) -> bool:
    """Whether the tokenizer lower-cases and then keeps the matches of WORD_SPLIT alone."""
    rules = json.loads(t.to_str())
    steps = (rules.get("normalizer") or {}).get("normalizers", [])
    split = next(iter((rules.get("pre_tokenizer") or {}).get("pretokenizers", [])), {})
    return [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and split.get("type") == "Split" and split["pattern"] == {"Regex": WORD_SPLIT} and split["behavior"] == "Removed" and split["invert"]


@lru_cache(2)
def word_cache(path: str) -> WordCache:
    """Ids of pieces of texts, kept for the life of the worker."""
    t = tokenizer(path)

    vocabulary = t.get_vocab()
    suffix = getattr(t.model, "end_of_word_suffix", None)
    ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
    if suffix:
        ends_word[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True

    def encode_apart(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [e.ids for e in t.encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths

    def encode_pieces(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words of letters are coded many at a time: each ends with the one token of it that has the word-end suffix."""
        letters = [bool(suffix) and LETTERS.fullmatch(p) is not None for p in pieces]
        words = [p for p, alone in zip(pieces, letters, strict=True) if alone]
        flat, _ = encode_apart([" ".join(words[i : i + 256]) for i in range(0, len(words), 256)])
        ends = np.flatnonzero(ends_word[flat]) + 1
        if len(ends) != len(words):  # not a tokenizer that marks the ends of words
            return encode_apart(pieces)
        rest, rest_lengths = encode_apart([p for p, alone in zip(pieces, letters, strict=True) if not alone])
        alone = np.array(letters, bool)
        lengths = np.empty(len(pieces), np.int64)
        lengths[alone], lengths[~alone] = np.diff(ends, prepend=0), rest_lengths
        out = np.empty(int(lengths.sum()), np.uint32)
        mine = np.repeat(alone, lengths)
        out[mine], out[~mine] = flat, rest
        return out, lengths

    cache = WordCache(encode_pieces, 500_000) if splits_words(t) else WordCache(encode_apart, 0)
    cache.split = pieces_of_text if splits_words(t) else lambda text: [text]
    return cache


def encode_texts(texts: list[str | None], cache: WordCache, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(flat ids with the end id after each text, ids of each text)."""
    words: list[str] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            found = cache.split(t)
            counts[i] = len(found)
            words += found
    flat, lengths = cache.lookup(words)
    ends = np.concatenate([[0], np.cumsum(lengths)])[np.cumsum(counts)]
    return np.insert(flat, ends, np.uint32(end_id)), np.diff(ends, prepend=0) + 1


class ShardWriter:
    """Rolls shards of at most max_ids ids (or of one slice of documents)."""

    def __init__(self, folder: str, part: int, width: int, max_ids: int):
        self.fs, self.folder = open_fs(folder)
        self.part, self.width, self.max_ids, self.seq = part, width, max_ids, 0
        self.fs.create_dir(self.folder, recursive=True)
        self.ids: list = []
        self.sizes: list[np.ndarray] = []
        self.flats: list[np.ndarray] = []
        self.n = 0

    def add(self, ids: list, flat: np.ndarray, sizes: np.ndarray) -> Iterator[tuple]:
        if self.n and self.n + len(flat) > self.max_ids:
            yield self.roll()
        self.ids += ids
        self.sizes.append(sizes)
        self.flats.append(flat.astype(f"<u{self.width}"))
        self.n += len(flat)

    def roll(self) -> tuple:
        known = [x for x in self.ids if x is not None]
        body = [f.tobytes() for f in self.flats] + [encode(np.array(known, np.int64)), encode(np.cumsum(np.concatenate(self.sizes)))]
        path = f"{self.folder}/ids-{self.part:06d}-{self.seq:05d}.bin"
        temporary = f"{self.folder}/_{uuid.uuid4().hex}"
        with self.fs.open_output_stream(temporary) as out:
            out.write(HEAD.pack(MAGIC, self.width, len(self.ids) - len(known), len(self.ids), self.n))
            for b in body:
                out.write(b)
        self.fs.move(temporary, path)
        row = (self.part, self.seq, path.rsplit("/", 1)[1], len(self.ids), self.n)
        self.ids, self.sizes, self.flats, self.n, self.seq = [], [], [], 0, self.seq + 1
        return row


def write_token_ids(docs: DataFrame, folder: str, path: str, end_id: int, id: str = "doc_id", text: str = "text", max_ids: int = 16_000_000) -> None:
    """Writes docs' ids as shards into folder, a URI that all executors reach. path: the tokenizer's file."""
    from pyspark import TaskContext

    width = 2 if max(tokenizer(path).get_vocab_size(), end_id + 1) <= 1 << 16 else 4
    rows = docs.select(F.col(id).cast("long").alias("i"), F.col(text).alias("t"))
    sorted_rows = rows.repartitionByRange("i").sortWithinPartitions("i", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, cache = ShardWriter(folder, TaskContext.get().partitionId(), width, max_ids), word_cache(path)
        manifest: list[tuple] = []
        for whole in batches:
            for batch in pieces_of(whole, "t", 4 << 20):  # words that a slice repeats are looked up once
                flat, sizes = encode_texts(batch.column("t").to_pylist(), cache, end_id)
                manifest += writer.add(batch.column("i").to_pylist(), flat, sizes)
        if writer.ids:
            manifest.append(writer.roll())
        names = [x.split()[0] for x in MANIFEST.split(", ")]
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in manifest], types[i]) for i in range(5)], names)

    sorted_rows.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/_manifest")


class Shard:
    def __init__(self, data: bytes):
        magic, self.width, self.nulls, self.n_docs, self.n_ids = HEAD.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.ids = np.frombuffer(data, f"<u{self.width}", self.n_ids, HEAD.size)
        rest = memoryview(data)[HEAD.size + self.width * self.n_ids :]
        self.doc_ids = EliasFano(rest)
        self.ends = EliasFano(rest[self.doc_ids.size :])

    def document(self, i: int) -> np.ndarray:
        """The i-th document's ids, without reading the other boundaries."""
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def read_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids (packed little-endian unsigned 32-bit integers)."""
    manifest = spark.read.parquet(f"{folder}/_manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    manifest = manifest.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))
    tasks = manifest.select("path", "base").repartition(max(1, manifest.count()))  # a task per shard

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(folder)
        for batch in batches:
            for name, base in zip(*(batch.column(c).to_pylist() for c in ("path", "base")), strict=True):
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    shard = Shard(f.read())
                for a in range(0, shard.n_docs, 1024):
                    b = min(a + 1024, shard.n_docs)
                    first, part = shard.ends.select(a - 1) if a else 0, shard.ends.between(a, b)
                    ids = [None] * max(0, min(b, shard.nulls) - a) + shard.doc_ids.between(max(0, a - shard.nulls), max(0, b - shard.nulls)).tolist()
                    offsets = np.concatenate([[first], part])
                    flat = shard.ids[first : int(part[-1])].astype("<u4")
                    packed = pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(((offsets - first) * 4).astype(np.int32)), pa.py_buffer(flat)])
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(base + offsets[:-1]), pa.array(np.diff(offsets)), packed], ["doc_id", "start", "n_tokens", "ids"])

    return tasks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
