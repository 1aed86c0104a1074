"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts up to `order` bytes, trained on the documents not held out. A symbol is predicted in
the longest context that the training texts have; where it was not seen there, the escape probability of method D is paid
and the next shorter context is asked, without the symbols that the longer one has seen (exclusion); below the empty
context all remaining bytes are equally likely. The end of a text is a symbol, so the scores are proper probabilities.

Nothing of the trie is held in one place, as it grows with the corpus. Documents are dealt to chunks of bounded bytes.
Each chunk sends its distinct (context, symbol) grams with their training counts to the part of the trie that the two
latest context bytes name; a part adds up the counts of all chunks, computes the probability of each requested gram once,
and answers each chunk that asked, which then sums over its texts. The same exchange counts words for the unigram base score;
its two totals are added up once. Only the 256 x 256 table of byte pairs (the two lowest orders) is shared with all tasks;
its size is fixed. A part of the trie holds one pair of latest bytes at least, so parts stop shrinking when the commonest
pair fills one.

Probabilities of grams travel as 32-bit floats: the relative error of a score is about 1e-7. The base score is not rounded.

Defined cases: a null or empty text is the end symbol alone; a null doc_id has the empty text's crc32; without any
training text all bytes are equally likely and no token is known; repeated rows count each; an empty table gives an
empty result; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import chunk_count, count_sorted, flat_text, lookup, pack, pack_sorted, pieces_of, spans_to_index, unpack, unpack_sorted
from .components import written
from .words import UNSPACED, Words

START, END = 0xFE, 0xFF  # never bytes of UTF-8
END_TOKEN = np.uint64(1)  # stands for the end among the words' hashes
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
PARTS = "chunk int, bucket int, kind string, a binary, b binary"
REPLIES = "chunk int, bucket int, kind string, a binary, b binary, tokens long, kinds long"
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def symbols(array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes with `order` start marks before and an end mark after each text, the symbols' places, symbols of each text)."""
    data, offsets = flat_text(array)
    sizes = np.diff(offsets)
    starts = offsets[:-1] + np.arange(len(sizes)) * (order + 1) + order
    flat = np.full(len(data) + len(sizes) * (order + 1), START, np.uint8)
    flat[spans_to_index(starts, sizes)] = _LOWER[data]
    flat[starts + sizes] = END
    return flat, spans_to_index(starts, sizes + 1), sizes + 1


def grams(flat: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
    """Context, latest byte first, then the symbol, as one integer."""
    wide = flat.astype(np.uint64)
    n = len(wide) - order
    out = wide[order:].copy()
    for k in range(1, order + 1):
        out |= wide[order - k : order - k + n] << np.uint64(8 * (order + 1 - k))
    return out[at - order]


def pair_counts(training: DataFrame, text: str) -> np.ndarray:
    """256 x 256 counts: how often byte b follows byte a (start mark first, end mark last)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(65536, np.int64)
        for whole in batches:
            for batch in pieces_of(whole, text):
                flat, at, _ = symbols(batch.column(text), 1)
                total += np.bincount(flat[at - 1].astype(np.int64) * 256 + flat[at], minlength=65536)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["pair", "n"])

    counted = training.select(text).mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    out = np.zeros(65536, np.int64)
    for row in counted.collect():  # at most 65536 rows
        out[row["pair"]] = row["n"]
    return out.reshape(256, 256)


class Trie:
    """The part of the trie under some pairs of latest bytes, from its training grams and the table of pairs."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, order: int, pairs: np.ndarray):
        self.order, self.pairs = order, pairs
        self.one_total, self.one_kinds = pairs.sum(1), (pairs > 0).sum(1)
        self.zero = pairs.sum(0)
        self.zero_total, self.zero_kinds = int(self.zero.sum()), int((self.zero > 0).sum())
        self.one_hidden = ((pairs > 0) * self.zero).sum(1)  # of the empty context, seen after each byte
        self.keys, self.counts, self.contexts, self.total, self.kinds, self.hidden = {}, {}, {}, {}, {}, {}
        for d in range(order, 1, -1):
            self.keys[d], self.counts[d] = keys, counts
            context = keys >> np.uint64(8)
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), context[1:] != context[:-1]]))
            self.contexts[d] = context[first]
            self.total[d] = np.add.reduceat(counts, first) if len(first) else counts
            self.kinds[d] = np.diff(np.append(first, len(keys)))
            up = ((keys >> np.uint64(16)) << np.uint64(8)) | (keys & np.uint64(255))
            if d > 2:
                keys, counts = count_sorted(up, counts)
                known = counts[lookup(keys, up)[0]] if len(keys) else counts
            else:
                known = pairs[(up >> np.uint64(8)).astype(np.int64), (up & np.uint64(255)).astype(np.int64)]
            self.hidden[d] = np.add.reduceat(known, first) if len(first) else known[:0]  # of the parent, seen here

    def log10(self, wanted: np.ndarray) -> np.ndarray:
        out, done = np.zeros(len(wanted)), np.zeros(len(wanted), bool)
        hidden_total, hidden_kinds = np.zeros(len(wanted), np.int64), np.zeros(len(wanted), np.int64)
        symbol, context = (wanted & np.uint64(255)).astype(np.int64), wanted >> np.uint64(8)

        def step(there, total, kinds, n):
            total, kinds = total - hidden_total, kinds - hidden_kinds
            live = ~done & there & (total > 0)
            hit = live & (n > 0)
            lost = live & (n == 0)
            out[hit] += np.log10((2 * n[hit] - 1) / (2 * total[hit]))
            out[lost] += np.log10(kinds[lost] / (2 * total[lost]))
            done[hit] = True

        for d in range(self.order, 1, -1):
            if not len(self.keys[d]):
                continue
            c = context >> np.uint64(8 * (self.order - d))
            at, there = lookup(self.contexts[d], c)
            k, seen = lookup(self.keys[d], (c << np.uint64(8)) | symbol.astype(np.uint64))
            step(there, self.total[d][at], self.kinds[d][at], np.where(seen, self.counts[d][k], 0))
            hidden_total, hidden_kinds = np.where(there, self.hidden[d][at], hidden_total), np.where(there, self.kinds[d][at], hidden_kinds)
        last = (context >> np.uint64(8 * (self.order - 1))).astype(np.int64)
        there = self.one_total[last] > 0
        step(there, self.one_total[last], self.one_kinds[last], self.pairs[last, symbol])
        hidden_total, hidden_kinds = np.where(there, self.one_hidden[last], hidden_total), np.where(there, self.one_kinds[last], hidden_kinds)
        every = np.ones(len(wanted), bool)
        step(every, np.full(len(wanted), self.zero_total), np.full(len(wanted), self.zero_kinds), self.zero[symbol])
        out[~done] -= np.log10(256 - self.zero_kinds)
        return out


def chunk_grams(table, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of a chunk, sorted, with their counts in its training texts."""
    own, keys, counts = [], [], []
    for part in pieces_of(table, "text"):
        flat, at, sizes = symbols(part.column("text"), order)
        g = grams(flat, at, order)
        held = np.repeat(np.array(part.column("held").to_pylist(), bool), sizes)
        own.append(np.unique(g[held]))
        k, n = np.unique(g[~held], return_counts=True)
        keys.append(k)
        counts.append(n)
    keys, counts = count_sorted(np.concatenate(keys), np.concatenate(counts))
    every = np.unique(np.concatenate([*own, keys]))
    out = np.zeros(len(every), np.int64)
    out[np.searchsorted(every, keys)] = counts
    return every, out


def chunk_words(table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of a chunk and the end token, sorted, with their counts in its training texts."""
    keys, counts = [], []
    for part in pieces_of(table, "text"):
        words = Words(*flat_text(part.column("text")), UNSPACED)
        train = ~np.array(part.column("held").to_pylist(), bool)
        keys += [words.hash, np.array([END_TOKEN])]
        counts += [train[words.text].astype(np.int64), np.array([train.sum()], np.int64)]
    return count_sorted(np.concatenate(keys), np.concatenate(counts))


def score(docs: DataFrame, held_out: Column, id: str = "doc_id", text: str = "text", order: int = 5, chunk_bytes: int = 16 << 20) -> DataFrame:
    """A row per document: held_out, n_tokens, n_known, train_tokens, base_score (unigram, add one), score (the model's log10 probability).

    chunk_bytes bounds what one task holds of texts. order: 2 to 7 bytes of context.
    """
    if not 2 <= order <= 7:
        raise ValueError("order must be from 2 to 7")
    rows = docs.select(F.col(id).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    n = chunk_count(rows, F.octet_length("text"), chunk_bytes)
    pairs = pair_counts(rows.where(~F.col("held")), "text")
    # parts of the trie: ranges of the two latest bytes with about equal counts
    weight = np.cumsum(pairs.T.ravel())  # by (latest, the one before)
    cuts = np.unique(np.searchsorted(weight, weight[-1] * np.arange(1, n) / n)).astype(np.uint64) << np.uint64(8 * (order - 1))
    word_cuts = (np.arange(1, n, dtype=object) * (1 << 64) // n).astype(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(pairs)
    chunks = rows.withColumn("chunk", F.pmod(F.xxhash64("id", "text"), F.lit(n)).cast("int"))

    def ask(key, table):
        out: list[tuple] = []
        for kind, (keys, counts), edges in (("g", chunk_grams(table, order), cuts), ("w", chunk_words(table), word_cuts)):
            ends = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
            out += [(key[0].as_py(), i, kind, pack_sorted(keys[a:b]), pack(counts[a:b].astype(np.uint32))) for i, (a, b) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if b > a]
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int32()), "bucket": pa.array([x[1] for x in out], pa.int32()), "kind": [x[2] for x in out], "a": pa.array([x[3] for x in out], pa.binary()), "b": pa.array([x[4] for x in out], pa.binary())})

    def answer(key, table):
        bucket, kind = key[0].as_py(), key[1].as_py()
        asked = dict(zip(table.column("chunk").to_pylist(), (unpack_sorted(x) for x in table.column("a").to_pylist()), strict=True))
        counts = np.concatenate([unpack(x, np.uint32) for x in table.column("b").to_pylist()]).astype(np.int64)
        keys = np.concatenate(list(asked.values()))
        trained = counts > 0
        keys, counts = count_sorted(keys[trained], counts[trained])
        out: list[tuple] = []
        if kind == "g":
            trie = Trie(keys, counts, order, shared.value)
            out = [(c, bucket, kind, pack_sorted(g), pack(trie.log10(g).astype(np.float32)), 0, 0) for c, g in asked.items()]
        else:
            for c, words in asked.items():
                at, there = lookup(keys, words)
                found = np.where(there, counts[at], 0) if len(keys) else np.zeros(len(at), np.int64)
                out.append((c, bucket, kind, pack_sorted(words), pack(found.astype(np.uint64)), 0, 0))
            out.append((-1, bucket, "t", None, None, int(counts.sum()), len(keys)))
        return pa.table({"chunk": pa.array([x[0] for x in out], pa.int32()), "bucket": pa.array([x[1] for x in out], pa.int32()), "kind": pa.array([x[2] for x in out], pa.string()), "a": pa.array([x[3] for x in out], pa.binary()), "b": pa.array([x[4] for x in out], pa.binary()), "tokens": pa.array([x[5] for x in out], pa.int64()), "kinds": pa.array([x[6] for x in out], pa.int64())})

    asked = chunks.groupBy("chunk").applyInArrow(ask, PARTS)
    answers = written(asked.groupBy("bucket", "kind").applyInArrow(answer, REPLIES), "grams")
    totals = answers.where("kind = 't'").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).first()
    tokens, kinds = totals["tokens"] or 0, totals["kinds"] or 0

    def total(key, table, replies):
        columns: dict[str, list] = {x.split()[0]: [] for x in SCORES.split(", ")}
        if table.num_rows:
            rows = sorted(zip(*(replies.column(c).to_pylist() for c in ("kind", "bucket", "a", "b")), strict=True), key=lambda x: x[:2])
            known_grams, known_words = (np.concatenate([np.zeros(0, np.uint64)] + [unpack_sorted(a) for k, _, a, _ in rows if k == kind]) for kind in "gw")
            value = np.concatenate([np.zeros(0, np.float32)] + [unpack(b, np.float32) for k, _, _, b in rows if k == "g"]).astype(np.float64)
            count = np.concatenate([np.zeros(0, np.uint64)] + [unpack(b, np.uint64) for k, _, _, b in rows if k == "w"]).astype(np.int64)

            def place(known, wanted):
                at, there = lookup(known, wanted)
                if not there.all():
                    raise RuntimeError("a chunk changed between two passes over the input")
                return at

            end_count = int(count[place(known_words, np.array([END_TOKEN]))[0]])
            norm = np.log10(tokens + kinds + 1)
            for part in pieces_of(table, "text"):
                flat, at, sizes = symbols(part.column("text"), order)
                g = grams(flat, at, order)
                by = np.argsort(g)
                each = np.empty(len(g))
                each[by] = value[place(known_grams, g[by])]
                scores = np.add.reduceat(each, np.cumsum(sizes) - sizes)
                words = Words(*flat_text(part.column("text")), UNSPACED)
                c = count[place(known_words, words.hash)] if len(words.hash) else np.zeros(0, np.int64)
                m = part.num_rows
                base = np.bincount(words.text, np.log10(c + 1), m) + np.log10(end_count + 1)
                n_tokens = np.diff(words.first) + 1
                columns["doc_id"] += part.column("id").to_pylist()
                columns["held_out"] += part.column("held").to_pylist()
                columns["n_tokens"] += n_tokens.tolist()
                columns["n_known"] += (np.bincount(words.text, c > 0, m).astype(np.int64) + (end_count > 0)).tolist()
                columns["train_tokens"] += [tokens] * m
                columns["base_score"] += (base - n_tokens * norm).tolist()
                columns["score"] += scores.tolist()
        types = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
        return pa.table({x.split()[0]: pa.array(columns[x.split()[0]], types[x.split()[1]]) for x in SCORES.split(", ")})

    return chunks.groupBy("chunk").cogroup(answers.where("kind <> 't'").groupBy("chunk")).applyInArrow(total, SCORES)
