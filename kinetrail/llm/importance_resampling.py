"""Target-distribution importance resampling with a dictionary of distinct features.

1. Documents are cut into blocks of bounded bytes. A block keeps its distinct n-gram strings with their counts and, packed,
   how often each of its documents holds each of them.
2. The dictionary: the blocks' strings are counted over documents and target together, and each distinct string is hashed
   to its bucket once. Buckets are added up from the dictionary; their gains (as many rows as buckets, a parameter) are
   named to all tasks and give every string of the dictionary its gain.
3. Gains are joined back to the blocks' strings. A string has one row in a block, however many documents hold it, so the
   commonest one has no more rows than there are blocks. Each block then weighs its own documents.
4. Scores are sorted by ranges of equal size; a rank is the number of rows in earlier ranges plus the place in its own.

Numbers: features are the runs of 1 to `most` consecutive words of a text, A-Z lower-cased. With S and T features in all
documents and targets, s and t in a bucket of n, the bucket's gain is floor(1000 ln((t+1)(S+n) / ((s+1)(T+n)))). A weight
is the floored mean of gains over a document's features, and Gumbel noise from a hash of seed and id is added to it.

Defined cases: a null or empty text has no features, weight 0, and is never drawn; an empty target makes rare buckets
gain; rows that repeat are scored and drawn one by one, next to each other; equal scores go to the smaller id, a null id
comes last and has the noise of an empty id; an empty table gives an empty result. Other columns than id and text, whatever
their names, are left out of the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat_text, pack, pieces_of, released, spans_to_index, unpack
from .components import written
from .words import Words

BLOCK = "block long, ids array<long>, counts binary, words binary, feature array<string>, n array<long>, docs binary, codes binary, times binary"


def features(words: Words, most: int) -> tuple[pa.DictionaryArray, np.ndarray]:
    """(n-gram strings, text of each) of all runs of 1..most words."""
    out, texts = [], []
    length = words.end - words.start
    for n in range(1, most + 1):
        at = np.arange(max(len(length) - n + 1, 0))
        at = at[words.text[at] == words.text[at + n - 1]] if n > 1 else at
        sizes = sum((length[at + j] for j in range(n)), np.zeros(len(at), np.int64)) + n - 1
        ends = np.cumsum(sizes)
        flat = np.full(int(ends[-1]) if len(ends) else 0, 32, np.uint8)
        place = ends - sizes
        for j in range(n):
            flat[spans_to_index(place, length[at + j])] = words.data[spans_to_index(words.start[at + j], length[at + j])]
            place = place + length[at + j] + 1
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        out.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]))
        texts.append(words.text[at])
    return pa.concat_arrays(out).dictionary_encode(), np.concatenate(texts)


def _blocks(text: str, id: str, most: int, block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for whole in batches:
            for batch in pieces_of(whole, text, block_bytes):
                words = Words(*flat_text(batch.column(text)), hashed=False)
                coded, docs = features(words, most)
                codes, distinct = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
                pairs, times = np.unique(docs * max(distinct, 1) + codes, return_counts=True)
                docs, codes = np.divmod(pairs, max(distinct, 1))
                n = np.bincount(codes, times, distinct).astype(np.int64)
                rows = {
                    "block": [block],
                    "ids": [batch.column(id).cast(pa.int64()).to_pylist()],
                    "counts": [pack(np.bincount(docs, times, batch.num_rows).astype(np.int64))],
                    "words": [pack(np.diff(words.first).astype(np.int64))],
                    "feature": pa.ListArray.from_arrays(pa.array([0, distinct], pa.int32()), coded.dictionary.cast(pa.large_string()).cast(pa.string())),
                    "n": pa.ListArray.from_arrays(pa.array([0, distinct], pa.int32()), pa.array(n)),
                    "docs": [pack(np.diff(docs, prepend=0).astype(np.uint32))],
                    "codes": [pack(np.diff(codes, prepend=0).astype(np.int32))],
                    "times": [pack(times.astype(np.uint32))],
                }
                yield pa.RecordBatch.from_pydict(rows)
                block += 1

    return run


def blocks(frame: DataFrame, id: Column, text: str, most: int, block_bytes: int) -> DataFrame:
    small = frame.select(id.cast("long").alias("id"), F.col(text).alias("text"))
    return small.mapInArrow(released(_blocks("text", "id", most, block_bytes)), BLOCK)


def gain(s: Column, t: Column, all_s: Column, all_t: Column, buckets: int) -> Column:
    ratio = (t.cast("double") + 1) * (all_s.cast("double") + buckets) / ((s.cast("double") + 1) * (all_t.cast("double") + buckets))
    return F.floor(1000 * F.log(ratio)).cast("long")


def noise(id: Column, seed: str) -> Column:
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296))).cast("long")


def dictionary(parts: DataFrame, target: DataFrame, buckets: int) -> DataFrame:
    """(feature, gain) of every distinct string of the documents' blocks."""

    def strings(frame: DataFrame, side: str) -> DataFrame:
        rows = frame.select(F.explode(F.arrays_zip("feature", "n")).alias("x")).select("x.feature", "x.n")
        return rows.select("feature", *[(F.col("n") if c == side else F.lit(0).cast("long")).alias(c) for c in ("s", "t")])

    both = strings(parts, "s").unionByName(strings(target, "t")).groupBy("feature").agg(F.sum("s").alias("s"), F.sum("t").alias("t"))
    both = written(both.withColumn("bucket", (F.crc32("feature") % buckets).cast("int")), "feature-dictionary")
    filled = written(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "feature-buckets")
    total = filled.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    gains = filled.crossJoin(F.broadcast(total)).select("bucket", gain(F.col("s"), F.col("t"), F.col("all_s"), F.col("all_t"), buckets).alias("gain"))  # total has one row
    return both.where("s > 0").join(F.broadcast(gains), "bucket").select("feature", "gain")  # gains has as many rows as buckets


def _weigh(left: pa.Table, right: pa.Table) -> pa.Table:
    block = left.to_pylist()[0]
    gains = np.zeros(right.num_rows, np.int64)
    gains[right.column("pos").to_numpy()] = right.column("gain").to_numpy()
    docs = np.cumsum(unpack(block["docs"], np.uint32), dtype=np.int64)
    codes = np.cumsum(unpack(block["codes"], np.int32), dtype=np.int64)
    sums = np.zeros(len(block["ids"]), np.int64)
    np.add.at(sums, docs, gains[codes] * unpack(block["times"], np.uint32).astype(np.int64))
    counts = unpack(block["counts"], np.int64)
    return pa.table({"id": pa.array(block["ids"], pa.int64()), "n_words": unpack(block["words"], np.int64), "n_features": counts, "weight": sums // np.maximum(counts, 1)})


def weigh(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", most: int = 1, buckets: int = 10_000, block_bytes: int = 8 << 20) -> DataFrame:
    """(id, n_words, n_features, weight) of every row of docs."""
    parts = written(blocks(docs, F.col(id), text, most, block_bytes), "feature-blocks")
    wanted = blocks(target, F.lit(None), target_text, most, block_bytes)
    gains = dictionary(parts, wanted, buckets)
    held = parts.select(F.col("block").alias("of"), F.posexplode("feature").alias("pos", "feature"))
    found = held.join(gains, "feature").select("of", "pos", "gain")
    packed = parts.select("block", "ids", "counts", "words", "docs", "codes", "times")
    return packed.groupBy("block").cogroup(found.groupBy("of")).applyInArrow(_weigh, "id long, n_words long, n_features long, weight long")


def ranked(frame: DataFrame, order: list[Column], draw: Column, percent: int) -> DataFrame:
    """frame with `rank`: 1, 2, 3... in the given order of the first percent % of the rows for which draw holds; null elsewhere."""
    spark = frame.sparkSession
    rows = frame.withColumn("__draw", F.coalesce(draw, F.lit(False))).repartitionByRange(F.desc("__draw"), *order).sortWithinPartitions(F.desc("__draw"), *order)
    rows = written(rows.withColumn("__at", F.monotonically_increasing_id()), "ranked")
    ranges = rows.groupBy(F.shiftright("__at", 33).alias("range")).agg(F.count(F.lit(1)).alias("n"), F.count_if("__draw").alias("drawable")).orderBy("range").collect()  # a row per partition
    starts, before = [], 0
    for r in ranges:
        starts.append((r["range"], before))
        before += r["n"]
    most = percent * sum(r["drawable"] for r in ranges) // 100
    starts = spark.createDataFrame(starts or [(0, 0)], "range long, before long")
    place = F.col("before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    rows = rows.withColumn("range", F.shiftright("__at", 33)).join(F.broadcast(starts), "range")
    return rows.select(*frame.columns, F.when(place <= most, place).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, id: str = "doc_id", text: str = "text", target_text: str = "text", most: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: str = "2024", block_bytes: int = 8 << 20) -> DataFrame:
    """One row per row of docs: id, n_features, weight, score and, for those drawn, rank.

    Of the rows with at least min_words words, the percent % with the highest scores are drawn. block_bytes bounds what a task
    holds at once (but for one text that is longer); it changes no result.
    """
    scored = weigh(docs, target, id, text, target_text, most, buckets, block_bytes)
    scored = scored.withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("weight")]
    return ranked(scored, order, F.col("n_words") >= min_words, percent).select(F.col("id").alias(id), "n_features", "weight", "score", "rank")
