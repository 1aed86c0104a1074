"""Importance resampling and language identification: brute force, held-out accuracy and odd tables."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("kinetrail.llm")

from pyspark.sql import functions as F  # noqa: E402

from kinetrail.llm import importance_resampling, language_id, queries  # noqa: E402

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return bytes(c + 32 if 65 <= c < 91 else c for c in (text or "").encode())


def grams(text, most):
    words = WORD.findall(lower(text))
    return words, [b" ".join(words[i : i + n]) for n in range(1, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, most, buckets, percent, min_words):
    def bucket(g):
        return zlib.crc32(g) % buckets

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(bucket, grams(text, most)[1]))
    for text in target:
        t.update(map(bucket, grams(text, most)[1]))
    all_s, all_t = sum(s.values()), sum(t.values())
    rows = []
    for i, text in docs:
        words, found = grams(text, most)
        total = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in map(bucket, found))
        weight = total // len(found) if found else 0
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= min_words])
    drawn = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in rows)


ODD = "doc_id long, text string, block long, ids string, lang string, feature int, __lang int, score string"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [None, "", " .,;", "One two ONE two three", "a", "ÄÖ ärger 日本 語 x1 1x", "one two one two three", "w " * 30_000, " ".join(f"w{i % 700}" for i in range(20_000)), "é" * 100_000]
    rows = [(i, t, None, "q", "en", 1, 2, "z") for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[3], None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    rows += [(100 + i, f"one w{i % 7} two w{i % 11} end", None, "q", "fr", 1, 2, "z") for i in range(60)]
    return spark.createDataFrame(rows, ODD).repartition(3)


@pytest.mark.parametrize("most,block_bytes", [(1, 8 << 20), (1, 300), (3, 300)])
def test_resampling_against_brute_force(spark, odd, most, block_bytes):
    target = spark.createDataFrame([("one two two three",), (None,), ("w3 end end",)], "text string")
    out = importance_resampling.resample(odd, target, most=most, buckets=50, percent=40, min_words=4, block_bytes=block_bytes)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert Counter(map(tuple, out.collect())) == brute(docs, ["one two two three", None, "w3 end end"], most, 50, 40, 4)


def test_resampling_of_empty_tables(spark, odd):
    nothing = spark.createDataFrame([], "text string")
    assert importance_resampling.resample(odd.limit(0), nothing).count() == 0
    got = Counter(map(tuple, importance_resampling.resample(odd, nothing, buckets=50).collect()))
    assert got == brute([(r["doc_id"], r["text"]) for r in odd.collect()], [], 1, 50, 10, 20)


def test_resampling_ranks_over_many_partitions(spark):
    frame = spark.range(5000).select("id", (F.col("id") % 37).alias("score"), F.when(F.col("id") % 3 > 0, True).alias("draw"))
    out = importance_resampling.ranked(frame, [F.desc("score"), F.asc("id")], F.col("draw"), 30)
    want = sorted((r for r in frame.collect() if r["draw"]), key=lambda r: (-r["score"], r["id"]))
    ranks = {r["id"]: r["rank"] for r in out.collect()}
    assert len(ranks) == 5000 and {i for i, k in ranks.items() if k} == {r["id"] for r in want[: 30 * len(want) // 100]}
    assert all(ranks[r["id"]] == k + 1 for k, r in enumerate(want[: 30 * len(want) // 100]))


def text_grams(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text or "").split()
    padded = [" " + w + " " for w in words]
    joined = " " + " ".join(words) + " " if words else ""
    out = Counter(c for w in words for c in w)
    out.update(joined[i : i + 2] for i in range(len(joined) - 1))
    out.update(w[i : i + 3] for w in padded for i in range(len(w) - 2))
    return out


def key(gram):
    points = [0 if c == " " else ord(c) for c in gram]
    return {1: 0, 2: 1 << 42, 3: 1 << 62}[len(points)] + sum(p << 21 * (len(points) - 1 - i) for i, p in enumerate(points))


def brute_languages(train, texts, top):
    def ranked(counts):
        return sorted(counts.items(), key=lambda x: (-x[1], key(x[0])))[:top]

    counts: dict = {}
    for lang, text in train:
        if lang is not None and text is not None:
            counts.setdefault(lang, Counter()).update(text_grams(text))
    profiles = {lang: {g: i for i, (g, _) in enumerate(ranked(c))} for lang, c in counts.items() if c}
    out = []
    for text in texts:
        own = ranked(text_grams(text))
        if not own or not profiles:
            out.append(("und", 0.0))
            continue
        every = sorted(text_grams(text).items(), key=lambda x: (-x[1], key(x[0])))
        place = {n: [i for i, (_, m) in enumerate(every) if m == n] for n in {n for _, n in own}}
        distance = {lang: sum(min(abs(p[g] - sum(place[n]) / len(place[n])), top) if g in p else top for g, n in own) for lang, p in profiles.items()}
        best = min(sorted(distance), key=lambda x: round(distance[x], 6))
        out.append((best, min(max(1 - distance[best] / (len(own) * top), 0), 1)))
    return out


@pytest.mark.parametrize("top,cut", [(300, 1 << 20), (20, 64)])
def test_languages_against_brute_force(spark, sf, monkeypatch, top, cut):
    monkeypatch.setattr(language_id, "SLICE", cut)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    docs = docs.unionByName(spark.createDataFrame([(-1, None, "en"), (-2, "12 $ .", "en"), (-3, "日本語 の 文 ǅ İx", None), (-4, "", "xx"), (-5, "q", "fr")], docs.schema)).orderBy("doc_id")
    rows = docs.collect()
    out = {r["doc_id"]: (r["__lang"]["pred"], round(r["__lang"]["score"], 9)) for r in language_id.language_id(docs, F.col("doc_id") % 4 != 2, top=top).collect()}
    want = brute_languages([(r["lang"], r["text"]) for r in rows if r["doc_id"] % 4 != 2], [r["text"] for r in rows], top)
    assert out == {r["doc_id"]: (w[0], round(w[1], 9)) for r, w in zip(rows, want, strict=True)}


def test_profiles_sum_over_all_tasks_and_flushes(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    once = sorted(map(tuple, language_id.learn(docs.coalesce(1)).collect()))
    monkeypatch.setattr(language_id, "HELD", 10)
    assert sorted(map(tuple, language_id.learn(docs.repartition(5)).collect())) == once
    assert Counter(r[0] for r in once) == {"de": 300, "en": 300, "es": 300, "fr": 300}


def test_languages_of_long_texts_do_not_depend_on_slices(monkeypatch):
    import pyarrow as pa

    texts = pa.array(["der die das " * 500 + "x" * 3000 + " und ", "le la les " * 700, None])
    whole = language_id.counted(texts, np.arange(3), 3)
    monkeypatch.setattr(language_id, "SLICE", 100)
    cut = language_id.counted(texts, np.arange(3), 3)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))


def test_languages_of_odd_tables(spark, odd):
    out = language_id.language_id(odd, F.lit(True))
    assert out.columns == [c for c in odd.columns if c != "__lang"] + ["__lang"] and out.count() == odd.count()
    by = {r["doc_id"]: r["__lang"] for r in out.collect() if r["doc_id"] is not None}
    assert by[0]["pred"] == by[1]["pred"] == by[2]["pred"] == "und" and by[0]["score"] == 0 and by[4]["pred"] in ("en", "fr")
    assert {r["__lang"]["pred"] for r in language_id.language_id(odd, F.lit(False)).collect()} == {"und"}
    assert language_id.language_id(odd.limit(0), F.lit(True)).count() == 0
    profiles = language_id.learn(odd)
    with pytest.raises(ValueError):
        language_id.identify(odd, profiles, most_languages=0)


def test_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang")
    found = queries.op12_language_id(spark, sf).join(docs, "doc_id").where("held_out").collect()
    assert len(found) > 20 and sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found)
    assert all(0 <= r["score"] <= 1 for r in found)
