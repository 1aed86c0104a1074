"""The registered queries on the small tables: against SQL, or against a brute-force version."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("kinetrail.llm")

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
from compare import same  # noqa: E402

from kinetrail.llm import queries  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, sf, name):
    same(spark, sf, queries.QUERIES[name], queries.ORACLES[name])


def documents(spark, sf):
    return sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect())


def rows(frame, *columns):
    return sorted(tuple(r[c] for c in columns) for r in frame.collect())


def test_token_ids(spark, sf):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json"))
    want, start = [], 0
    for i, text in documents(spark, sf):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert rows(queries.op2_token_ids(spark, sf), "doc_id", "start", "n_tokens", "ids_crc32") == want


def test_sentencepiece(spark, sf):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    want = []
    for i, text in documents(spark, sf):
        ids = sp.encode(text, add_bos=True, add_eos=True)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()))
    assert rows(queries.op6_sentencepiece(spark, sf), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want


def lower(text: str) -> bytes:
    return bytes(c + 32 if 65 <= c < 91 else c for c in text.encode())


def ppm_brute(docs, held, order=5):
    counts, words = defaultdict(Counter), Counter()
    for i, text in docs:
        if not held[i]:
            b = bytes([0xFE] * order) + lower(text) + b"\xff"
            for p in range(order, len(b)):
                for k in range(order + 1):
                    counts[b[p - k : p]][b[p]] += 1
            words.update(re.findall(rb"[^\x20\x09-\x0D]+", lower(text)))
            words["end"] += 1
    total, kinds = sum(words.values()), len(words)
    out = {}
    for i, text in docs:
        b, score = bytes([0xFE] * order) + lower(text) + b"\xff", 0.0
        for p in range(order, len(b)):
            hidden: set = set()
            for k in range(order, -2, -1):
                if k < 0:
                    score -= math.log10(256 - len(counts[b""]))
                    break
                c = counts.get(b[p - k : p])
                if not c:
                    continue
                t, q = sum(v for x, v in c.items() if x not in hidden), sum(x not in hidden for x in c)
                if t:
                    if b[p] in c:
                        score += math.log10((2 * c[b[p]] - 1) / (2 * t))
                        break
                    score += math.log10(q / (2 * t))
                hidden = set(c)
        tokens = [*re.findall(rb"[^\x20\x09-\x0D]+", lower(text)), "end"]
        out[i] = (len(tokens), sum(words[x] > 0 for x in tokens), total, sum(math.log10((words[x] + 1) / (total + kinds + 1)) for x in tokens), score)
    return out


def test_ppm(spark, sf):
    docs = documents(spark, sf)
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in docs}
    want = ppm_brute(docs, held)
    got = queries.op3_ppm(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        n, known, total, base, score = want[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], n, known, total)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9) and math.isclose(r["score"], score, rel_tol=1e-5)


def repeats_brute(docs, length=100):
    seen, out = set(), []
    for i, text in docs:
        b = text.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if (s := b[p : p + length]) in seen:
                gone[p : p + length] = True
            seen.add(s)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def test_suffix_dedup(spark, sf):
    assert rows(queries.op9_suffix_dedup(spark, sf), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == repeats_brute(documents(spark, sf))


def words_of(text):
    return re.findall(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", lower(text))


@pytest.mark.parametrize("chunk_bytes", [1 << 30, 250_000, 25_000])
def test_suffix_dedup_runs_meet_in_the_loser_tree(spark, sf, monkeypatch, tmp_path, chunk_bytes):
    """Runs are exchanged whatever the table's size, and the result does not depend on the chunks."""
    from kinetrail.llm import suffix_dedup

    merged, folder = suffix_dedup.merged_spans, str(tmp_path)

    def traced(runs, length, k):
        import os
        import uuid

        open(os.path.join(folder, f"{len(runs)}-{uuid.uuid4().hex}"), "w").close()
        return merged(runs, length, k)

    monkeypatch.setattr(suffix_dedup, "merged_spans", traced)
    docs = documents(spark, sf)
    got = suffix_dedup.suffix_dedup(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"), chunk_bytes=chunk_bytes)
    got = sorted((r["doc_id"], r["n_bytes"], sum(s["b"] - s["a"] for s in r["spans"]), len(r["spans"]), hashlib.sha256(r["kept"]).hexdigest()) for r in got.collect())
    assert got == repeats_brute(docs)
    assert max(int(x.name.split("-")[0]) for x in tmp_path.iterdir()) > 1


def test_suffix_dedup_of_periodic_texts_and_zero_bytes(spark):
    from kinetrail.llm import suffix_dedup

    r = np.random.default_rng(3)
    line = "".join(r.choice(list("abc"), 130))
    texts = ["ab" * 90, "\0" * 150, line, "x" + line[:99] + "\0" + line, line[20:] + "\0" * 101, "\0" * 99, "abc" * 60 + "ab" * 60, "é" * 120]
    texts += ["".join(r.choice(list("a\0"), 160, p=[0.97, 0.03])) for _ in range(12)]
    docs = list(enumerate(texts))
    got = suffix_dedup.suffix_dedup(spark.createDataFrame(docs, "doc_id long, text string"), chunk_bytes=500)
    got = sorted((x["doc_id"], x["n_bytes"], sum(s["b"] - s["a"] for s in x["spans"]), len(x["spans"]), hashlib.sha256(x["kept"]).hexdigest()) for x in got.collect())
    assert got == repeats_brute(docs)


def test_passage_dedup(spark, sf):
    """All exact repeats of 50 words are found; what is removed is similar to a passage of a source."""
    from kinetrail.llm import passage_dedup

    docs = documents(spark, sf)
    frame = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r for r in passage_dedup.passage_dedup(frame, chunk_bytes=100_000).collect()}
    seen, words = {}, {i: words_of(t) for i, t in docs}
    grams = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in words.items()}
    for i, _ in docs:
        w, r = words[i], got[i]
        assert r["n_words"] == len(w)
        gone = np.zeros(len(w), bool)
        for s in r["spans"]:
            gone[s["a"] : s["b"]] = True
            tokens = [tuple(w[k : k + 5]) for k in range(s["a"], s["b"] - 4)]
            assert s["b"] - s["a"] >= 50 and max(sum(t in grams[o] for t in tokens) for o in r["sources"]) >= 0.7 * len(tokens)
        for p in range(len(w) - 49):
            key = tuple(w[p : p + 50])
            if key in seen and (seen[key][0] != i or p - seen[key][1] >= 50):
                assert gone[p : p + 50].all()
            seen.setdefault(key, (i, p))
    want = rows(queries.op7_passage_dedup(spark, sf), "doc_id", "n_spans")
    assert want == sorted((i, len(r["spans"])) for i, r in got.items())


def test_pipeline(spark, sf):
    """Stage by stage against the queries' SQL on what the stage before kept."""
    import corpus_pipeline
    import duckdb

    columns = spark.read.parquet(f"{sf}/documents.parquet").columns
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = spark.read.parquet(f"{sf}/benchmark.parquet").toPandas()  # noqa: F841
    sql = {"quality_rules": queries.OP1_SQL, "line_dedup": queries.OP4_SQL, "ngram_join": queries.OP8_SQL, "decontamination": queries.OP10_SQL}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        documents_ = docs.toPandas()  # noqa: F841
        con = duckdb.connect()
        con.register("documents", documents_)
        con.register("benchmark", bench)
        judged = con.sql(sql[name]).df().set_index("doc_id")
        docs = stage(spark, docs, sf)
        assert docs.columns == columns
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        if name == "quality_rules":
            assert set(after) == set(judged.index[judged["kept"]])
        elif name == "line_dedup":
            assert {i: hashlib.sha256(t.encode()).hexdigest() for i, t in after.items()} == judged["kept_sha256"].to_dict()
        elif name == "ngram_join":
            assert set(after) == set(judged.index[judged.index == judged["class_id"]])
        else:
            assert set(after) == set(judged.index[~judged["contaminated"]])
    out = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=queries.vocabulary("piece_bpe_32k.model"))
    assert {r["doc_id"] for r in out} == set(after)
    for r in out:
        ids = sp.encode(after[r["doc_id"]], add_bos=True, add_eos=True)
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == ids and r["decoded"] == sp.decode(ids)
    assert corpus_pipeline.run(spark, sf).count() == len(out)
