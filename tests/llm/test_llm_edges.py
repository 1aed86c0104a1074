"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing columns, for each operator and stage."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("kinetrail.llm")

from pyspark.sql import functions as F  # noqa: E402

from kinetrail.llm import components, decontamination, elias_fano, line_dedup, ngram_join, passage_dedup, ppm, quality_rules, queries, sentencepiece_codec, suffix_dedup, token_ids, warc  # noqa: E402
from kinetrail.llm.common import shared_dir  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, ids string, spans int, chunk int, id string, size int, score double"
rng = random.Random(4)
WORDS = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Every odd case in one table; the last columns clash with names that operators use."""
    base = prose(120, 1)
    texts = [None, "", " \n\t", base, base, prose(120, 2), base.replace(" ", "  ") + " end", "x" * 50_000, prose(20_000, 3), "a\nb\nc", "word", "same line that is long enough to be counted here\n" * 7, "ÄÖ é 日本 🙂 ​", "one two three", None]
    rows = [(i, t, "en", "s", None, True, "z", 1, 2, "q", 3, 0.5) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, base, None, None, None, None, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


BENCH = "item_id long, text string, spans string"


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, " ".join(prose(120, 1).split()[10:40]), "z"), (2, None, "z"), (3, "", "z"), (None, "one two three", "z"), (4, "one two three", "z"), (4, "one two three", "z")], BENCH)


def test_quality_rules(odd):
    out = quality_rules.quality_rules(odd, sample_rows=5)
    assert out.columns == [*odd.columns, "__quality"] and out.count() == odd.count()
    by = {r["doc_id"]: r["__quality"] for r in out.collect() if r["doc_id"] is not None}
    assert not by[0]["kept"] and by[0]["n_words"] == 0 and by[3]["kept"] and not by[11]["kept"]
    assert quality_rules.keep_good(odd.limit(0)).count() == 0
    assert quality_rules.keep_good(odd).columns == odd.columns


def test_rule_order_changes_nothing(odd):
    rules = quality_rules.default_rules()
    verdicts = [sorted((str(r["doc_id"]), r["__quality"]["kept"]) for r in quality_rules.quality_rules(odd, rules=some).collect()) for some in (rules, rules[::-1])]
    assert verdicts[0] == verdicts[1]


def test_line_dedup(spark, odd):
    out = line_dedup.line_dedup(odd)
    assert out.columns == [*odd.columns, "__lines"] and out.count() == odd.count()
    assert line_dedup.line_dedup(odd.limit(0)).count() == 0
    line = "A shared line that is at least forty characters"
    docs = spark.createDataFrame([(i, f"{line.upper() if i % 2 else ' ' + line + chr(9)}\nown {i}\n{line}" if i else None) for i in range(7)] + [(6, f"{line}\nown 6\n{line}")], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"], r["__lines"]["n_lines"], r["__lines"]["n_dropped"]) for r in line_dedup.line_dedup(docs).collect())
    assert got[0] == (0, "", 1, 0) and got[1:6] == [(i, f"own {i}", 3, 2) for i in range(1, 6)]
    assert [g[3] for g in got[6:]] == [0, 0] and line in got[6][1]


def test_decontamination(spark, odd, bench):
    out = decontamination.decontaminate(odd, bench, block_bytes=200)
    assert out.columns == [*odd.columns, "__leak"] and out.count() == odd.count()
    by = {r["doc_id"]: r["__leak"] for r in out.collect() if r["doc_id"] is not None}
    assert [(s["a"], s["b"]) for s in by[3]["spans"]] == [(10, 40)] and by[3]["items"] == ["1"]
    assert by[13]["items"] == ["4"] and by[0]["n_words"] == 0 and not by[5]["spans"]
    whole = decontamination.decontaminate(odd, bench)
    key = lambda f: sorted(repr((r["doc_id"], r["__leak"])) for r in f.collect())
    assert key(out) == key(whole)
    nothing = decontamination.decontaminate(odd, bench.limit(0))
    assert nothing.where(F.size("__leak.spans") > 0).count() == 0 and {r["doc_id"]: r["__leak"]["n_words"] for r in nothing.collect()}[13] == 3
    assert decontamination.remove_leaks(odd.limit(0), bench).count() == 0


def test_winnowing_guarantee():
    from kinetrail.llm.words import Words

    grams = np.random.default_rng(1).integers(0, 50, 500).astype(np.uint64)
    picked = set(decontamination.winnow(grams, 6).tolist())
    assert all(picked & set(range(a, a + 6)) for a in range(495))
    empty = Words(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    assert len(empty.hash) == 0


def test_templated_benchmarks_cost_nothing_without_hits():
    """Documents that hold the first words of all items many times: no hit, and time that does not grow with the items."""
    import time

    import pyarrow as pa

    from kinetrail.llm.common import flat_text
    from kinetrail.llm.words import Words

    r = random.Random(8)
    template = "please answer the following question now".split()
    docs = [" ".join(x for _ in range(5) for x in [*template, *(f"d{r.randrange(10**9)}" for _ in range(40))]) for _ in range(100)]
    words = Words(*flat_text(pa.array(docs)))
    took = []
    for n in (500, 2000):
        index = decontamination.Index(list(range(n)), [" ".join([*template, *(f"i{r.randrange(10**9)}" for _ in range(20))]) for _ in range(n)], 10, 5)
        began = time.perf_counter()
        assert all(not len(places) for places, *_ in index.hits(words))
        took.append(time.perf_counter() - began)
    assert max(took) < 1


def test_passages_of_many_items_are_found_under_all_of_them(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    bench = spark.createDataFrame([(i, f"own{i} {passage} tail{i}") for i in range(300)] + [(1000 + i, "short item") for i in range(50)], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"x y {passage} z"), (2, "a short item here"), (3, passage[: len(passage) // 4]), (4, " ".join(passage.split()[:9]))], "doc_id long, text string")
    got = {x["doc_id"]: x["__leak"] for x in decontamination.decontaminate(docs, bench, block_bytes=3000).collect()}
    assert got[1]["spans"] == [(2, 32)] and got[1]["items"] == sorted(map(str, range(300)))
    assert got[2]["spans"] == [(1, 3)] and got[2]["items"] == sorted(str(1000 + i) for i in range(50)) and not got[3]["spans"] and not got[4]["spans"]


def test_elias_fano():
    r = np.random.default_rng(2)
    for values in ([], [5], [0, 0, 0], [-7, -7, 3], np.sort(r.integers(0, 10**6, 3000)), np.sort(r.integers(-(10**17), 10**18, 700)), np.arange(2000) * 3):
        values = np.array(values, np.int64)
        data = elias_fano.encode(values) + b"rest"
        e = elias_fano.EliasFano(data)
        assert e.all().tolist() == values.tolist() and e.size == len(data) - 4
        assert [e.select(i) for i in range(0, len(values), 7)] == values[::7].tolist()
    sparse = np.sort(r.integers(0, 2**40, 10_000))
    assert len(elias_fano.encode(sparse)) < 10_000 * 5 < 8 * 10_000


def test_token_ids(spark, odd):
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    folder = shared_dir(spark, "tokens")
    token_ids.write_token_ids(odd, folder, path, 1, max_ids=20_000)
    got = token_ids.read_token_ids(spark, folder).collect()
    want = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in odd.collect()))
    got = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in got] == [i if known else None for known, i, _ in want]
    ids = [[*t.encode(x, add_special_tokens=False).ids, 1] for *_, x in want]
    assert [np.frombuffer(bytes(r["ids"]), "<u4").tolist() for r in got] == ids
    assert [r["start"] for r in got] == np.cumsum([0] + [len(x) for x in ids])[:-1].tolist()
    empty = shared_dir(spark, "tokens")
    token_ids.write_token_ids(odd.limit(0), empty, path, 1)
    assert token_ids.read_token_ids(spark, empty).count() == 0


def test_token_pieces_match_the_library():
    from tokenizers import Tokenizer

    path = queries.vocabulary("word_bpe_49k.json")
    t, cache, r = Tokenizer.from_file(path), token_ids.word_cache(path), random.Random(3)
    parts = ["a", "B", "é", "ß", "'", "'s", "'ll", " ", "\n", "\t", "1", "²", "ª", "İ", "Σ", "ς", "<|endoftext|>", "<|", ".", "!!", "日本", "́", "Å", "🙂", " ", "the", "it's"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(2000)]
    flat, sizes = token_ids.encode_texts(texts, cache, 1)
    for text, end, n in zip(texts, np.cumsum(sizes), sizes, strict=True):
        assert flat[end - n : end].tolist() == [*t.encode(text, add_special_tokens=False).ids, 1]


def test_sentencepiece(odd):
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    out = sentencepiece_codec.encode(odd, path)
    back = sentencepiece_codec.decode(out, path, text="text")
    assert out.count() == odd.count() and sentencepiece_codec.encode(odd.limit(0), path).count() == 0
    for r in out.collect():
        assert np.frombuffer(bytes(r["ids"]), "<u4").tolist() == sp.encode(r["text"] or "", add_bos=True, add_eos=True)
    assert sorted(r["text"] for r in back.collect()) == sorted(sp.decode(sp.encode(r["text"] or "")) for r in odd.collect())


def test_sentencepiece_words_match_the_library():
    import sentencepiece

    path = queries.vocabulary("piece_bpe_32k.model")
    sp, model, r = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_codec.model(path), random.Random(1)
    from kinetrail.llm.common import WordCache

    texts = ["".join(r.choice(" ab\nthe▁ingé12日.,") for _ in range(r.randint(0, 80))) for _ in range(1500)] + ["a" * 999, " " * 300, "abab" * 50]
    flat, sizes = model.encode_batch(texts, WordCache(model.encode_words))
    want = sp.encode(texts, add_bos=True, add_eos=True)
    assert [flat[e - n : e].tolist() for e, n in zip(np.cumsum(sizes), sizes, strict=True)] == want
    assert model.decode_batch(flat, sizes) == sp.decode(want)
    raw = [[1, 3 + 0xC3, 3 + 0x28, 300, 2], [259, 300], [0, 300]]
    assert model.decode_batch(np.array(sum(raw, []), np.uint32), np.array([5, 2, 2])) == sp.decode(raw)


def test_ppm(odd):
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    out = ppm.score(odd, held, chunk_bytes=30_000).collect()
    assert len(out) == odd.count() and all(r["score"] < 0 and r["base_score"] < 0 for r in out)
    assert len({r["score"] for r in out if r["doc_id"] == 3}) == 1
    assert ppm.score(odd.limit(0), held).count() == 0
    untrained = ppm.score(odd, F.lit(True)).where("doc_id = 10").first()
    assert untrained["n_known"] == 0 and abs(untrained["score"] + 5 * np.log10(256)) < 1e-4


def test_ppm_is_a_distribution():
    keys = np.unique(ppm.grams(*ppm.symbols(__import__("pyarrow").array(["abracadabra", "abab"]), 3)[:2], 3), return_counts=True)
    flat, at, _ = ppm.symbols(__import__("pyarrow").array(["abracadabra", "abab"]), 1)
    pairs = np.bincount(flat[at - 1].astype(np.int64) * 256 + flat[at], minlength=65536).reshape(256, 256)
    trie = ppm.Trie(*keys, 3, pairs)
    for context in (b"abr", b"zab", b"zzz", b"zza"):
        c = sum(v << (8 * (3 - k)) for k, v in enumerate(context[::-1]))
        p = 10 ** trie.log10(np.array([c | s for s in range(256)], np.uint64))
        assert abs(p.sum() - 1) < 1e-9


def test_suffix_dedup(spark, odd):
    docs = sorted({(-1 if r["doc_id"] is None else r["doc_id"], r["text"] or "") for r in odd.collect()}, key=lambda x: (x[0], suffix_dedup.Chunk(__import__("pyarrow").table({"id": [1], "text": [x[1]]}), 100).docs[0][1]))
    seen, want = set(), {}
    for i, t in docs:
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        want[i, t] = bytes(np.frombuffer(b, np.uint8)[~gone])
    got = suffix_dedup.suffix_dedup(odd, chunk_bytes=20_000).collect()
    count = lambda rows: sorted((str(i), k) for i, k in rows)
    assert count((r["doc_id"], bytes(r["kept"])) for r in got) == count((r["doc_id"], want[-1 if r["doc_id"] is None else r["doc_id"], r["text"] or ""]) for r in odd.collect())
    assert suffix_dedup.suffix_dedup(odd.limit(0)).count() == 0


def test_loser_tree():
    r = random.Random(6)

    class Plain:
        pass

    for k in (1, 2, 3, 7):
        runs = []
        for _ in range(k):
            run = Plain()
            run.suffixes = sorted(bytes(r.choice(b"ab") for _ in range(r.randint(1, 8))) for _ in range(r.randint(1, 40)))
            run.same = np.array([0] + [suffix_dedup.common_prefix(a, b, 0) for a, b in zip(run.suffixes, run.suffixes[1:])])
            runs.append(run)
        run, place, known = suffix_dedup.merge_runs(runs)
        merged = [runs[a].suffixes[b] for a, b in zip(run, place, strict=True)]
        assert merged == sorted(x for p in runs for x in p.suffixes)
        assert known[1:] == [suffix_dedup.common_prefix(a, b, 0) for a, b in zip(merged, merged[1:])]


def test_passage_dedup(spark, odd):
    out = {}
    for r in passage_dedup.passage_dedup(odd, chunk_bytes=20_000).collect():
        out.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, out.values())) == odd.count() and len(out[3]) == 3
    assert [(s["a"], s["b"]) for s in out[4][0]["spans"]] == [(0, 120)] and not out[5][0]["spans"] and not out[0][0]["spans"]
    assert passage_dedup.passage_dedup(odd.limit(0)).count() == 0
    p = prose(60, 9)
    edited = p.split()
    edited[30] = "changed"
    docs = spark.createDataFrame([(1, f"{prose(80, 10)} {p} {prose(40, 11)}"), (2, f"{prose(30, 12)} {' '.join(edited)} {prose(70, 13)}"), (3, prose(200, 14))], "doc_id long, text string")
    got = {r["doc_id"]: r for r in passage_dedup.passage_dedup(docs).collect()}
    assert got[2]["sources"] == [1] and abs(got[2]["spans"][0]["a"] - 30) <= 1 and abs(got[2]["spans"][0]["b"] - 90) <= 1
    assert not got[1]["spans"] and not got[3]["spans"]


def removed(frame, **options):
    return {r["doc_id"]: (tuple((s["a"], s["b"]) for s in r["spans"]), tuple(r["sources"])) for r in passage_dedup.passage_dedup(frame, **options).collect()}


def fresh(n, r):
    return ["".join(r.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n)]


def test_passage_dedup_around_a_frequent_line(spark):
    """Repeats of 60 words around a line of 40 words that 300 other documents hold are all found, by their own partner."""
    r = random.Random(21)
    line = fresh(40, r)
    texts = [[*fresh(70, r), *line, *fresh(70, r)] for _ in range(300)]
    for _ in range(60):
        cut = r.randint(1, 19)
        passage = [*fresh(cut, r), *line, *fresh(20 - cut, r)]
        texts += [[*fresh(50, r), *passage, *fresh(50, r)] for _ in range(2)]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = removed(docs)
    for i in range(301, 420, 2):
        assert any(a <= 50 and b >= 110 for a, b in got[i][0]) and i - 1 in got[i][1]
    assert not any(got[i][0] for i in range(300))


def test_passage_dedup_does_not_depend_on_chunks(spark):
    """An original and 200 copies with one word changed, in one chunk and in many."""
    r = random.Random(22)
    passage = fresh(60, r)
    rows = [(0, " ".join([*fresh(40, r), *passage, *fresh(40, r)]))]
    for i in range(1, 201):
        w = list(passage)
        w[r.randrange(60)] = f"edit{i}"
        rows.append((i, " ".join([*fresh(40, r), *w, *fresh(40, r)])))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    one, many = removed(docs), removed(docs, chunk_bytes=12_000)
    assert one == many
    assert all(one[i][0] for i in range(1, 201)) and not one[0][0]


def test_passages_against_brute_force():
    """Insertions, edits near an edge and moved sentences, each a passage whose shingles have Jaccard similarity 0.8 or more."""
    r = random.Random(23)

    def tokens(words):
        return np.array([zlib.crc32(" ".join(words[k : k + 5]).encode()) for k in range(len(words) - 4)], np.uint64)

    def case(old, new):
        before, after = fresh(70, r), fresh(70, r)
        x, y = tokens([*before, *new, *after]), tokens([*fresh(50, r), *old, *fresh(80, r)])
        p, q = set(tokens(new).tolist()), set(tokens(old).tolist())
        anchors = [(int(i), int(j)) for i in range(len(x)) for j in np.flatnonzero(y == x[i])]
        least = 46
        assert len(p & q) >= 0.8 * len(p | q)
        (a, b), *rest = passage_dedup.passages(x, y, anchors, least, 0.8)
        assert not rest and b - a >= least and abs(a - 70) <= 9 and abs(b - 70 - len(new) + 4) <= 9
        return anchors, x, y

    w = fresh(90, r)
    case(w, [*w[:45], *fresh(10, r), *w[45:]])
    case([*w[:45], *fresh(10, r), *w[45:]], w)
    for k in (4, 47):
        v = fresh(52, r)
        case(v, [*v[:k], "edit", *v[k + 1 :]])
    v = fresh(120, r)
    case(v, [*v[:40], *v[80:], *v[40:80]])
    v = fresh(60, r)
    anchors, x, y = case(v, v)
    assert not passage_dedup.passages(x[:100], y, [a for a in anchors if a[0] < 100], 46, 0.8)


def test_compact_windows_against_brute_force():
    r = np.random.default_rng(7)
    for n, least in ((40, 5), (100, 10), (9, 10), (60, 1)):
        tokens = [r.integers(0, 30, n).astype(np.uint64), r.integers(0, 3, n).astype(np.uint64)]
        value, doc, at, low, high = passage_dedup.compact_windows(tokens, least, 0)
        covered = {(d, i, j): 0 for d in (0, 1) for i in range(n) for j in range(i + least - 1, n)}
        for v, d, c, a, b in zip(value, doc, at, low, high, strict=True):
            for i in range(a, c + 1):
                for j in range(max(c, i + least - 1), b + 1):
                    covered[int(d), i, j] += 1
        assert set(covered.values()) <= {1}


def test_ngram_join(spark, odd):
    out = ngram_join.ngram_join(odd)
    assert out.count() == odd.count()
    by = {r["doc_id"]: r for r in out.collect() if r["doc_id"] is not None}
    assert by[4]["class_id"] == 3 == by[6]["class_id"] and by[4]["rep_id"] == 3 and by[0]["class_id"] == 0 and by[1]["class_id"] == 1 and by[5]["n_links"] == 0
    assert ngram_join.ngram_join(odd.limit(0)).count() == 0
    kept = ngram_join.keep_one(odd)
    assert kept.columns == odd.columns and {4, 6}.isdisjoint(r["doc_id"] for r in kept.collect())


def test_ngram_join_blocks(spark):
    """A large group, cut into blocks, has all its links."""
    base = prose(200, 20).split()
    rows = []
    for i in range(60):
        w = list(base)
        w[3 * i] = f"edit{i}"
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [{tuple(t.split()[k : k + 5]) for k in range(196)} for _, t in rows]
    want = [sum(len(a & b) >= 0.8 * len(a | b) for b in sets) - 1 for a in sets]
    got = sorted((r["doc_id"], r["n_links"], r["class_id"]) for r in ngram_join.ngram_join(docs, block=8).collect())
    assert got == [(i, n, 0) for i, n in enumerate(want)]


def test_ngram_join_texts_of_one_id(spark):
    """Each text of an id has its own links, and only copies go."""
    rows = []
    for k in range(8):
        near = prose(200, 50 + k).split()
        near[7] = "edit"
        rows += [(10 * k + 1, prose(200, 50 + k)), (10 * k + 2, " ".join(near)), (10 * k + 2, prose(200, 70 + k))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"], r["class_id"], r["n_links"]) for r in ngram_join.ngram_join(docs).collect())
    assert got == sorted(x for k in range(8) for x in [(10 * k + 1, 10 * k + 1, 1), (10 * k + 2, 10 * k + 1, 1), (10 * k + 2, 10 * k + 2, 0)])
    kept = sorted((r["doc_id"], r["text"]) for r in ngram_join.keep_one(docs).collect())
    assert kept == sorted(r for i, r in enumerate(rows) if i % 3 != 1)


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, 200), (200, 300), (7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), **dict.fromkeys((100, 200, 300), 100)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_warc(spark):
    long, other = "<p>" + "y" * 200, "<p>" + "z" * 200
    rows = [(5, "http://a/", long), (2, None, long), (9, "http://b/", long), (9, "http://b/", long), (1, "u", None), (3, "u\r\nX: y", "short"), (4, "v", "short"), (6, "w", other), (None, "n", other), (7, "é", "🙂" * 40), (8, "w", "🙂" * 40)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    archives = []
    for _ in range(2):
        folder = shared_dir(spark, "warc")
        warc.write_warc(pages, folder, shard_bytes=300, file_bytes=150)
        manifest = spark.read.parquet(f"{folder}/_manifest").orderBy("path").collect()
        archives.append([(m["path"], m["n_records"], m["sha256"]) for m in manifest])
        for m in manifest:
            with open(f"{folder.removeprefix('file:')}/{m['path']}".replace("//", "/"), "rb") as f:
                data = f.read()
            assert hashlib.sha256(data).hexdigest() == m["sha256"] and zlib.decompressobj(31).decompress(data).startswith(b"WARC/1.1")
    assert archives[0] == archives[1] and len(archives[0]) > 2
    got = sorted(((r["page_id"] is None, r["page_id"] or 0, r["record_type"], r["refers_to"], r["payload_bytes"]) for r in warc.read_warc(spark, folder).collect()), key=repr)
    want = [(False, 1, "response", None, 0), (False, 2, "response", None, 203), (False, 3, "response", None, 5), (False, 4, "response", None, 5), (False, 5, "revisit", 2, 203), (False, 6, "response", None, 203), (False, 7, "response", None, 160), (False, 8, "revisit", 7, 160), (False, 9, "revisit", 2, 203), (False, 9, "revisit", 2, 203), (True, 0, "response", None, 203)]
    assert got == sorted(want, key=repr)
    empty = shared_dir(spark, "warc")
    warc.write_warc(pages.limit(0), empty)
    assert warc.read_warc(spark, empty).count() == 0
    same_id = spark.createDataFrame([(1, "u", long), (1, "u", long)], "page_id long, url string, html string")
    twice = shared_dir(spark, "warc")
    warc.write_warc(same_id, twice)
    assert sorted((r["record_type"], r["refers_to"]) for r in warc.read_warc(spark, twice).collect()) == [("response", None), ("revisit", 1)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_token_ids_of_any_tokenizer(spark, odd, name):
    """A tokenizer that keeps spaces gets whole texts; boundaries are read by ranges, documents by select."""
    from tokenizers import Tokenizer

    path = queries.vocabulary(name)
    t = Tokenizer.from_file(path)
    folder = shared_dir(spark, "token-ids")
    token_ids.write_token_ids(odd.select("doc_id", "text"), folder, path, end_id=1, max_ids=20_000)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, np.frombuffer(r["ids"], "<u4").tolist()) for r in token_ids.read_token_ids(spark, folder).collect())
    assert got == sorted((r["doc_id"] if r["doc_id"] is not None else -1, [*t.encode(r["text"] or "", add_special_tokens=False).ids, 1]) for r in odd.collect())
    for m in spark.read.parquet(f"{folder}/_manifest").collect():
        with open(f"{folder.removeprefix('file:')}/{m['path']}".replace("//", "/"), "rb") as f:
            shard = token_ids.Shard(f.read())
        ends = [shard.ends.select(i) for i in range(shard.n_docs)]
        assert shard.ends.between(0, shard.n_docs).tolist() == ends == shard.ends.all().tolist()
        assert [len(shard.document(i)) for i in range(shard.n_docs)] == np.diff([0, *ends]).tolist()


def test_warc_shard_bounds(spark):
    """Shards in proportion to the data, whatever the ids: 10,000 of them, clustered ids, and ids at both ends of 64 bits."""
    from pyspark.sql import functions as F

    even = spark.range(200_000).select("id", F.lit(1000).cast("long").alias("size"))
    clustered = spark.range(5_000).select((F.col("id") * F.when(F.col("id") < 2_500, 1).otherwise(10**12)).alias("id"), F.lit(1000).cast("long").alias("size"))
    top = (1 << 63) - 1
    wide = spark.createDataFrame([(-top - 1, 900), (-5, 900), (0, 900), (7, 900), (8, 900), (8, 900), (top, 900), (None, 900)], "id long, size long")
    for frame, shard_bytes, least in ((even, 20_000, 9_000), (clustered, 20_000, 250), (wide, 2_000, 3)):
        bounds = warc.shard_bounds(frame, "id", F.col("size"), shard_bytes)
        assert (np.diff(bounds) > 0).all() and len(bounds) >= least
        held = {}
        for r in frame.where("id is not null").collect():
            held.setdefault(int(np.searchsorted(bounds, r["id"], "right")), []).append((r["id"], r["size"]))
        assert all(sum(s for _, s in x) <= shard_bytes or len({i for i, _ in x}) == 1 for x in held.values())
        assert len(bounds) <= 2 * frame.count() * 1000 // shard_bytes + 2


def test_warc_very_long_payload_and_references(spark):
    """A payload larger than shard and file limits; revisits name the record that they refer to."""
    long = "<p>" + "".join(chr(97 + i * i % 23) for i in range(300_000))
    pages = spark.createDataFrame([(1, "u", long), (2, "v", long), (3, "w", "x")], "page_id long, url string, html string")
    folder = shared_dir(spark, "warc")
    warc.write_warc(pages, folder, shard_bytes=1_000, file_bytes=500)
    got = {r["page_id"]: r for r in warc.read_warc(spark, folder).collect()}
    assert got[1]["payload"].decode() == long and got[2]["refers_to"] == 1 and got[2]["payload"] is None and got[3]["payload"] == b"x"
    fields = []
    for m in spark.read.parquet(f"{folder}/_manifest").collect():
        with open(f"{folder.removeprefix('file:')}/{m['path']}".replace("//", "/"), "rb") as f:
            fields += [warc.parse(x)[0] for x in warc.members(f)]
    kinds = {}
    for f in fields:
        kinds.setdefault(f["WARC-Type"], []).append(f)
    assert len(kinds["warcinfo"]) >= 1 and len({f["WARC-Record-ID"] for f in fields}) == len(fields)
    target = {f["X-Page-Id"]: f["WARC-Record-ID"] for f in kinds["response"]}["1"]
    assert [f["WARC-Refers-To"] for f in kinds["revisit"]] == [target]


def test_pipeline_stages(spark, odd, bench, tmp_path):
    import corpus_pipeline

    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd, odd.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, str(tmp_path)).columns == docs.columns
            stage(spark, docs, str(tmp_path)).count()
        corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()


def shingles(text):
    w = text.split()
    return {" ".join(w[k : k + min(5, len(w))]) for k in range(max(1, len(w) - 4))}


def test_ngram_join_recall_at_the_threshold(spark):
    """All pairs of similarity 0.8 to 0.85, among texts of all lengths, against brute force."""
    r = random.Random(31)
    texts = []
    while len(texts) < 600:
        w = fresh(r.choice([8, 9, 12, 15, 30, 60, 150, 400]), r)
        v = list(w)
        while True:
            v[r.randrange(len(v))] = "edit%d" % r.randrange(10**9)
            p, q = shingles(" ".join(w)), shingles(" ".join(v))
            if len(p & q) < 0.85 * len(p | q):
                break
        if len(p & q) >= 0.8 * len(p | q):
            texts += [" ".join(w), " ".join(v)]
        elif len(w) < 30:  # a short text reaches the threshold by growing
            v = [*w, *fresh(1, r)]
            if 0.8 <= len(w) / len(v) or len(shingles(" ".join(w))) >= 0.8 * len(shingles(" ".join(v))):
                texts += [" ".join(w), " ".join(v)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {x["doc_id"]: x for x in ngram_join.ngram_join(docs).collect()}
    assert all(got[i]["class_id"] == i - i % 2 and got[i]["n_links"] == 1 for i in range(len(texts)))


def test_ngram_join_lookups_reach_the_recall():
    """Whatever the crowds, the lookups and the places where a document is alone reach the recall; cheap places are taken first, crowded ones deep or not at all."""
    assert ngram_join.least_similarity(4, 0.8) == 4 / 5 and ngram_join.least_similarity(3, 0.8) is None and ngram_join.least_similarity(6, 0.8) == 5 / 6
    partners = ngram_join.least_similarities(0.8)
    assert not partners[1:4].any() and partners[6] == 5 / 6 and partners[-1] == 0.8
    r = random.Random(32)
    for _ in range(300):
        trees = r.randint(0, 16)
        places = []
        for t in sorted(r.sample(range(16), trees)):
            sizes = sorted((int(10 ** r.uniform(0, 5)) + 1 for _ in ngram_join.LEVELS), reverse=True)
            places.append((t, sizes))
        found = ngram_join.lookups(places, 0.8, 0.99999, 16, 2)
        miss = (1 - 0.8**2) ** (16 - trees)
        for level in found.values():
            miss *= 1 - 0.8 ** (2 + ngram_join.LEVELS[level])
        assert miss <= 1e-5 * (1 + 1e-9) and set(found) <= {t for t, _ in places}
        assert all(found[t] == 0 for t, sizes in places if sizes[0] <= ngram_join.CROWD)  # whoever might be a partner there is met
    crowded = [(t, [10**6, 10**6, 2]) for t in range(3)] + [(t, [2, 1, 1]) for t in range(3, 16)]
    assert ngram_join.lookups(crowded, 0.8, 0.99999, 16, 2) == {t: 2 if t < 3 else 0 for t in range(16)}
    assert ngram_join.lookups([(t, [10**6] * 3) for t in range(3)], 0.8, 0.99999, 16, 2) == {}
    full = ngram_join.lookups([(t, [10**6, 10**5, 10**4]) for t in range(16)], 0.8, 0.99999, 16, 2)
    assert sorted(full.values()) == [0] + [1] * 15


def test_ngram_join_matched_prefixes_vary_with_the_forest(spark, sf):
    """On the given texts, documents look up none, some or all of their trees, at all levels."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    r = random.Random(5)
    line = " ".join(fresh(60, r))
    some = spark.createDataFrame([(10_000 + i, f"{line} {' '.join(fresh(r.choice([8, 20, 200]), r))}") for i in range(400)], "doc_id long, text string")
    reps = ngram_join.sign(ngram_join.texts(docs.unionByName(some), "doc_id", "text"), 5, 0.8, 0.99999, 16, 8).where("size > 3")
    leaves = [(x["id"], t, h, v, x["least"]) for x in reps.collect() for t, (h, v) in enumerate(zip(x["prefixes"], x["tails"], strict=True))]
    keys = [[(t, h, ngram_join.level_key(v, k)) for k in range(len(ngram_join.LEVELS))] for _, t, h, v, _ in leaves]
    counts = [Counter(k[level] for k in keys) for level in range(len(ngram_join.LEVELS))]
    places = {}
    for (i, t, *_), k in zip(leaves, keys, strict=True):
        sizes = [c[x] for c, x in zip(counts, k, strict=True)]
        places.setdefault(i, [])
        if sizes[0] > 1:
            places[i].append((t, sizes))
    depths = {i: tuple(sorted(ngram_join.lookups(p, 0.8, 0.99999, 16, 2).items())) for i, p in places.items()}
    levels = Counter(level for d in depths.values() for _, level in d)
    assert any(not d for d in depths.values()) and set(levels) == {0, 1, 2} and len(set(depths.values())) > 5


def test_ngram_join_in_a_crowd_around_a_common_line(spark):
    """Documents that share half of their words with hundreds of others, and near copies among them: all links are found, and no others."""
    r = random.Random(6)
    line = fresh(40, r)
    texts = []
    for i in range(300):
        w = [*line, *fresh(40, r)]
        texts.append(" ".join(w))
        if i % 10 == 0:
            texts.append(" ".join([*w[:78], *fresh(2, r)]))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [shingles(t) for t in texts]
    got = {x["doc_id"]: x["n_links"] for x in ngram_join.ngram_join(docs, block=64).collect()}
    assert got == {i: sum(j != i and len(p & q) >= 0.8 * len(p | q) for j, q in enumerate(sets)) for i, p in enumerate(sets)} and any(got.values())


def around(passage, r, n=40):
    return [*fresh(n, r), *passage, *fresh(n, r)]


@pytest.mark.parametrize("phrase", [0, 35, 40, 49])
def test_passage_dedup_recall_around_a_phrase_that_all_share(spark, phrase):
    """Repeats of 60 words, all exact ones found; and near copies of 55 to 120 words, 0.95 of them at least. All documents share a phrase."""
    r = random.Random(100 + phrase)
    line = fresh(phrase, r)
    first, second, kinds = [], [], []
    while len(first) < 160:
        exact = len(first) % 2 == 0
        size = 60 if exact else r.randint(55, 120)
        own = fresh(size - phrase, r)
        k = r.randint(0, len(own))
        q = [*own[:k], *line, *own[k:]]
        v = list(q)
        for _ in range(0 if exact else r.randint(1, 2)):
            v[r.randrange(size)] = f"edit{r.randrange(10**9)}"
        if len(shingles(" ".join(q)) & shingles(" ".join(v))) >= 0.8 * len(shingles(" ".join(q)) | shingles(" ".join(v))):
            first.append(around(q, r))
            second.append(around(v, r))
            kinds.append((exact, size))
    got = removed(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([*first, *second])], "doc_id long, text string"))
    share = [sum(min(b, 40 + size) - max(a, 40) for a, b in got[160 + i][0] if b > 40 and a < 40 + size) / size for i, (_, size) in enumerate(kinds)]
    assert all(s == 1 for s, (exact, _) in zip(share, kinds) if exact)
    near = [s >= 0.8 for s, (exact, _) in zip(share, kinds) if not exact]
    assert sum(near) >= 0.95 * len(near)
    if phrase < 41:  # longer ones are similar passages themselves
        assert not any(got[i][0] for i in range(160))


def test_passage_dedup_of_a_crowd_around_one_original(spark):
    """200 copies that are similar to an original in their middle, but hardly to each other, against brute force."""
    r = random.Random(6)
    base, texts = fresh(60, r), []
    for i in range(201):
        w = list(base)
        if i != 100:
            w[r.randrange(5, 55)] = f"edit{i}"
        texts.append(around(w, r, 30))
    sets = [shingles(" ".join(t[30:90])) for t in texts]
    need = [i for i in range(201) if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(i))]
    got = removed(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert sum(any(a < 90 and b > 30 for a, b in got[i][0]) for i in need) >= 0.9 * len(need)


def test_passage_dedup_of_a_crowd_misses_none(spark):
    """200 copies of an original, whose tokens all have crowded values, against brute force; in one chunk and in many."""
    r = random.Random(6)
    base, texts = fresh(60, r), []
    for i in range(201):
        w = list(base)
        if i != 100:
            w[r.randrange(5, 55)] = f"edit{i}"
        texts.append(around(w, r, 30))
    sets = [shingles(" ".join(t[30:90])) for t in texts]
    need = [i for i in range(201) if any(len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) for j in range(i))]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    got = removed(docs)
    assert not [i for i in need if not any(a < 90 and b > 30 for a, b in got[i][0])]
    assert removed(docs, chunk_bytes=40_000) == got


def test_passage_dedup_misses_no_partner_around_a_phrase(spark):
    """Near copies of 57 words, 45 of them a phrase that all documents share, so that nearly all values are crowded."""
    r = random.Random(77)
    line, first, second = fresh(45, r), [], []
    while len(first) < 300:
        own = fresh(12, r)
        k = r.randint(0, 12)
        q = [*own[:k], *line, *own[k:]]
        v = list(q)
        v[r.randrange(57)] = f"edit{r.randrange(10**9)}"
        p, o = shingles(" ".join(q)), shingles(" ".join(v))
        if len(p & o) >= 0.8 * len(p | o):
            first.append(around(q, r))
            second.append(around(v, r))
    got = removed(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate([*first, *second])], "doc_id long, text string"))
    assert all(any(a < 97 and b > 40 for a, b in got[i][0]) for i in range(300, 600))


def test_tokens_to_look_up_are_enough():
    """Whatever fifth of a passage is changed, one of the tokens that are looked up stays."""
    r = np.random.default_rng(3)
    for _ in range(200):
        size = int(r.integers(46, 140))
        tokens = r.integers(1, 1 << 40, size).astype(np.uint64)
        tokens[r.random(size) < 0.05] = passage_dedup.LONE
        told = passage_dedup.telling(tokens, r.integers(0, 4, size).astype(np.uint8) * 40, 46, 0.8)
        assert not told[tokens == passage_dedup.LONE].any()
        lone = np.flatnonzero(tokens == passage_dedup.LONE)
        # the changes that hit most of them
        changed = [*lone, *np.flatnonzero(told)][: int(0.2 * size + 1e-9)]
        assert len(lone) > 0.2 * size or set(np.flatnonzero(told)) - set(changed)


def test_tokens_to_look_up_among_repeated_words():
    """Of words that are said over and over hardly anything is looked up; yet a text that has none of what is lacks over a fifth of any passage's
    distinct tokens, or of all its tokens."""
    r = np.random.default_rng(8)
    lone = passage_dedup.LONE
    stutter = np.concatenate([np.append(np.full(38, k, np.uint64), np.full(4, lone)) for k in range(1, 9)])
    args = np.full(len(stutter), 60, np.uint8), np.zeros(len(stutter), bool), np.array([0, len(stutter)]), 46, 0.8
    assert passage_dedup.telling(stutter, args[0], 46, 0.8).sum() > 100 and not passage_dedup.telling_apart(stutter, *args).any()
    assert passage_dedup.stretches(stutter != lone, 46, 0.8) and not passage_dedup.stretches(stutter != lone, 46, 0.8, stutter)
    checked = 0
    for _ in range(60):
        parts = [np.full(r.choice([1, 1, 1, 1, 3, 40, 60]), r.integers(1, 1 << 40), np.uint64) for _ in range(60)]
        parts = [np.full(len(p), lone) if r.random() < 0.08 and len(p) == 1 else p for p in parts]
        x = np.concatenate(parts)
        done = np.repeat(r.random(len(parts)) < 0.5, [len(p) for p in parts])
        told = passage_dedup.telling_apart(x, (x % np.uint64(7) * np.uint64(20)).astype(np.uint8), done, np.array([0, len(x)]), 46, 0.8)
        names = passage_dedup.told_apart(x, 62)
        lacks = (x == lone) | np.isin(x, x[told])
        for a in range(0, len(x) - 46, 3):
            for b in (a + 46, a + 60, a + 91, a + 150):
                if b <= len(x) and not done[a:b].all():
                    missing = len(np.unique(names[a:b][lacks[a:b]])) / len(np.unique(names[a:b]))
                    assert missing > 0.2 or lacks[a:b].mean() > 0.2
                    checked += 1
    assert checked > 1000


def test_where_a_passage_may_be():
    """Against runs of tokens of which enough are in the other text: every pair with such a run around a wanted token is kept."""
    r = np.random.default_rng(9)
    for _ in range(30):
        x = r.integers(0, 60, 120)
        names, made = np.unique(x, return_inverse=True)
        others = [np.flatnonzero(r.random(len(names)) < share) for share in (0, 0.3, 0.7, 0.9, 1)]
        wanted = np.zeros(120, bool)
        wanted[r.integers(0, 120, 3)] = True
        got = passage_dedup.may_cover(made, wanted, np.concatenate(others), np.array([len(y) for y in others]), 0.8)
        for y, g in zip(others, got, strict=True):
            held = np.isin(made, y)
            place = np.flatnonzero(held)
            spans = [(max(a, place[0]), min(b, place[-1] + 1)) for a, b in passage_dedup.stretches(held, 46, 0.8)]
            assert g or not any(wanted[a:b].any() for a, b in spans)
        assert not got[0] and got[-1]


def edited(tokens, r, share):
    """tokens with some runs replaced, left out, put in or moved; new ones occur nowhere else."""
    out = list(tokens)
    for _ in range(r.poisson(share * len(out) / 5)):
        a, kind = int(r.integers(0, len(out) - 6)), r.integers(0, 8)
        new = [passage_dedup.LONE] * int(r.integers(1, 6))
        if kind < 5:
            out[a : a + len(new)] = new
        elif kind == 5:
            out[a:a] = new
        elif kind == 6:
            del out[a : a + len(new)]
        else:
            piece, out[a : a + 5] = out[a : a + 5], []
            out[(b := int(r.integers(0, len(out)))) : b] = piece
    return np.array(out, np.uint64)


def test_pairs_that_are_dropped_by_the_last_bits_cover_nothing():
    """Every pair of which `passages` finds a passage around a wanted token is kept; copies whose edits are too many together are not."""
    r = np.random.default_rng(11)
    useful = dropped = 0
    for i in range(150):
        base = r.integers(1, 1 << 48, int(r.integers(46, 220)), dtype=np.uint64)
        if i % 3 == 0:  # some tokens again and again
            base[r.integers(0, len(base), len(base) // 4)] = base[:3][r.integers(0, 3, len(base) // 4)]
        share = r.choice([0.05, 0.15, 0.3])
        x = edited(base, r, share)
        others = [np.concatenate([r.integers(1, 1 << 48, int(r.integers(0, 40)), dtype=np.uint64), edited(base, r, share)]) for _ in range(6)]
        wanted = np.zeros(len(x), bool)
        a = int(r.integers(0, len(x)))
        wanted[a : a + int(r.integers(1, 30))] = True
        few = passage_dedup.few_bits
        got = passage_dedup.may_match(few(x).astype(np.int64), wanted, few(np.concatenate(others)), np.array([len(y) for y in others]), 46, 0.8)
        for y, g in zip(others, got.tolist(), strict=True):
            spans = passage_dedup.passages(passage_dedup.told_apart(x, 62), passage_dedup.told_apart(y, 61), None, 46, 0.8, wanted=wanted)
            covers = any(wanted[a:b].any() for a, b in spans)
            assert g or not covers
            useful, dropped = useful + covers, dropped + (not g)
    assert useful > 100 and dropped > 100


def test_passage_dedup_fetches_partners_in_rounds(spark, monkeypatch):
    """A crowd of near copies: what is fetched at once is bounded by the text, however many pairs there are, and changes no result."""
    r = random.Random(31)
    base, rows = fresh(60, r), []
    for i in range(120):
        w = list(base)
        for _ in range(2):
            w[r.randrange(60)] = f"edit{r.randrange(10**9)}"
        rows.append((i, " ".join(around(w, r, 20))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    rounds: dict[str, list[int]] = {}
    write = passage_dedup.written

    def counted(frames, name):
        frames = [frames] if hasattr(frames, "write") else list(frames)
        rounds.setdefault(name, []).append(len(frames))
        return write(frames, name)

    monkeypatch.setattr(passage_dedup, "written", counted)
    monkeypatch.setattr(passage_dedup, "ROUND", 1000)
    want = removed(docs, chunk_bytes=60_000)
    assert {n for x in rounds.values() for n in x} == {1} and any(spans for spans, _ in want.values())
    rounds.clear()
    monkeypatch.setattr(passage_dedup, "ROUND", 0.5)
    assert removed(docs, chunk_bytes=60_000) == want
    assert max(rounds["found"]) > 1 or max(rounds["able"]) > 1
    assert rounds["regions"] == rounds["windows"] == rounds["pairs"] == [1]


def test_written_tables_leave_no_shuffle_files(spark):
    import time

    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",")
        return {f for f in files.split(",") if "shuffle_" in f}

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(key, None), shuffled()
    back = components.written(spark.range(20_000).repartition(7, "id").groupBy((F.col("id") % 9).alias("k")).count(), "no-shuffles")
    assert spark.conf.get(key, None) == setting
    for _ in range(50):
        if not shuffled() - before:
            break
        time.sleep(0.1)
    assert not shuffled() - before
    assert back.count() == 9
