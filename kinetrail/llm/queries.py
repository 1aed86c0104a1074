"""The registered queries of this subpackage and their DuckDB SQL. Each query derives its columns from what the operator returns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, importance_resampling, language_id, line_dedup, ngram_join, passage_dedup, ppm, quality_rules, sentencepiece_codec, suffix_dedup, token_ids, warc
from .common import shared_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs).select("doc_id", "__quality.*")


OP1_SQL = r"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
g AS (SELECT doc_id, i, k, count(*) OVER (PARTITION BY doc_id, k) AS c FROM (
        SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w))),
r AS (SELECT doc_id, count(DISTINCT i + o) AS n FROM g, (VALUES (0), (1), (2)) AS s(o) WHERE c > 1 GROUP BY doc_id),
f AS (SELECT w.doc_id, w, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, len(l)::BIGINT AS nl, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
             coalesce(r.n, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN r USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT (base_failed OR word_chars < 2 * n_words OR word_chars > 14 * n_words OR 10 * n_symbols > n_words OR 10 * n_dup_lines > 3 * nl
            OR 2 * len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) > n_words OR 10 * len(list_filter(w, lambda x: lower(x) <> upper(x))) < 7 * n_words) AS kept
FROM b"""


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "__lines.n_lines", "__lines.n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (SELECT doc_id, p, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
           FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS p FROM documents)),
c AS (SELECT k, max(doc_id) AS keep FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, c.k IS NOT NULL AND doc_id <> keep AS gone FROM l LEFT JOIN c ON l.k = c.k)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")).select("doc_id", "__leak.*")
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


OP10_SQL = r"""
WITH lo AS (SELECT doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM lo),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
n AS (SELECT DISTINCT least(len(w), 10) AS m FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, m, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT item_id, w, least(len(w), 10) AS m, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, n WHERE len(w) >= m)),
h AS (SELECT id, item_id, i, dw.m FROM dw JOIN bw ON dw.k = bw.k AND dw.m = bw.m),
x AS (SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + m)) AS p FROM h) GROUP BY id),
y AS (SELECT id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY id)
SELECT d.id AS doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN x USING (id) LEFT JOIN y USING (id)"""


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "token-ids")
    token_ids.write_token_ids(table(spark, sf_dir, "documents").select("doc_id", "text"), folder, vocabulary("word_bpe_49k.json"), end_id=1)
    return token_ids.read_token_ids(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return warc.read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest"""


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = sentencepiece_codec.encode(docs, vocabulary("piece_bpe_32k.model"), decoded="decoded")
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    return ppm.score(table(spark, sf_dir, "documents").select("doc_id", "text"), held)


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = suffix_dedup.suffix_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return cut.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 5) + 2)) AS i FROM w WHERE len(w) > 0)),
s AS (SELECT doc_id, count(*) AS n, list(k ORDER BY k) AS ks FROM g GROUP BY doc_id),
r AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY ks) AS rep FROM s),
q AS (SELECT g.doc_id, g.k, r.n FROM g JOIN r USING (doc_id) WHERE r.rep = r.doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM q a JOIN q b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 10 * count(*) >= 8 * (a.n + b.n - count(*))),
c AS (SELECT x, x AS y FROM p UNION SELECT c.x, p.y FROM c JOIN p ON c.y = p.x),
m AS (SELECT x, min(y) AS root FROM c GROUP BY x),
l AS (SELECT x, count(*) AS n FROM p GROUP BY x)
SELECT d.doc_id, coalesce(m.root, r.rep, d.doc_id) AS class_id, coalesce(r.rep, d.doc_id) AS rep_id, coalesce(l.n, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN r USING (doc_id) LEFT JOIN m ON m.x = r.rep LEFT JOIN l ON l.x = r.rep"""


def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = passage_dedup.passage_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))
    n_dup = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["b"] - s["a"])
    return cut.select("doc_id", "n_words", n_dup.alias("n_dup_words"), F.size("spans").cast("long").alias("n_spans"), "sources", F.sha2("kept", 256).alias("kept_sha256"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance_resampling.resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH crc AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t FROM (SELECT unnest(range(256)) AS b)),
a AS (SELECT 's' AS side, doc_id AS id, text FROM documents UNION ALL SELECT 't', NULL, text FROM benchmark),
w AS (SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM a),
f AS (SELECT side, id, k, count(*) AS n FROM (SELECT side, id, unnest(w) AS k FROM w) GROUP BY side, id, k),
d AS (SELECT k, sum(n) FILTER (side = 's') AS s, sum(n) FILTER (side = 't') AS t FROM f GROUP BY k),
x AS (SELECT k, s, t, list_transform(range(strlen(k)), lambda i: ('0x' || substr(hex(encode(k)), 2 * i + 1, 2))::BIGINT) AS b FROM d),
h AS (SELECT k, s, x.t, xor(list_reduce(list_prepend(4294967295, b), lambda c, y: xor(c >> 8, crc.t[(xor(c, y) & 255) + 1])), 4294967295) % 10000 AS bucket FROM x, crc),
g AS (SELECT bucket, coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM h GROUP BY bucket),
gain AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM g),
m AS (SELECT id, sum(n * gain)::DOUBLE AS total FROM f JOIN h USING (k) JOIN gain USING (bucket) WHERE side = 's' GROUP BY id),
r AS (SELECT id AS doc_id, len(w)::BIGINT AS n_features, CASE WHEN len(w) = 0 THEN 0 ELSE floor(total / len(w))::BIGINT END AS weight, ('0x' || sha256('2024:' || id)[1:8])::BIGINT AS h FROM w LEFT JOIN m USING (id) WHERE side = 's'),
v AS (SELECT doc_id, n_features, weight, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS p, count(*) FILTER (n_features >= 20) OVER () AS n FROM v)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND p <= 10 * n // 100 THEN p END AS rank FROM o"""


def op12_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 4 == 2
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return language_id.language_id(docs, ~held).select("doc_id", held.alias("held_out"), F.col("__lang.pred").alias("lang_pred"), F.col("__lang.score").alias("score"))


QUERIES = {"op7_passage_dedup": op7_passage_dedup, "op8_ngram_join": op8_ngram_join, "op9_suffix_dedup": op9_suffix_dedup, "op3_ppm": op3_ppm, "op2_token_ids": op2_token_ids, "op5_warc": op5_warc, "op6_sentencepiece": op6_sentencepiece, "op1_quality_rules": op1_quality_rules, "op4_line_dedup": op4_line_dedup, "op10_decontamination": op10_decontamination, "op11_importance_resampling": op11_importance_resampling, "op12_language_id": op12_language_id}
ORACLES = {"op8_ngram_join": OP8_SQL, "op5_warc": OP5_SQL, "op1_quality_rules": OP1_SQL, "op4_line_dedup": OP4_SQL, "op10_decontamination": OP10_SQL, "op11_importance_resampling": OP11_SQL}
