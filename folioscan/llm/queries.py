"""Registered queries of this package, and SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (binary_packing, hamming_search, hard_negatives, line_dedup, metric_join, pieces, pii, resampling, setsketch,
               token_files, toxicity, warc, wrappers)
from .chunks import ByteLevel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# A worker keeps its tables of chunks from task to task.
@cache
def byte_bpe() -> ByteLevel:
    return ByteLevel(public_tokenizers.path("byte_bpe_50k.json"), spaced=True)


@cache
def word_bpe() -> ByteLevel:
    return ByteLevel(public_tokenizers.path("word_bpe_49k.json"), spaced=False)


@query("op1_token_files")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    manifest = token_files.write(table(spark, folder, "documents"), byte_bpe, end_id=0, vocabulary=50_257)
    return token_files.read(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op2_skip_chain")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = pii.find(docs, pii.fit(docs))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
                        pii.joined(F.col("spans")).alias("spans"))


@query("op3_wrappers")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return wrappers.main_text(table(spark, folder, "pages")).withColumn("n_chars", F.length("text").cast("long"))


@query("op4_sentencepiece")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    coded = pieces.encode(table(spark, folder, "documents"), public_tokenizers.path("piece_bpe_32k.model"), decode=True)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op5_metric_join")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    return metric_join.range_join(table(spark, folder, "embeddings"), 0.9)


@query("op6_setsketch")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    return setsketch.groups(table(spark, folder, "documents"), setsketch.Settings(width=2))


@query("op7_binary_packing")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    packed = binary_packing.pack(table(spark, folder, "documents"), word_bpe, end_id=2)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                         "sequence_id", "offset", "bucket")


@query("op8_hamming_search")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    return hamming_search.search(table(spark, folder, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op9_toxicity")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = toxicity.fit(docs, table(spark, folder, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op10_warc", """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS s FROM pages),
f AS (SELECT s, min(page_id) AS first FROM p GROUP BY s),
b AS (
  SELECT page_id, h, first, s,
    list_transform(range(0, 160), lambda i: (strpos('0123456789abcdef', s[(i // 4 + 1)::INT : (i // 4 + 1)::INT]) - 1)
      >> (3 - i % 4)::INT & 1) AS bits
  FROM p JOIN f USING (s))
SELECT page_id, strlen(h)::BIGINT AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (bits[k * 5 + 1] * 16 + bits[k * 5 + 2] * 8 + bits[k * 5 + 3] * 4 + bits[k * 5 + 4] * 2 + bits[k * 5 + 5] + 1)::INT, 1)),
    'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM b""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.read(warc.write(table(spark, folder, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op11_hard_negatives", """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS s
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT a, b AS p, s AS ps FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5)
SELECT a AS anchor_id, p AS positive_id, (row_number() OVER (PARTITION BY a, p ORDER BY s DESC, b))::INT AS rank,
  b AS negative_id, ps AS positive_score, s AS negative_score
FROM p JOIN s USING (a) WHERE NOT same AND 50 * ps <= 100 * s AND 100 * s <= 95 * ps
QUALIFY rank <= 3""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


@query("op12_resampling", """
WITH steps AS (
  SELECT list_reduce(list_prepend(n::BIGINT, range(0, 8)),
    lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v, n
  FROM range(0, 256) t(n)),
crc AS MATERIALIZED (SELECT list(v ORDER BY n) AS v FROM steps),
texts AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS k, text FROM documents
  UNION ALL SELECT 't', item_id, row_number() OVER (), text FROM benchmark),
w AS MATERIALIZED (
  SELECT side, id, k, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM texts),
f AS MATERIALIZED (
  SELECT side, k, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM w),
distinct_f AS (SELECT DISTINCT f FROM f),
b AS MATERIALIZED (
  SELECT f, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(f)),
      lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
    lambda c, x: xor(c >> 8, crc.v[(xor(c, x) & 255) + 1]))) % 10000 AS b
  FROM distinct_f, crc),
n AS MATERIALIZED (SELECT side, k, b, count(*) AS n FROM f JOIN b USING (f) GROUP BY ALL),
st AS (SELECT b, coalesce(sum(n) FILTER (side = 'd'), 0)::DOUBLE AS s, coalesce(sum(n) FILTER (side = 't'), 0)::DOUBLE AS t
  FROM n GROUP BY b),
all_st AS (SELECT sum(s) AS s, sum(t) AS t FROM st),
g AS (SELECT st.b, floor(1000 * ln((st.t + 1) * (a.s + 10000) / ((st.s + 1) * (a.t + 10000))))::BIGINT AS g
  FROM st, all_st a),
e AS (SELECT k, sum(n)::BIGINT AS n_features, floor(sum(n * g) / sum(n))::BIGINT AS weight
  FROM n JOIN g USING (b) WHERE side = 'd' GROUP BY k),
d AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || sha256('7:' || id)[1:8])::BIGINT AS h
  FROM w LEFT JOIN e USING (k) WHERE side = 'd'),
s AS (SELECT *, (weight + floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))))::BIGINT AS score FROM d),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
  FROM s WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, rank
FROM s LEFT JOIN (SELECT doc_id, rank FROM r WHERE rank <= 25 * n // 100) USING (doc_id)""")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_line_dedup", """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
    generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM l),
hot AS (SELECT k, max(doc_id) AS top FROM k WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT doc_id, pos, line, coalesce(doc_id <> top, false) AS gone FROM k LEFT JOIN hot USING (k))
SELECT doc_id, count(*) AS n_lines, count_if(gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    kept = line_dedup.apply(docs, line_dedup.keep_bitmaps(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))
