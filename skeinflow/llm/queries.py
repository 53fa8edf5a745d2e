"""Queries over the whole tables, one for each training-data operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact, langid, near, packing, quality, repeats, shards, warc
from .common import new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = chat.format_pairs(chat.branches(table(spark, sf_dir, "conversations")))
    spans = {n: F.array_join(F.transform(n, lambda s: F.concat_ws(":", s["start"].cast("string"), s["stop"].cast("string"))), ",") for n in ("chosen_spans", "rejected_spans")}
    return out.withColumns(spans | {"conv_id": F.col("pair_id").cast("bigint")}).drop("pair_id")


ARRIVALS = 8


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight arrivals, appended one after the other, compacted, and read back by the last manifest."""
    docs = table(spark, sf_dir, "documents")
    store = shards.ShardStore(spark, new_path(spark, "shards"), docs.schema)
    store.append_arrivals(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    store.compact()
    store.vacuum()
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2("text", 256).alias("text_sha256"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


QUERIES = {f.__name__: f for f in (op1_language_id, op2_decontamination, op3_quality, op4_chat_format, op5_sharding, op6_near_dedup, op7_substring_dedup, op8_warc, op9_packing, op10_exact_dedup)}

ORACLE_SQL = {
    "op4_chat_format": r"""
WITH c AS (SELECT DISTINCT coalesce(conv_id::VARCHAR, '') AS key, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
a AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY turn DESC, sha256(text) DESC) AS back FROM c WHERE role = 'assistant'),
l AS (SELECT key, turn AS last_turn FROM a WHERE back = 1),
e AS (SELECT key, text AS old FROM a WHERE back = 2),
t AS (SELECT DISTINCT * FROM (
  SELECT key, 'chosen' AS side, turn, role, text FROM c
  UNION ALL SELECT c.key, 'rejected', turn, role, text FROM c LEFT JOIN l ON c.key = l.key WHERE last_turn IS NULL OR turn < last_turn
  UNION ALL SELECT l.key, 'rejected', last_turn, 'assistant', coalesce(old, '') FROM l LEFT JOIN e ON l.key = e.key)),
n AS (SELECT *, row_number() OVER (PARTITION BY key, side ORDER BY turn, role, sha256(text)) - 1 AS pos FROM t),
d AS (SELECT coalesce(x.key, y.key) AS key, min(coalesce(x.pos, y.pos)) AS stop
      FROM (SELECT * FROM n WHERE side = 'chosen') x FULL JOIN (SELECT * FROM n WHERE side = 'rejected') y ON x.key = y.key AND x.pos = y.pos
      WHERE x.key IS NULL OR y.key IS NULL OR x.role <> y.role OR x.text <> y.text GROUP BY 1),
p AS (SELECT n.*, CASE WHEN d.stop IS NULL OR n.pos < d.stop THEN 'prompt' ELSE side END AS part, CASE WHEN d.stop IS NULL OR n.pos < d.stop THEN n.pos ELSE n.pos - d.stop END AS place,
             '<|im_start|>' || role || chr(10) AS head FROM n LEFT JOIN d ON n.key = d.key),
r AS (SELECT *, place // 256 AS segment, head || text || '<|im_end|>' || chr(10) AS rendered FROM p WHERE part <> 'prompt' OR side = 'chosen'),
s AS (SELECT *, coalesce(sum(length(rendered)) OVER (PARTITION BY key, part, segment ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r),
m AS (SELECT *, CASE WHEN role = 'assistant' THEN (start + length(head)) || ':' || (start + length(rendered) - 1) END AS span FROM s)
SELECT TRY_CAST(key AS BIGINT) AS conv_id, segment,
       coalesce(string_agg(rendered, '' ORDER BY place) FILTER (WHERE part = 'prompt'), '') AS prompt,
       coalesce(string_agg(rendered, '' ORDER BY place) FILTER (WHERE part = 'chosen'), '') AS chosen,
       coalesce(string_agg(rendered, '' ORDER BY place) FILTER (WHERE part = 'rejected'), '') AS rejected,
       coalesce(string_agg(span, ',' ORDER BY place) FILTER (WHERE part = 'chosen'), '') AS chosen_spans,
       coalesce(string_agg(span, ',' ORDER BY place) FILTER (WHERE part = 'rejected'), '') AS rejected_spans
FROM m GROUP BY key, segment
""",
    "op5_sharding": "SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256 FROM documents",
    "op8_warc": r"""
WITH t AS (SELECT page_id, coalesce(html, '') AS p, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
-- base32 of a SHA-1: 160 bits as 32 groups of five, from the hexadecimal digits of 20 bits at a time
h AS (SELECT *, sha1(p) AS x FROM t),
b AS (SELECT *, list_transform(range(32), lambda i: (('0x' || substr(x, (i // 4) * 5 + 1, 5))::INTEGER >> (15 - 5 * (i % 4))) & 31) AS v FROM h)
SELECT page_id, octet_length(encode(p))::BIGINT AS payload_bytes,
       array_to_string(list_transform(v, lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (k + 1)::INTEGER, 1)), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM b
""",
    "op10_exact_dedup": r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS s FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY s) AS group_size,
       row_number() OVER w = 1 AS kept, s AS text_sha256
FROM t WINDOW w AS (PARTITION BY s ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
""",
}
