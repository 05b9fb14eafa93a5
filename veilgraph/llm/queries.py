"""Queries of the training-data operators and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veilgraph.llm import chat, chunkdedup, ctxmix, decontam, neardup, packing, pii, quality, sharding, warc
from veilgraph.llm._common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


def op3_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.recover_roles(table(spark, sf_dir, "conversations"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).drop("__thash", "__first")


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunkdedup.find_repeats(table(spark, sf_dir, "documents"))


def op10_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctxmix.score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_personal_data": op2_personal_data,
    "op3_roles": op3_roles,
    "op4_quality": op4_quality,
    "op5_pack": op5_pack,
    "op6_shards": op6_shards,
    "op7_warc": op7_warc,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_repeats": op9_repeats,
    "op10_score": op10_score,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: The others fit, sign, pack or score, which SQL doesn't express; tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": f"""
WITH i AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS w FROM benchmark),
v AS (SELECT DISTINCT item, list_slice(w, k, k + 9) AS win FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
t AS (SELECT item, array_to_string(win, ' ') AS win, len(win) AS n FROM v),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT DISTINCT n FROM t),
p AS (SELECT doc_id, n, k, array_to_string(list_slice(w, k, k + n - 1), ' ') AS win FROM (SELECT doc_id, n, w, unnest(range(1, len(w) - n + 2)) AS k FROM d, s WHERE len(w) >= n)),
h AS (SELECT doc_id, t.item, p.k, p.n FROM p JOIN t ON p.win = t.win AND p.n = t.n),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS x FROM h) GROUP BY 1),
o AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(items, '') AS items
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN o ON d.doc_id = o.doc_id""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY html) END AS first FROM p)
SELECT page_id, n AS payload_bytes, sha256(html) AS payload_digest, CASE WHEN first IS NOT NULL AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f""",
}
