"""Queries and SQL of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, line_dedup, media, minhash, secret_scan, suffix_dedup, toxicity
from .exact_topk import top_k
from .packing import pack_documents
from .sentencepiece_bpe import encode_documents
from .shared import table


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_decisions(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.with_features(media.with_metadata(media.store(table(spark, sf_dir, "documents"))))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"), words=2)


#: Schemas of the tools that calls are checked against; calls of other tools are taken as they are.
TOOLS = {
    "search": {"type": "object", "properties": {"query": {"type": "string"}, "limit": {"type": "integer", "minimum": 1}}, "required": ["query"]},
    "calculate": {"type": "object", "properties": {"expression": {"type": "string"}}, "required": ["expression"], "additionalProperties": False},
}


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(chat.with_tool_turns(table(spark, sf_dir, "conversations")), TOOLS)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.span_digests(secret_scan.scan_documents(table(spark, sf_dir, "documents")))


def op9_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


OP9_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
  FROM scored
)
SELECT * FROM ranked WHERE "rank" <= 5
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {x.__name__: x for x in (op1_toxicity, op2_line_dedup, op3_suffix_dedup, op4_packing, op5_media, op6_minhash, op7_chat, op8_secrets, op9_topk, op10_sentencepiece)}


def oracle_sql() -> dict[str, str]:
    return {"op2_line_dedup": line_dedup.LINE_SQL, "op9_topk": OP9_SQL}
