"""The dense retrieval store and top-k retrieval."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import vectors as v


def build_store(chunks: DataFrame, embed: Callable[[Column], Column] = v.hashing_embedding) -> DataFrame:
    """Chunks with unit vectors; each distinct text is embedded once, chunks without a direction are left out.

    A condition on an embedding would be moved below the distinct texts, and by the join to the chunks
    as well, and all of them be embedded there too; it doesn't pass an explode."""
    texts = chunks.select(F.col("chunk").alias("text")).distinct().withColumn("emb", embed(F.col("text")))
    texts = texts.select("text", F.explode(F.array("emb")).alias("emb")).where(v.norm(F.col("emb")) > 1e-9)
    return chunks.join(texts, chunks["chunk"] == texts["text"]).drop("text")


def scores(store: DataFrame, queries: DataFrame, block_rows: int = 65_536) -> DataFrame:
    """Every row of the store with every query's inner product: (query key, vec_id, score).

    The store is dealt into blocks by hash and never copied; each block gets the stated queries."""
    key = queries.columns[0]
    blocks = max(1, -(-store.count() // block_rows))
    dealt = queries.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    met = store.withColumn("_block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")).join(dealt, "_block").drop("_block")
    return met.withColumn("score", v.dot(F.col("q"), F.col("emb"))).select(key, "vec_id", "score")


def top_k(store: DataFrame, queries: DataFrame, k: int = 5, block_rows: int = 65_536) -> DataFrame:
    """The k rows of highest inner product for every query. Every task keeps its own best k of each query before anything is shuffled."""
    key = queries.columns[0]
    order = Window.partitionBy(key).orderBy(F.desc(F.round("score", 9)), "vec_id")
    return scores(store, queries, block_rows).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
