"""The corpus pipeline over ``documents``: toxic documents go, repeated lines go,
one of each group of near-duplicates stays, secrets are masked, the rest is packed.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept
and returns the columns of documents, the last one its pieces. ``run`` writes
each stage's rows as Parquet in the shared folder and reads them again.

Cases: a null text scores like an empty one, has nothing to drop, link or mask, stays
null until packing, and is packed as the end id alone; so is a text of which no line
stays. Rows without a doc_id count as larger than all others where ids are compared;
repeated rows are kept, lose the same lines and are packed each; rows that repeat an
id with another text are judged by their own text. Columns beside doc_id and text are
carried along whatever their names, but for n_chars, which is counted anew. An empty
table passes through all stages and gives no pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import line_dedup, minhash, packing, secret_scan, toxicity
from tessera.llm.shared import Scratch, table
from tessera.session import sized


def _sized(df: DataFrame, docs: DataFrame) -> DataFrame:
    """A stage's rows in as few partitions, and so files, as the number of documents calls for."""
    return sized(df, docs.count(), 1 << 13)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7; the lexicon is learnt from labelled training rows."""
    return toxicity.keep_clean(_sized(docs, docs), toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds are taken out; documents stay, even if nothing is left."""
    return _sized(line_dedup.deduplicate(docs), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near-duplicates, by five words and a similarity of 0.8."""
    return _sized(minhash.keep_one(docs, words=5, percent=80), docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by a mask."""
    return secret_scan.redact(_sized(docs, docs))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in windows of at most 2048."""
    pieces = packing.pack_documents(_sized(docs, docs), public_tokenizers.path("word_bpe_49k.json"), remembered=32 << 20)  # beside the memory that the other stages have taken
    return _sized(pieces, docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near_duplicates), ("secrets", mask_secrets), ("packing", pack)]

#: The learnt lexicon, the similarity classes and the tokenizer aren't expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch, before = table(spark, sf_dir, "documents"), Scratch(spark), []
    for name, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir), f"pipeline-{name}")
        scratch.drop(*before)
        before = [f"pipeline-{name}"]
    return docs
