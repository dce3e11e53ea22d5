"""Chunks of documents and how they overlap."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as fn


#: Windows that are cut from one block of a text. A place in a string is counted from its start, so from the whole text each window would cost half of it.
BLOCK = 32


def window_chunks(docs: DataFrame, size: int, step: int, chunk_type: str) -> DataFrame:
    """Fixed windows of characters; the last one may be shorter. One narrow stage, linear in a text of common length."""
    n = F.char_length("text")
    last = F.greatest(F.lit(0), F.ceil((F.col("n") - size) / step)).cast("int")
    out = docs.where(n > 0).select("doc_id", "text", n.alias("n")).select("doc_id", "text", "n", last.alias("last"))
    out = out.select("doc_id", "text", "n", "last", F.explode(F.sequence(F.lit(0), F.floor(F.col("last") / BLOCK).cast("int"))).alias("block"))
    out = out.select("doc_id", "n", "last", (F.col("block") * BLOCK).alias("first"), F.substr("text", F.col("block") * (BLOCK * step) + 1, F.lit((BLOCK - 1) * step + size)).alias("part"))
    out = out.select("doc_id", "n", "first", "part", F.explode(F.sequence(F.col("first"), F.least("last", F.col("first") + (BLOCK - 1)))).alias("chunk_index"))
    start = F.col("chunk_index") * step
    out = out.select("doc_id", "chunk_index", F.lit(chunk_type).alias("chunk_type"), start.alias("start_char"), F.least(start + size, F.col("n")).alias("end_char"), F.substr("part", (F.col("chunk_index") - F.col("first")) * step + 1, F.lit(size)).alias("chunk"))
    return out.withColumn("chunk_id", fn.chunk_id(F.col("chunk"), F.col("doc_id"), F.col("chunk_index"))).withColumn("chunk_size", F.char_length("chunk"))


def dual_chunks(docs: DataFrame, retrieval: tuple[int, int] = (320, 120), graph: tuple[int, int] = (512, 50)) -> DataFrame:
    """Retrieval and graph chunks of the same documents; sizes and overlaps in characters."""
    return window_chunks(docs, retrieval[0], retrieval[0] - retrieval[1], "semantic").unionByName(window_chunks(docs, graph[0], graph[0] - graph[1], "structural"))


def overlapping(chunks: DataFrame) -> DataFrame:
    """Graph chunks that share characters with each retrieval chunk of the document; touching isn't overlapping.

    The documents' ids are the join key, so a document's chunks meet in one partition and the range test costs a document's chunks alone."""
    a = chunks.where("chunk_type = 'semantic'").select("doc_id", F.col("chunk_id").alias("retrieval_chunk_id"), F.col("start_char").alias("a0"), F.col("end_char").alias("a1"))
    b = chunks.where("chunk_type = 'structural'").select("doc_id", F.col("chunk_id").alias("graph_chunk_id"), F.col("start_char").alias("b0"), F.col("end_char").alias("b1"))
    return a.join(b, "doc_id").where("a0 < b1 and b0 < a1").select("doc_id", "retrieval_chunk_id", "graph_chunk_id")


def graph_chunk_ids(hits: DataFrame, mapping: DataFrame) -> DataFrame:
    """Each hit with its graph chunks, or 'doc_<id>_all' if none is known."""
    lists = mapping.groupBy("retrieval_chunk_id").agg(F.sort_array(F.collect_set("graph_chunk_id")).alias("ids"))  # bounded by one document's chunks
    joined = hits.join(lists, hits["chunk_id"] == lists["retrieval_chunk_id"], "left").drop("retrieval_chunk_id")
    return joined.withColumn("graph_chunk_ids", F.coalesce("ids", F.array(F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("_all"))))).drop("ids")


def pack_paragraphs(paragraphs: list[str], size: int, overlap: int, language: str = "en") -> list[str]:
    """Paragraphs gathered while they fit; a new chunk may begin with whole paragraphs of the last one."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for paragraph in paragraphs:
        if held and total + len(paragraph) > size:
            out.append("\n\n".join(held))
            carried: list[str] = []
            if overlap and (language != "en" or len(out[-1]) > overlap):
                room = overlap
                for earlier in reversed(held):
                    if len(earlier) > room:
                        break
                    carried.insert(0, earlier)
                    room -= len(earlier)
            held, total = carried, sum(map(len, carried))
        held.append(paragraph)
        total += len(paragraph)
    return [*out, "\n\n".join(held)] if held else out


def paragraph_chunks(docs: DataFrame, size: int = 2000, overlap: int = 200, separator: str = "\n\n") -> DataFrame:
    """Greedy packing depends on what was packed before, so it runs in Arrow batches, without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, language in zip(batch["doc_id"], batch["text"], batch["language"], strict=True):
                parts = [p.strip() for p in text.split(separator) if p.strip()]
                rows += [(doc_id, i, len(chunk), chunk) for i, chunk in enumerate(pack_paragraphs(parts, size, overlap, language))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk_index", "chunk_size", "chunk"])

    ready = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), fn.document_language(F.col("text")).alias("language"))
    return ready.mapInPandas(run, "doc_id long, chunk_index int, chunk_size int, chunk string")


def neighbours(rows: DataFrame, group: str, order: str, name: str) -> DataFrame:
    """Index, total, and the names before and after, within each group."""
    from pyspark.sql import Window

    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumns({"position": F.row_number().over(w) - 1, "total": F.count("*").over(Window.partitionBy(group)), "previous": F.lag(name).over(w), "next": F.lead(name).over(w)})


def sentences(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(fn.split_sentences(F.col("text"))).alias("position", "sentence"))


def sentence_context(docs: DataFrame, width: int = 1) -> DataFrame:
    """Every sentence with its neighbours, cut from the document's own array: no window, no shuffle."""
    parts = docs.select("doc_id", fn.split_sentences(F.col("text")).alias("parts"))
    low = lambda i: F.greatest(F.lit(1), i + 1 - width)
    rows = parts.select("doc_id", "parts", F.posexplode("parts").alias("position", "sentence"))
    i = F.col("position")
    return rows.select("doc_id", "position", "sentence", F.array_join(F.slice("parts", low(i), F.least(F.size("parts"), i + 1 + width) - low(i) + 1), " ").alias("context"))


def entity_contexts(docs: DataFrame, mentions: DataFrame, width: int = 1) -> DataFrame:
    """entity, doc_id, position and context: the sentences of its documents (doc_id, entity) that hold an entity in any case, with their neighbours.

    An entity whose first document doesn't hold it has that document's first sentence, or its
    first 200 characters, as well, at position -1. Each mention meets its own document alone."""
    pairs = mentions.select("doc_id", F.trim("entity").alias("entity")).where("entity <> ''").distinct()
    first = pairs.groupBy("entity").agg(F.min("doc_id").alias("first"))
    text = F.coalesce("text", F.lit(""))
    known = pairs.join(first, "entity").join(docs.select("doc_id", text.alias("text"), fn.split_sentences(text).alias("parts")), "doc_id")
    places = F.filter(F.sequence(F.lit(0), F.size("parts")), lambda i: F.coalesce(F.contains(F.lower(F.get("parts", i)), F.lower("entity")), F.lit(False)))
    known = known.withColumn("places", places)
    fallback = (F.size("places") == 0) & (F.col("doc_id") == F.col("first"))
    rows = known.withColumn("position", F.explode(F.when(fallback, F.array(F.lit(-1))).otherwise(F.col("places"))))
    low = F.greatest(F.lit(0), F.col("position") - width)
    around = F.array_join(F.slice("parts", low + 1, F.least(F.size("parts"), F.col("position") + 1 + width) - low), " ")
    start = F.coalesce(F.get("parts", F.lit(0)), F.substring("text", 1, 200))
    return rows.select("entity", "doc_id", "position", F.when(F.col("position") < 0, start).otherwise(around).alias("context"))


def dual_chunks_by_language(docs: DataFrame, sizes: dict[str, tuple[tuple[int, int], tuple[int, int]]]) -> DataFrame:
    """Dual chunks with the sizes and overlaps of each document's language; languages that aren't named take those of 'en'."""
    spoken = docs.withColumn("_language", fn.document_language(F.col("text")))
    parts = []
    for language, (retrieval, graph) in sizes.items():
        named = F.col("_language") == language
        own = spoken.where(named if language != "en" else named | ~F.col("_language").isin(*sizes))
        parts.append(dual_chunks(own.drop("_language"), retrieval, graph))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
