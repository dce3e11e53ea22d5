"""Documents to a weighted graph and a retrieval store."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.operators import chunking, dedup, extraction, linking, retrieval, weighting
from tessera.session import cut_lineage

from .config import Settings


@dataclass(frozen=True)
class Graph:
    triples: DataFrame
    edges: DataFrame
    names: DataFrame
    doc_links: DataFrame


def linked(triples: DataFrame, s: Settings, by_embedding: bool = True) -> tuple[DataFrame, DataFrame]:
    """Triples under canonical names, and the names. Each distinct entity is embedded once."""
    entities = triples.select(F.explode(F.array("s", "o")).alias("entity")).distinct()
    if by_embedding:
        vectors = cut_lineage(entities.select(F.col("entity").alias("id"), v.hashing_embedding(F.col("entity")).alias("emb")), "entities")
        clusters = linking.embedding_clusters(vectors, s.entity_linking_threshold).select(F.col("id").alias("entity"), F.col("component").alias("cluster"))
    else:
        clusters = linking.string_clusters(entities)
    names = cut_lineage(linking.canonical_names(clusters, weighting.degrees(weighting.edge_list(triples))), "names")
    return linking.renamed_triples(triples, names), names


def build_graph(docs: DataFrame, s: Settings, extractor: extraction.Extractor = extraction.plain_extractor, by_embedding: bool = False) -> Graph:
    """Deduplicates, chunks, extracts, filters, links, weighs."""
    docs = dedup.exact_dedup(docs)
    chunks = chunking.window_chunks(docs, s.graph_chunk_size, s.graph_chunk_size - s.graph_chunk_overlap, "structural")
    found = extraction.extract_triples(chunks, extractor, s.max_triplets_per_chunk)
    found = extraction.filtered(found, s.quality_threshold, s.quality_mode).where("s <> o")
    once = found.select("doc_id", "s", "r", "o").distinct()
    triples = cut_lineage(once.withColumn("triple_idx", F.xxhash64("s", "r", "o")), "triples")
    triples, names = linked(triples, s, by_embedding)
    triples = cut_lineage(triples, "linked")
    edges = weighting.weighted_graph(triples, "minmax" if s.normalize == "none" else s.normalize, s.normalize != "none", threshold=s.relation_compat_threshold, top_entities=s.top_entities, least_support=s.least_support)
    return Graph(triples, weighting.above_cutoff(edges, s.final_weight_cutoff), names, weighting.doc_links(triples))


def build_with_retrieval(docs: DataFrame, s: Settings, extractor: extraction.Extractor = extraction.plain_extractor, embed: Callable = v.hashing_embedding) -> tuple[Graph, DataFrame, DataFrame]:
    """The graph, the retrieval store, and which graph chunks each retrieval chunk overlaps."""
    chunks = cut_lineage(chunking.dual_chunks(dedup.exact_dedup(docs), (s.retrieval_chunk_size, s.retrieval_chunk_overlap), (s.graph_chunk_size, s.graph_chunk_overlap)), "chunks")
    return build_graph(docs, s, extractor), retrieval.build_store(chunks.where("chunk_type = 'semantic'"), embed), chunking.overlapping(chunks)
