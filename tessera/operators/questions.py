"""Questions to a graph with a retrieval store: starting nodes, sample questions, answers.

Everything works on a set of questions at once, never on one after the other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.session import cut_lineage

from . import paths, retrieval, weighting

Embed = Callable[[Column], Column]
LEAST_PART = 5  # characters of a name or chunk id that may be a part of the other


def graph_nodes(triples: DataFrame) -> DataFrame:
    """node and chunk_ids: the chunks that a node's triples (s, o, chunk_id) come from."""
    return triples.select(F.explode(F.array("s", "o")).alias("node"), "chunk_id").groupBy("node").agg(F.sort_array(F.collect_set("chunk_id")).alias("chunk_ids"))


def nodes_of_chunks(chunks: DataFrame, nodes: DataFrame) -> DataFrame:
    """query_id and node for the chunk ids (query_id, chunk_id) that a retrieval gave.

    A chunk id that is a node's name stands for that node alone. Any other stands for the nodes
    that name it among their chunks, and for those whose name is a part of it or the other way
    round, in any case, if the part has five characters. Parts are looked up by equi-joins: the
    stretches of an id against names, and an id's first five characters against those of names."""
    chunks = cut_lineage(chunks.select("query_id", "chunk_id").distinct(), "asked-chunks")
    named = chunks.join(nodes.select("node"), F.col("chunk_id") == F.col("node")).select("query_id", "chunk_id", "node")
    other = chunks.join(named.select("chunk_id").distinct(), "chunk_id", "left_anti").withColumn("low", F.lower("chunk_id"))
    listed = nodes.select("node", F.explode("chunk_ids").alias("chunk_id")).join(other, "chunk_id").select("query_id", "node")
    low = nodes.select("node", F.lower("node").alias("name"))
    size = F.char_length("low")
    starts = F.sequence(F.lit(1), size - LEAST_PART + 1)
    stretches = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(LEAST_PART), F.col("size") - i + 1), lambda n: F.substr("low", i, n))))
    parts = other.withColumn("size", size).where(F.col("size") >= LEAST_PART)
    inside = parts.select("query_id", F.explode(F.array_distinct(stretches)).alias("name")).join(low, "name").select("query_id", "node")
    grams = low.where(F.char_length("name") >= LEAST_PART).select("node", "name", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.char_length("name") - LEAST_PART + 1), lambda i: F.substr("name", i, F.lit(LEAST_PART))))).alias("gram"))
    around = parts.withColumn("gram", F.substring("low", 1, LEAST_PART)).join(grams, "gram").where(F.contains("name", F.col("low"))).select("query_id", "node")
    return named.select("query_id", "node").union(listed).union(inside).union(around).distinct()


def nodes_for_questions(questions: DataFrame, nodes: DataFrame, k: int = 5, embed: Embed = v.hashing_embedding) -> DataFrame:
    """query_id and the k nodes whose names are most like each question (query_id, question)."""
    store = nodes.select(F.col("node").alias("vec_id"), embed(F.col("node")).alias("emb"))
    asked = questions.select("query_id", embed(F.col("question")).alias("q"))
    return retrieval.top_k(store, asked, k).select("query_id", F.col("vec_id").alias("node"))


def top_edges(edges: DataFrame, k: int) -> DataFrame:
    """The k heaviest edges."""
    return edges.orderBy(F.desc("weight"), "src", "dst").limit(k)


def sample_questions(docs: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """query_id and question: about the nodes of most links, the first documents' first sentences and the heaviest edges. The numbers are the feature.

    Repeats go; the order is that of a hash, so that it is the same in each run."""
    hubs = weighting.degree_centrality(edges).orderBy(F.desc("centrality"), "node").limit(n // 2)
    about = hubs.select(F.explode(F.array(F.format_string("What is %s?", "node"), F.format_string("How does %s work?", "node"))).alias("question"))
    first = F.substring(F.element_at(F.split(F.trim("text"), "[.]"), 1), 1, 100)
    said = docs.orderBy("doc_id").limit(n // 2).select(first.alias("question")).where(F.char_length("question") > 10)
    related = top_edges(edges, n // 3).select(F.format_string("How is %s %s %s?", "src", F.coalesce("relation", F.lit("related to")), "dst").alias("question"))
    drawn = about.union(said).union(related).distinct().orderBy(F.xxhash64("question"), "question").limit(n)
    return drawn.select(F.xxhash64("question").alias("query_id"), "question")


def evidence(found: DataFrame, k: int = 5) -> DataFrame:
    """The first k paths from each start of each question, in the order in which they were found."""
    from pyspark.sql import Window

    order = Window.partitionBy("query_id", "start").orderBy("depth", F.desc("score"), "path")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def similarities(questions: DataFrame, nodes: DataFrame, embed: Embed = v.hashing_embedding) -> DataFrame:
    """query_id, node and sim of every node with every question of the stated set."""
    store = nodes.select(F.col("node").alias("vec_id"), embed(F.col("node")).alias("emb"))
    return retrieval.scores(store, questions.select("query_id", embed(F.col("question")).alias("q"))).select("query_id", F.col("vec_id").alias("node"), F.col("score").alias("sim"))


def starts_of(questions: DataFrame, nodes: DataFrame, chunks: DataFrame | None = None, k: int = 5, embed: Embed = v.hashing_embedding) -> DataFrame:
    """query_id and start: the nodes of the retrieved chunks; for questions without any, the k nodes most like them."""
    if chunks is None:
        return nodes_for_questions(questions, nodes, k, embed).withColumnRenamed("node", "start")
    found = cut_lineage(nodes_of_chunks(chunks, nodes), "starts")
    rest = questions.join(found.select("query_id").distinct(), "query_id", "left_anti")
    return found.union(nodes_for_questions(rest, nodes, k, embed)).withColumnRenamed("node", "start")


def precomputed_paths(docs: DataFrame, edges: DataFrame, nodes: DataFrame, n: int = 10, least: float = 0.5, embed: Embed = v.hashing_embedding) -> DataFrame:
    """Paths of sample questions with a final score above ``least``, to be merged into the graph."""
    questions = cut_lineage(sample_questions(docs, edges, n), "sample-questions")
    sims = cut_lineage(similarities(questions, nodes, embed), "similarities")
    found = paths.beam_paths(edges, starts_of(questions, nodes, embed=embed), sims)
    ranked = paths.ranked_paths(found, edges, sims, limit=None)
    return ranked.where(F.col("final_score") > least).withColumn("distance", F.col("final_score"))


def answer(questions: DataFrame, edges: DataFrame, nodes: DataFrame, store: DataFrame, mapping: DataFrame, top_k: int = 5, top_paths: int = 10, max_steps: int = 5, embed: Embed = v.hashing_embedding) -> DataFrame:
    """From question to answer: retrieval, chunk ids, starting nodes, search, ranking, text.

    ``store`` (doc_id, chunk_id, chunk, emb) is a retrieval store, ``mapping`` (retrieval_chunk_id,
    graph_chunk_id) says which graph chunks a chunk overlaps, ``nodes`` (node, chunk_ids) where a node
    comes from. Returns query_id, confidence, the best paths and the retrieved chunks as text."""
    from .chunking import graph_chunk_ids

    questions = cut_lineage(questions, "questions")
    asked = questions.select("query_id", embed(F.col("question")).alias("q"))
    ids = store.select(F.col("chunk_id").alias("vec_id"), "emb")
    hits = retrieval.top_k(ids, asked, top_k).withColumnRenamed("vec_id", "chunk_id")
    hits = cut_lineage(graph_chunk_ids(hits.join(store.select("chunk_id", "doc_id", "chunk"), "chunk_id"), mapping), "hits")
    chunks = hits.select("query_id", F.explode("graph_chunk_ids").alias("chunk_id"))
    starts = cut_lineage(starts_of(questions, nodes, chunks, embed=embed), "starts")
    sims = cut_lineage(similarities(questions, nodes, embed), "similarities")
    ranked = cut_lineage(paths.multi_hop(edges, starts, sims, max_steps, limit=top_paths), "ranked")
    preview = F.concat(F.substring("chunk", 1, 150), F.lit("..."))
    texts = hits.where(F.col("rank") <= 3).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", preview.alias("text")))), lambda x: x["text"]), "\n").alias("documents"))
    return questions.join(paths.answers(ranked), "query_id", "left").join(texts, "query_id", "left").join(paths.confidence(ranked), "query_id", "left")
