"""Path statistics, beam search, ranking."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import path_pairs
from tessera.functions.vectors import cosine
from tessera.session import cut_lineage


def node_stats(paths: DataFrame) -> DataFrame:
    """For each node of (path, distance) the number of mentions and the mean distance."""
    return paths.select(F.explode("path").alias("node"), "distance").groupBy("node").agg(F.count("*").alias("path_frequency"), F.avg("distance").alias("avg_path_distance"))


def edge_support(paths: DataFrame) -> DataFrame:
    """How many paths use each undirected edge, and their mean score if there is one."""
    used = paths.select(F.explode(path_pairs(F.col("path"))).alias("e"), "distance").where("e.src <> e.dst")
    return used.groupBy(F.least("e.src", "e.dst").alias("src"), F.greatest("e.src", "e.dst").alias("dst")).agg(F.count("*").alias("path_support"), F.avg("distance").alias("avg_path_score"))


def merge_paths(edges: DataFrame, paths: DataFrame) -> DataFrame:
    """Edges with path support; a step that no edge has becomes an inferred edge."""
    found = edge_support(paths).select("src", "dst", "path_support")
    return edges.join(found, ["src", "dst"], "full").withColumns({"relation": F.coalesce("relation", F.lit("path_inferred")), "path_support": F.coalesce("path_support", F.lit(0).cast("long"))})


def path_weights(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """Mean and sum of the edge weights along each path; a missing edge counts as 0."""
    steps = paths.select("path_id", F.explode_outer(path_pairs(F.col("path"))).alias("e"))
    known = edges.select("src", "dst", "weight")
    met = steps.join(known, (F.least("e.src", "e.dst") == F.col("src")) & (F.greatest("e.src", "e.dst") == F.col("dst")), "left")
    return met.groupBy("path_id").agg(F.avg(F.coalesce("weight", F.lit(0.0))).alias("mean_weight"), F.sum(F.coalesce("weight", F.lit(0.0))).alias("sum_weight"))


def path_records(paths: DataFrame, edges: DataFrame, embeddings: DataFrame) -> DataFrame:
    """What is known of each path (path_id, path): nodes, edge weights, mean similarity of neighbours by ``embeddings`` (node, emb), and hops between its ends.

    Hops are 1 where an edge joins the ends, 2 where a node is next to both, else null."""
    steps = paths.select("path_id", F.explode(path_pairs(F.col("path"))).alias("e"))
    of = lambda side: embeddings.select(F.col("node").alias(side), F.col("emb").alias(f"{side}_emb"))
    alike = steps.select("path_id", F.col("e.src").alias("x"), F.col("e.dst").alias("y")).join(of("x"), "x").join(of("y"), "y")
    alike = alike.groupBy("path_id").agg(F.avg(cosine(F.col("x_emb"), F.col("y_emb"))).alias("adjacent_similarity"))
    ways = adjacency(edges).select("src", "dst")
    ends = paths.where(F.size("path") > 1).select("path_id", F.element_at("path", 1).alias("src"), F.element_at("path", -1).alias("last"))
    next_to = ends.join(ways, "src").select("path_id", "last", "dst")
    one = next_to.where("dst = last").select("path_id", F.lit(1).alias("hops"))
    two = next_to.join(ways.select(F.col("src").alias("dst"), F.col("dst").alias("last")), ["dst", "last"]).select("path_id", F.lit(2))
    hops = one.union(two).groupBy("path_id").agg(F.min("hops").alias("hops"))
    out = paths.select("path_id", "path", F.size("path").alias("nodes")).join(path_weights(paths, edges), "path_id", "left")
    return out.join(alike, "path_id", "left").join(hops, "path_id", "left")


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.where("src <> dst").select("src", F.col("dst").alias("dst"), "weight").union(edges.where("src <> dst").select("dst", "src", "weight"))


def beam_paths(edges: DataFrame, starts: DataFrame, similarity: DataFrame, max_steps: int = 5, beam_width: int = 2, max_paths: int = 50) -> DataFrame:
    """Breadth-first beam search from (query_id, start): every path with score and depth.

    Tips of one depth are joined with their neighbours; what depends on the order of
    tips, who takes a neighbour first and when enough paths are found, is decided per
    start over that depth's few rows. ``similarity`` (query_id, node, sim) scores nodes;
    a missing one counts as 0. Ties go to the smaller name."""
    ways, similarity = cut_lineage(adjacency(edges), "adjacency"), cut_lineage(similarity, "similarity")  # each depth reads them again
    tips = starts.select("query_id", "start", F.array("start").alias("path"), F.lit(0).alias("turn"), F.array("start").alias("visited"), F.lit(0).alias("found"))
    done = None
    schema = "query_id long, start string, path array<string>, score double, depth int, turn int, visited array<string>, found int"
    for depth in range(1, max_steps + 1):
        near = tips.join(ways, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("visited", F.col("dst")))
        scored = near.join(similarity.withColumnRenamed("node", "dst"), ["query_id", "dst"], "left")
        scored = scored.withColumn("score", F.coalesce("sim", F.lit(0.0)) * 0.6 + F.coalesce("weight", F.lit(0.5)) * 0.4)

        def claim(rows: pd.DataFrame, depth: int = depth) -> pd.DataFrame:
            visited, found = set(rows["visited"].iloc[0]), int(rows["found"].iloc[0])
            out = []
            for _, tip in rows.sort_values(["turn", "score", "dst"], ascending=[True, False, True]).groupby("turn"):
                if found >= max_paths:
                    break
                fresh = tip[~tip["dst"].isin(visited)].head(beam_width)
                for path, dst, score in zip(fresh["path"], fresh["dst"], fresh["score"], strict=True):
                    visited.add(dst)
                    out.append(([*path, dst], float(score)))
                    found += 1
            first = rows.iloc[0]
            return pd.DataFrame([(first["query_id"], first["start"], path, score, depth, turn, sorted(visited), found) for turn, (path, score) in enumerate(out)], columns=["query_id", "start", "path", "score", "depth", "turn", "visited", "found"])

        level = cut_lineage(_by_start(scored, claim, schema), "beam")
        done = level if done is None else done.union(level)
        tips = level.where(F.col("found") < max_paths)
        if level.isEmpty():
            break
    return done.select("query_id", "start", "path", "score", "depth")


def _by_start(scored: DataFrame, claim, schema: str) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        return claim(rows)

    return scored.select("query_id", "start", "path", "turn", "visited", "found", "dst", "score").groupBy("query_id", "start").applyInPandas(run, schema)


def ranked_paths(paths: DataFrame, edges: DataFrame, similarity: DataFrame, limit: int | None = 10) -> DataFrame:
    """Paths by final score within each query, the best ``limit`` or all."""
    paths = paths.withColumn("path_id", F.xxhash64("query_id", "start", "path"))
    weights = path_weights(paths, edges).select("path_id", "mean_weight")
    best = paths.select("path_id", "query_id", F.explode("path").alias("node")).join(similarity, ["query_id", "node"], "left").groupBy("path_id").agg(F.max(F.coalesce("sim", F.lit(0.0))).alias("query_relevance"))
    out = paths.join(weights, "path_id").join(best, "path_id")
    final = F.col("score") * 0.4 + F.col("mean_weight") * 0.25 + 0.15 / (1 + 0.1 * F.size("path")) + F.col("query_relevance") * 0.2
    order = Window.partitionBy("query_id").orderBy(F.desc("final_score"), "start", "path")
    out = out.withColumn("final_score", final).withColumn("rank", F.row_number().over(order))
    return (out if limit is None else out.where(F.col("rank") <= limit)).drop("path_id")


def confidence(paths: DataFrame) -> DataFrame:
    return paths.groupBy("query_id").agg(F.coalesce(F.avg("score"), F.lit(0.0)).alias("confidence"))


def multi_hop(edges: DataFrame, starts: DataFrame, similarity: DataFrame, max_steps: int = 5, beam_width: int = 2, threshold: float = 0.7, limit: int = 10) -> DataFrame:
    """Searches, goes two steps farther for queries of low confidence, and ranks the larger set."""
    edges, similarity = cut_lineage(edges, "graph"), cut_lineage(similarity, "similarity")
    found = beam_paths(edges, starts, similarity, max_steps, beam_width)
    low = confidence(found).where(F.col("confidence") < threshold).select("query_id")
    more = beam_paths(edges, starts.join(low, "query_id", "left_semi"), similarity, max_steps + 2, beam_width)
    both = found.join(low, "query_id", "left_anti").unionByName(more)  # the longer search contains the shorter one
    return ranked_paths(both, edges, similarity, limit)


def answers(ranked: DataFrame, top: int = 3) -> DataFrame:
    """The best paths of each query as text."""
    line = F.format_string("%s (%.3f)", F.array_join("path", " → "), F.col("final_score"))
    return ranked.where(F.col("rank") <= top).groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n").alias("answer"))
