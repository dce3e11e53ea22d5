"""Exact top-k by inner product: a ball tree for each shard, branch and bound.

Components are turned into integers, so scores are exact. Vectors are dealt by
row into shards of bounded size. A shard's ball tree is built once: its rows are
kept in the tree's order, and as every node halves its rows, the order is the tree.
Queries then stream past the shards in waves: first one shard each, then a few,
then the rest; the kth score that a query has so far goes with it into the next
wave. In a tree, nodes are visited by the upper bound of the inner product
(centre times query plus radius times the query's length, and a slack for what
floating point may lose); a node is left out for a query whose bound lies below its
kth score, and what a leaf gives raises the score for all later nodes. Bounds
equal to the kth score are still visited: ties go to the smaller id.

A task holds one shard at a time and queries in blocks.

Cases: null vectors, null ids and vectors with null or non-finite components
take no part; a query meets vectors of its own length only and never rows with
its own id; repeated rows are candidates each; of rows that repeat a query's id the
least vector asks; fewer than k candidates give fewer rows; empty vectors score
0; scores beyond 64 bits count as the largest or smallest such number; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.arrow import runs

from .shared import Scratch, trim

LEAF, BLOCK = 64, 4096
NONE = np.iinfo(np.int64).min
FOUND = "query_id long, vec_id long, score long"


def tree_order(rows: np.ndarray) -> np.ndarray:
    """The order of rows in which a node's first half is one child and its second half the other.

    A node is split by the direction of its two ends; halves keep the depth low, whatever the ties."""
    order = np.arange(len(rows))
    todo = [(0, len(rows))]
    while todo:
        low, high = todo.pop()
        if high - low > LEAF:
            part = rows[order[low:high]]
            first = part[((part - part.mean(0)) ** 2).sum(1).argmax()]
            second = part[((part - first) ** 2).sum(1).argmax()]
            order[low:high] = order[low:high][np.argsort(part @ (second - first), kind="stable")]
            half = (low + high) // 2
            todo += [(low, half), (half, high)]
    return order


class Shard:
    """Rows in a tree's order, and the ball of each node."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray) -> None:
        self.ids, self.rows, self.real = ids, rows, rows.astype(np.float64)
        self.most = float(np.abs(self.real).max(initial=0))
        self.balls: dict[tuple[int, int], tuple[np.ndarray, float, float]] = {}
        todo = [(0, len(rows))] if len(rows) else []
        while todo:
            low, high = todo.pop()
            part = self.real[low:high]
            centre = part.mean(0)
            self.balls[low, high] = centre, float(np.sqrt(((part - centre) ** 2).sum(1).max())), float(np.sqrt((centre**2).sum()))
            if high - low > LEAF:
                half = (low + high) // 2
                todo += [(low, half), (half, high)]

    def products(self, queries: np.ndarray, low: int, high: int) -> np.ndarray:
        """Inner products as 64-bit integers."""
        bound = max(self.most, float(np.abs(queries.astype(np.float64)).max(initial=0))) ** 2 * max(1, queries.shape[1])
        if bound < 2**52:  # then products in doubles are exact, and faster
            return (queries.astype(np.float64) @ self.real[low:high].T).astype(np.int64)
        if bound < 2**62:
            return queries @ self.rows[low:high].T
        whole = queries.astype(object) @ self.rows[low:high].astype(object).T
        return np.clip(whole, NONE + 1, np.iinfo(np.int64).max).astype(np.int64)

    def search(self, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of each query's best k rows, of those that reach its floor."""
        best, best_ids = np.full((len(queries), k), NONE), np.full((len(queries), k), NONE)
        if not len(self.rows) or not len(queries):
            return best, best_ids
        floors, asked = floors.copy(), queries.astype(np.float64)
        lengths = np.sqrt((asked**2).sum(1))

        def bound(node: tuple[int, int], of: np.ndarray) -> np.ndarray:
            centre, radius, far = self.balls[node]
            slack = 1e-13 * (len(centre) + 8) * lengths[of] * (radius + far)  # absolute, so that it widens negative bounds too
            return asked[of] @ centre + lengths[of] * radius + slack + 1e-6

        stack = [((0, len(self.rows)), np.arange(len(queries)))]
        while stack:
            (low, high), of = stack.pop()
            of = of[bound((low, high), of) >= floors[of]]
            if not len(of):
                continue
            if high - low > LEAF:
                half = (low + high) // 2
                near = sorted([(low, half), (half, high)], key=lambda child: bound(child, of).mean())
                stack += [(child, of) for child in near]  # the one with the higher bound is popped first
                continue
            ids = np.broadcast_to(self.ids[low:high], (len(of), high - low))
            scores = np.where(ids == query_ids[of][:, None], NONE, self.products(queries[of], low, high))
            scores, ids = np.concatenate([best[of], scores], 1), np.concatenate([best_ids[of], ids], 1)
            order = np.lexsort((ids, np.invert(scores)), axis=1)[:, :k]  # inverted bits sort downwards without overflow
            best[of], best_ids[of] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)
            floors[of] = np.maximum(floors[of], best[of][:, -1])
        return best, best_ids


def integers(column: str, scale: int = 256) -> Column:
    """floor(scale * x) of each component, null if any component is null or not finite."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
    values = F.transform(F.col(column), lambda x: x.cast("double"))
    return F.when(F.forall(values, finite), F.transform(values, lambda x: F.floor(F.lit(float(scale)) * x).cast("long")))


def _matrix(batch: pa.RecordBatch, size: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, size)


def _trees(held: DataFrame) -> DataFrame:
    """The rows of each shard and vector length in their tree's order."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if parts:
                rows = pa.Table.from_batches(parts).combine_chunks()
                order = tree_order(_matrix(rows.to_batches()[0], key[1]).astype(np.float64))
                yield from rows.take(pa.array(order)).append_column("at", pa.array(np.arange(len(order)))).to_batches(max_chunksize=4096)

        for own, part in runs(items, ["shard", "size"]):
            if own != key:
                yield from flush()
                key, parts = own, []
            parts.append(part)
        yield from flush()
        trim()

    return held.repartition("shard").sortWithinPartitions("shard", "size").mapInArrow(run, "shard int, size int, vec_id long, v array<long>, at long")


def _answers(trees: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """What each query (shard, size, vec_id, v, floor) finds in its shard."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, rows, shard = None, [], [], None
        for (number, size, is_query), part in runs(items, ["shard", "size", "asks"]):
            if (number, size) != key:
                key, ids, rows, shard = (number, size), [], [], None
            if not is_query:
                ids.append(part.column("vec_id").to_numpy())
                rows.append(_matrix(part, size))
                continue
            if shard is None:
                shard = Shard(np.concatenate(ids or [np.zeros(0, np.int64)]), np.concatenate(rows or [np.zeros((0, size), np.int64)]))
                ids, rows = [], []
            for at in range(0, part.num_rows, BLOCK):
                block = part.slice(at, BLOCK)
                own = block.column("vec_id").to_numpy()
                best, best_ids = shard.search(_matrix(block, size), own, block.column("at").to_numpy(), k)
                found = best != NONE
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(own[:, None], best.shape)[found]), pa.array(best_ids[found]), pa.array(best[found])], names=["query_id", "vec_id", "score"])
        trim()

    columns = ["shard", "size", "vec_id", "v", "at"]
    both = trees.select(*columns, F.lit(0).alias("asks")).union(asked.select("shard", "size", "vec_id", "v", F.col("floor").alias("at"), F.lit(1).alias("asks")))
    return both.repartition("shard").sortWithinPartitions("shard", "size", "asks", "at").mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, least_shards: int = 64, shard_rows: int = 65_536) -> DataFrame:
    """query_id, rank, vec_id and score of each query's best k other rows.

    ``least_shards`` keeps small tables spread out; beyond that, shards hold about ``shard_rows`` vectors."""
    scratch = Scratch(vectors.sparkSession)
    held = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), integers("embedding").alias("v")).where("vec_id is not null and v is not null")
    held = scratch.keep(held.withColumn("row", F.monotonically_increasing_id()), "vectors")
    shards = max(least_shards, -(-held.count() // shard_rows))
    trees = scratch.keep(_trees(held.select(F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int").alias("shard"), F.size("v").alias("size"), "vec_id", "v")), "trees")
    asked = held.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("home", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    asked = scratch.keep(asked, "queries")
    scratch.drop("vectors")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best, done = None, 0
    for until in sorted({1, min(8, shards), shards}):
        if best is None:
            now = asked.withColumn("floor", F.lit(NONE + 1))
        else:
            kth = best.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("floor")).withColumnRenamed("query_id", "vec_id")
            now = asked.join(kth, "vec_id", "left").withColumn("floor", F.coalesce("floor", F.lit(NONE + 1)))
        steps = F.explode(F.sequence(F.lit(done), F.lit(until - 1)))
        now = now.select("vec_id", "v", "floor", F.size("v").alias("size"), "home", steps.alias("step")).withColumn("shard", ((F.col("home") + F.col("step")) % shards).cast("int"))
        found = _answers(trees, now, k)
        found = found if best is None else best.select("query_id", "vec_id", "score").union(found)
        best = scratch.keep(found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), f"best-{until}")
        done = until
    scratch.drop("trees", "queries")
    return best.select("query_id", "rank", "vec_id", "score")
