"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import dealt_anew, remove, shared_path, sized, written


def connected_components(links: DataFrame, a: str = "a", b: str = "b", most: int | None = None) -> DataFrame:
    """node and the smallest node of its component, for every node of a link; of ``most`` links, if that is known.

    A round halves the distance to the smallest node, so few are needed; they go on
    until one changes nothing. Only minima are gathered at a node, never its
    neighbours, and minima are dealt once more before they are joined, so that Spark
    can split a hot node's links. Each round's edges are written, so a lost executor
    costs one round; the round before is then removed."""
    spark = links.sparkSession
    path = shared_path(spark, "edges")
    first = links.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    edges = written(first if most is None else sized(first, most), path)
    rows, state = edges.count(), None
    while True:
        both = edges.union(edges.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).select(dealt_anew("u"), "m")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(dealt_anew("u"), "m")
        moved = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, path = path, shared_path(spark, "edges")
        edges = written(sized(moved.union(least.select("u", "m")).where("u <> v").distinct(), rows), path)  # a round makes no more links than there were
        remove(spark, before)
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == state:
            break
        rows, state = now.n, now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
