"""Entity linking: clusters of names, canonical names, merged edges, renamed triples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as v
from tessera.functions.arrow import matrix, runs
from tessera.session import cut_lineage

from .components import connected_components
from .phrases import holders


def string_clusters(entities: DataFrame) -> DataFrame:
    """entity and cluster key of names that differ in case, hyphens, underscores and blanks alone."""
    named = entities.select("entity").distinct().withColumn("cluster", F.translate(F.lower("entity"), "-_ ", ""))
    large = named.groupBy("cluster").agg(F.count("*").alias("n")).where("n > 1")
    return named.join(large.select("cluster"), "cluster", "left_semi")


def _unit(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return matrix(batch.column("emb"), dims).astype(np.float64) / batch.column("size").to_numpy()[:, None]


def _celled(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """Vectors with the cell of their nearest centre and the angle to it."""
    kinds = dict(vectors.dtypes)

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in items:
            if batch.num_rows:
                near = _unit(batch, centres.shape[1]) @ centres.T
                cell = near.argmax(1)
                angle = np.arccos(np.clip(near[np.arange(len(cell)), cell], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("emb"), batch.column("size"), pa.array(cell.astype(np.int32)), pa.array(angle)], names=["id", "emb", "size", "cell", "angle"])

    return vectors.select("id", "emb", "size").mapInArrow(run, f"id {kinds['id']}, emb {kinds['emb']}, size double, cell int, angle double")


#: Vectors in a cell on average, and the number of cells that small tables have at most, for where angles are wide each cell costs a copy of half of all vectors; copies that leave a worker at once; visitors that are multiplied at once, in numbers of their matrix.
CELL_ROWS, FEW_CELLS, COPIES, SCORES = 2048, 16, 4096, 1 << 21


def similar_pairs(vectors: DataFrame, threshold: float, block_rows: int = 65_536, cells: int = 256) -> DataFrame:
    """All pairs of vectors at a cosine of the threshold or more, exactly.

    Vectors live in the cell of their nearest centre, one of at most ``cells`` vectors drawn by a
    hash. A vector visits another cell only if the angle to its centre, less the cell's widest
    angle, allows the threshold; so a vector is copied to the cells that it may match and not
    to all. A cell of more than ``block_rows`` residents is split into blocks, of which a
    resident visits the later ones. A task holds one block's residents, and visitors stream
    past them. Vectors are sent as they came, with their length. Only pairs that pass leave the task."""
    sized = vectors.select("id", "emb", v.norm(F.col("emb")).alias("size")).where("size > 1e-9 and size < double('infinity')")
    sized = cut_lineage(sized, "vectors")
    kinds, dims = dict(sized.dtypes), sized.agg(F.max(F.size("emb"))).first()[0]
    if dims is None:
        return sized.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit(0.0).alias("similarity")).limit(0)
    rows = sized.count()
    drawn = sized.orderBy(F.xxhash64("id"), "id").limit(min(cells, max(-(-rows // block_rows), min(FEW_CELLS, -(-rows // CELL_ROWS))))).select("emb", "size").collect()  # at most ``cells`` rows
    centres = np.array([r.emb for r in drawn], np.float64) / np.array([[r.size] for r in drawn])
    held = cut_lineage(_celled(sized, centres), "celled")
    stats = {r.cell: r for r in held.groupBy("cell").agg(F.max("angle").alias("wide"), F.count("*").alias("n")).collect()}
    wide = np.array([stats[c].wide if c in stats else -10.0 for c in range(len(centres))])
    blocks = np.array([-(-stats[c].n // block_rows) if c in stats else 0 for c in range(len(centres))])
    reach = np.arccos(np.clip(threshold, -1, 1)) + 1e-6

    def dealt(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in items:
            for start in range(0, whole.num_rows, 1024):
                batch = whole.slice(start, 1024)
                cell = batch.column("cell").to_numpy()
                angles = np.arccos(np.clip(_unit(batch, dims) @ centres.T, -1, 1))
                visits = (angles - wide <= reach) & (np.arange(len(centres)) > cell[:, None])  # a pair of cells meets in the later one
                salt = batch.column("salt").to_numpy() % blocks[cell]
                visits[np.arange(len(cell)), cell] = True
                row, to = np.nonzero(visits)
                many = blocks[to]
                row, to = np.repeat(row, many), np.repeat(to, many)
                block = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                home = to == cell[row]
                guest = ~(home & (block == salt[row]))
                sent = ~home | (block >= salt[row])  # a pair of blocks meets in the later one
                row, to, block, guest = row[sent], to[sent], block[sent], guest[sent]
                for at in range(0, len(row), COPIES):
                    part = slice(at, at + COPIES)
                    own = batch.select(["id", "emb", "size"]).take(pa.array(row[part]))
                    yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array(x[part].astype(np.int32)) for x in (to, block, guest))], names=["id", "emb", "size", "cell", "block", "guest"])

    def multiply(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, held_rows = None, [], []
        for (cell, block, guest), part in runs(items, ["cell", "block", "guest"]):
            if (cell, block) != key:
                key, ids, held_rows = (cell, block), [], []
            first = sum(map(len, ids))
            if not guest:
                ids.append(part.column("id"))
                held_rows.append(_unit(part, dims))
            elif len(held_rows) > 1:
                held_rows, ids = [np.concatenate(held_rows)], [pa.concat_arrays(ids)]
            many = max(1, SCORES // max(1, sum(map(len, ids))))
            for at in range(0, part.num_rows, many):
                some = part.slice(at, many)
                unit = _unit(some, dims)
                before = 0
                for known, those in zip(held_rows, ids, strict=True):
                    scores = unit @ known.T
                    x, y = np.nonzero(scores >= threshold)
                    if not guest:  # residents meet the earlier ones
                        earlier = before + y < first + at + x
                        x, y = x[earlier], y[earlier]
                    before += len(those)
                    a, b = some.column("id").take(pa.array(x)), those.take(pa.array(y))
                    keep, swap = pc.not_equal(a, b), pc.greater(a, b)
                    found = [pc.if_else(swap, b, a).filter(keep), pc.if_else(swap, a, b).filter(keep), pa.array(scores[x, y]).filter(keep)]
                    for i in range(0, len(found[0]), 1 << 16):
                        yield pa.RecordBatch.from_arrays([z.slice(i, 1 << 16) for z in found], names=["a", "b", "similarity"])

    given = held.withColumn("salt", F.xxhash64("id").bitwiseAND(F.lit((1 << 31) - 1)))
    sent = given.mapInArrow(dealt, f"id {kinds['id']}, emb {kinds['emb']}, size double, cell int, block int, guest int")
    tasks = max(int(blocks.sum()), vectors.sparkSession.sparkContext.defaultParallelism)
    return sent.repartition(min(tasks, 2048), "cell", "block").sortWithinPartitions("cell", "block", "guest").mapInArrow(multiply, f"a {kinds['id']}, b {kinds['id']}, similarity double")


def embedding_clusters(vectors: DataFrame, threshold: float = 0.88) -> DataFrame:
    """id and component of vectors that a chain of similar ones connects."""
    return connected_components(similar_pairs(vectors, threshold)).withColumnRenamed("node", "id")


def canonical_names(clusters: DataFrame, degrees: DataFrame) -> DataFrame:
    """old and canonical name: most edges and characters, then the first name. Aggregated, never collected: a large cluster costs a row a task."""
    scored = clusters.join(degrees.withColumnRenamed("node", "entity"), "entity", "left").withColumn("score", F.coalesce("degree", F.lit(0)) * 10 + F.char_length("entity"))
    best = scored.groupBy("cluster").agg(F.max("score").alias("score")).join(scored.select("cluster", "score", "entity"), ["cluster", "score"]).groupBy("cluster").agg(F.min("entity").alias("canonical"))
    return clusters.join(best, "cluster").select(F.col("entity").alias("old"), "canonical")


def canonical_by_documents(groups: DataFrame, docs: DataFrame) -> DataFrame:
    """old and canonical name of the groups (entity, leader): the name that most documents hold in any case, then the shortest, then the first."""
    low = docs.select("doc_id", F.lower("text").alias("text"))
    known = holders(low, groups.select(F.lower("entity").alias("phrase"))).groupBy("phrase").agg(F.count("*").alias("docs"))
    scored = groups.join(known, F.lower("entity") == F.col("phrase"), "left").withColumn("docs", F.coalesce("docs", F.lit(0)))
    best = scored.groupBy("leader").agg(F.min_by("entity", F.struct(-F.col("docs"), F.char_length("entity"), F.col("entity"))).alias("canonical"))
    return groups.join(best, "leader").select(F.col("entity").alias("old"), "canonical")


def linking_summary(names: DataFrame, examples: int = 10) -> DataFrame:
    """How many entities came to how many names, and the first of these."""
    first = names.select("canonical").distinct().orderBy("canonical").limit(examples).agg(F.array_sort(F.collect_list("canonical")).alias("examples"))
    counts = names.agg(F.count("*").alias("entities"), F.count_distinct("canonical").alias("groups"), F.sum((F.col("old") != F.col("canonical")).cast("long")).alias("merged"))
    return counts.join(F.broadcast(first), F.lit(True))  # one row each


def profiles(contexts: DataFrame, most: int = 2) -> DataFrame:
    """entity and the text of its first contexts, for embedding. The number is the operator's own."""
    from pyspark.sql import Window

    order = Window.partitionBy("entity").orderBy("doc_id", "position")
    first = contexts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return first.groupBy("entity").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "context"))), lambda x: x["context"]), " ").alias("profile"))


def renamed_triples(triples: DataFrame, names: DataFrame) -> DataFrame:
    """Triples under canonical names, without those that became loops."""
    out = triples
    for side in ("s", "o"):
        out = out.join(names.select(F.col("old").alias(side), F.col("canonical").alias(f"{side}_new")), side, "left").withColumn(side, F.coalesce(f"{side}_new", side)).drop(f"{side}_new")
    return out.where("s <> o").select(*triples.columns)


def merged_edges(edges: DataFrame, names: DataFrame, order: str = "seq") -> DataFrame:
    """Edges under canonical names: weights summed, the first relation and all relations in order kept."""
    out = edges
    for side in ("src", "dst"):
        out = out.join(names.select(F.col("old").alias(side), F.col("canonical").alias(f"{side}_new")), side, "left").withColumn(side, F.coalesce(f"{side}_new", side)).drop(f"{side}_new")
    out = out.where("src <> dst").withColumns({"src": F.least("src", "dst"), "dst": F.greatest("src", "dst")})
    kinds = out.groupBy("src", "dst", "relation").agg(F.min(order).alias(order), F.sum("weight").alias("weight"))
    lists = F.transform(F.array_sort(F.collect_list(F.struct(order, "relation"))), lambda x: x["relation"])  # distinct relations of one pair
    return kinds.groupBy("src", "dst").agg(F.sum("weight").alias("weight"), F.min_by("relation", order).alias("relation"), lists.alias("relation_types"))


def leaders(rows: Iterator[tuple[object, np.ndarray, str]], same: float, cross: float) -> list[tuple[object, object]]:
    """Each item and its leader: the first earlier leader that is similar enough, or itself."""
    heads: list[tuple[object, np.ndarray, str]] = []
    out = []
    for name, vector, language in rows:
        found = next((h for h in heads if float(h[1] @ vector) >= (same if h[2] == language else cross)), None)
        if found is None:
            heads.append((name, vector, language))
        out.append((name, found[0] if found else name))
    return out


def multilingual_leaders(entities: DataFrame, same: float = 0.90, cross: float = 0.85) -> DataFrame:
    """entity and leader among (entity, seq, emb, language): greedy, in order of seq, not transitive.

    Leaders are chosen within the connected components of pairs that reach the lower
    threshold: items of different components never meet, so the result is that of one
    pass over all, and a task holds one component."""
    keyed = entities.select(F.col("seq").alias("id"), "emb")
    parts = connected_components(similar_pairs(keyed, min(same, cross)))
    grouped = entities.join(parts, entities["seq"] == parts["node"], "left").withColumn("component", F.coalesce("component", "seq"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        found = leaders(((n, np.asarray(e, float), lang) for n, e, lang in zip(rows["entity"], rows["emb"], rows["language"], strict=True)), same, cross)
        return pd.DataFrame(found, columns=["entity", "leader"])

    return grouped.groupBy("component").applyInPandas(lambda rows: run(rows), "entity string, leader string")
