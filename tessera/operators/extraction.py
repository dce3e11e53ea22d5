"""Triples from chunks: injectable extractors, mapping to documents, critic, refiner and validator."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions import triples as tf
from tessera.session import cut_lineage

from .phrases import first_holders

TRIPLE = "doc_id long, triple_idx int, s string, r string, o string"
Extractor = Callable[[str], list[tuple[str, str, str]]]


def plain_extractor(text: str) -> list[tuple[str, str, str]]:
    """A deterministic stand-in for a model: three words in a row."""
    words = text.split()
    return [tuple(words[i : i + 3]) for i in range(0, len(words) - 2, 3)]


def extract_triples(chunks: DataFrame, extractor: Extractor = plain_extractor, most: int = 15) -> DataFrame:
    """Up to ``most`` triples of each (doc_id, chunk); a failing call gives none. The model is called in Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, chunk in zip(batch["doc_id"], batch["chunk"], strict=True):
                try:
                    found = extractor(chunk or "")[:most]
                except Exception:  # as a call of a model that fails
                    found = []
                rows += [(doc_id, i, *t) for i, t in enumerate(found)]
            yield pd.DataFrame(rows, columns=["doc_id", "triple_idx", "s", "r", "o"])

    return chunks.select("doc_id", "chunk").mapInPandas(run, TRIPLE)


def filtered(triples: DataFrame, threshold: float = 0.3, mode: str = "penalty") -> DataFrame:
    score = {"penalty": tf.quality_penalty, "weighted": tf.quality_weighted}[mode](F.col("s"), F.col("r"), F.col("o"))
    return triples.withColumn("quality", score).where(F.col("quality") >= threshold)


def to_documents(triples: DataFrame, docs: DataFrame) -> DataFrame:
    """Each triple with the first document that holds its subject or object in any case, or else the first document."""
    low = docs.select("doc_id", F.lower("text").alias("text"))
    first = docs.agg(F.min("doc_id").alias("doc_id")).first().doc_id
    at = first_holders(low, triples.select(F.explode(F.array(F.lower("s"), F.lower("o"))).alias("phrase")))
    out = triples.drop("doc_id")
    for side in ("s", "o"):
        out = out.join(at.select(F.col("phrase").alias(f"_{side}"), F.col("doc_id").alias(f"at_{side}")), F.lower(side) == F.col(f"_{side}"), "left").drop(f"_{side}")
    return out.withColumn("doc_id", F.coalesce(F.least("at_s", "at_o"), F.lit(first))).drop("at_s", "at_o")


def alignments(triples: DataFrame, texts: DataFrame) -> DataFrame:
    """The triples whose document has a text, with how well it supports them (see ``context_alignment``).

    A text is lower-cased once and goes to its triples' task once; there each
    different word is looked for once. A row of a document is a text or a triple, the texts first."""
    low = lambda c: F.lower(F.col(c))
    phrase = F.replace(low("r"), F.lit("_"), F.lit(" "))
    rows = triples.select("doc_id", F.struct(*triples.columns).alias("t"), low("s").alias("s"), low("o").alias("o"), phrase.alias("r"), F.lit(None).cast("string").alias("text"), F.lit(1).alias("kind"))
    none = F.lit(None).cast("string")
    whole = texts.select("doc_id", F.lit(None).cast(rows.schema["t"].dataType).alias("t"), none.alias("s"), none.alias("o"), none.alias("r"), low("text").alias("text"), F.lit(0).alias("kind"))
    synonyms = {r: phrases for key, phrases in reversed(tf.SYNONYMS.items()) for r in (key, *phrases)}

    def score(at: Callable[[str | None], int | None], s: str | None, r: str | None, o: str | None) -> float:
        x, y = at(s), at(o)
        has_s, has_o = x is not None and x >= 0, y is not None and y >= 0
        held = lambda w: w is not None and (at(w) if at(w) is not None else -1) >= 0
        entities = 0.5 if has_s and has_o else 0.3 if has_s or has_o else 0.1
        relation = 0.3 if held(r) else 0.2 if any(map(held, synonyms.get(r, ()))) else 0.0
        apart = abs(y - x) if has_s and has_o else 100
        return min(entities + relation + (0.2 if apart < 50 else 0.1 if apart < 100 else 0.0), 1.0)

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, looked = None, []
        for batch in items:
            part, values = [], []
            ids, kinds, bodies = (batch.column(c).to_pylist() for c in ("doc_id", "kind", "text"))
            for i, words in enumerate(zip(*(batch.column(c).to_pylist() for c in "sro"), strict=True)):
                if ids[i] != doc:
                    doc, looked = ids[i], []
                if not kinds[i]:
                    body = bodies[i]
                    looked.append(cache(lambda w, body=body: None if w is None or body is None else body.find(w)))
                    continue
                for at in looked:
                    part.append(i)
                    values.append(score(at, *words))
            if part:
                yield pa.RecordBatch.from_arrays([batch.column("t").take(pa.array(part)), pa.array(values)], names=["t", "alignment"])

    tasks = max(triples.sparkSession.sparkContext.defaultParallelism, int(triples.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = rows.unionByName(whole).where("doc_id is not null").repartition(tasks, "doc_id").sortWithinPartitions("doc_id", "kind")
    return met.mapInArrow(run, T.StructType([rows.schema["t"], T.StructField("alignment", T.DoubleType())])).select("t.*", "alignment")


def valid_in_context(triples: DataFrame, texts: DataFrame, threshold: float = 0.3) -> DataFrame:
    """Triples that their document's text supports well enough."""
    return alignments(triples, texts).where(F.col("alignment") >= threshold)


def refinement_stats(refined: DataFrame) -> DataFrame:
    """What a refinement (see ``refined``) came to: mean confidence, low ones, attempts and how they ended."""
    one = lambda c: F.sum(c.cast("long"))
    return refined.agg(F.count("*").alias("triples"), F.avg("confidence").alias("mean_confidence"), one(F.col("attempted")).alias("attempted"), one(F.col("succeeded")).alias("succeeded"), one(F.col("attempted") & ~F.col("succeeded")).alias("failed"), F.sum("tokens").alias("tokens"))


def refined(triples: DataFrame, texts: DataFrame, refiner: Callable[[str, str, str, str], str], threshold: float = 0.7, token_budget: int = 100_000) -> DataFrame:
    """Triples of low confidence are sent to a refiner while the budget lasts; an answer is kept only if it scores higher.

    The budget is spent in order of the triples within each document, so that no total order over
    all is needed: the whole run spends at most the budget times the number of documents."""
    conf = lambda s, r, o: tf.critic_confidence(s, r, o, F.col("text"))
    known = triples.join(texts.select("doc_id", "text"), "doc_id").withColumn("confidence", conf(F.col("s"), F.col("r"), F.col("o")))
    order = Window.partitionBy("doc_id").orderBy("triple_idx").rowsBetween(Window.unboundedPreceding, -1)
    low = F.col("confidence") < threshold
    cost = F.when(low, F.floor(F.char_length("text") / 4)).otherwise(0)
    known = known.withColumn("ask", low & (F.coalesce(F.sum(cost).over(order), F.lit(0)) < token_budget))

    @F.pandas_udf("string")
    def call(s: pd.Series, r: pd.Series, o: pd.Series, text: pd.Series) -> pd.Series:
        return pd.Series([refiner(*x) for x in zip(s, r, o, text, strict=True)])

    asked = known.withColumn("new", F.when(F.col("ask"), tf.parse_refined(call("s", "r", "o", "text"))))
    new = F.col("new")
    asked = asked.withColumn("new_confidence", F.when(new.isNotNull(), conf(new["s"], new["r"], new["o"])))
    better = F.coalesce(F.col("new_confidence") > F.col("confidence"), F.lit(False))
    pick = lambda c: F.when(better, new[c]).otherwise(F.col(c)).alias(c)
    return asked.select("doc_id", "triple_idx", pick("s"), pick("r"), pick("o"), F.when(better, F.col("new_confidence")).otherwise(F.col("confidence")).alias("confidence"), F.col("ask").alias("attempted"), better.alias("succeeded"), F.when(F.col("ask"), cost).otherwise(0).alias("tokens"))


def consistent(triples: DataFrame) -> DataFrame:
    """Drops loops and repeats, then triples that contradict an earlier kept one between the same two entities.

    A relation contradicts one other at most, so of the two the one that comes first between two
    entities stays: a minimum, which is aggregated before a shuffle. Of equal numbers the
    one of the smaller document comes first."""
    low = lambda c: F.lower(F.col(c))
    side = {r: i for i, pair in enumerate(tf.CONTRADICTIONS) for r in pair}
    number = F.element_at(F.create_map(*[F.lit(x) for item in side.items() for x in item]), F.col("_r"))
    keyed = triples.where(low("s") != low("o")).withColumns({"_s": low("s"), "_o": low("o"), "_r": F.translate(low("r"), "_-", "  ")})
    keyed = keyed.withColumns({"_a": F.least("_s", "_o"), "_b": F.greatest("_s", "_o"), "_pair": number})
    keyed = cut_lineage(keyed, "keyed-triples")
    first = keyed.groupBy("_s", "_r", "_o").agg(F.min("triple_idx").alias("_i"))
    once = keyed.join(first, ["_s", "_r", "_o"]).where(F.col("triple_idx") == F.col("_i"))
    named = keyed.where("_pair is not null").groupBy("_a", "_b", "_pair").agg(F.min_by("_r", F.struct("triple_idx", "doc_id", "_r")).alias("_kept"), F.count_distinct("_r").alias("_n"))
    lost = named.where("_n > 1").select("_a", "_b", F.explode(F.array(*[F.lit(r) for r in side])).alias("_r"), "_pair", "_kept")
    lost = lost.where((number == F.col("_pair")) & (F.col("_r") != F.col("_kept"))).select("_a", "_b", "_r")
    return once.join(lost, ["_a", "_b", "_r"], "left_anti").select(*triples.columns)
