"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches.

Texts are folded first: lower case, characters of other scripts that look like
Latin letters, and digits or signs that stand for letters inside a word. The
lexicon holds whole words and word beginnings. Its weights are log-odds from
labelled documents; terms with too little evidence don't enter. A document's
weight is the sum over its distinct matched terms, so that a repeated word counts
once, without matches inside an exception phrase; a logistic curve turns the
weight, alone and by length, into a score.

Learning uses at most ``sample_docs`` labelled training rows, chosen by a hash
of the id: the bound of everything that reaches the driver. Scoring is one
pass without a shuffle over whole texts.

Cases: null and empty texts score like texts without a match; without labels
of both kinds a lexicon is empty and every score is the prior; a null doc_id
is scored and never held out or labelled; of repeated labels the highest
counts; repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import batches, doc_texts, slices, written

# Characters of other scripts and the Latin letters that they resemble.
LOOKALIKES = str.maketrans("аеорсухікмтнвѕјԁһɡαεοικνρτυχη", "aeopcyxikmthbsjdhgaeoiknptuxn")
INVISIBLE = re.compile("[­​-‏⁠﻿]")
FULLWIDTH = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)}
# Digits and signs that stand for letters.
LEET = str.maketrans("013457@$!|", "oieastasil")
LEET_RUN = re.compile(r"(?<![^\W_])[013457@$!|]+(?=[a-z])|(?<=[a-z])[013457@$!|]+(?=[a-z])")
UNUSUAL = re.compile("[^\x00-ɏ]|­")
NOT_LETTERS = re.compile(r"[\W\d_]+")
# Harmless phrases that hold words of insults.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "pond scum", "sore loser", "stupid simple")
BEGINNINGS = (4, 5, 6)


def folded(text: str) -> str:
    """The words of a text, folded, between single blanks."""
    text = text.lower()
    if UNUSUAL.search(text):
        text = INVISIBLE.sub("", text).translate(FULLWIDTH).translate(LOOKALIKES).lower()
    text = LEET_RUN.sub(lambda m: m[0].translate(LEET), text)
    return f" {NOT_LETTERS.sub(' ', text).strip()} "


def terms_of(text: str) -> set[str]:
    """Whole words as ' word ' and beginnings as ' wor'."""
    words = set(folded(text).split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in BEGINNINGS if len(w) > n}


@dataclass(frozen=True)
class Lexicon:
    """Weights of terms, and the logistic curve: of the ``features``."""

    weights: dict[str, float]
    curve: tuple[float, ...]
    exceptions: tuple[str, ...] = EXCEPTIONS

    def automaton(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for phrase in self.exceptions:
            found.add_word(folded(phrase), (folded(phrase), None))
        for term, weight in self.weights.items():
            found.add_word(term, (term, weight))
        if self.weights or self.exceptions:
            found.make_automaton()
        return found


def weigh(text: str, automaton: ahocorasick.Automaton) -> tuple[float, float, int]:
    """Summed and highest weight of the distinct terms that match, the heaviest at each word, and the number of words."""
    text = folded(text)
    hits: dict[int, tuple[float, str]] = {}
    safe: list[tuple[int, int]] = []
    if len(automaton):
        for end, (term, weight) in automaton.iter(text):
            start = end - len(term) + 1
            if weight is None:
                safe.append((start, end))
            elif start not in hits or weight > hits[start][0]:
                hits[start] = weight, term
    if safe:
        hits = {start: hit for start, hit in hits.items() if not any(a <= start < b for a, b in safe)}
    found = [weight for weight, _ in set(hits.values())]
    return sum(sorted(found)), max(found, default=0.0), text.count(" ") - 1


def features(total: float, most: float, words: int) -> tuple[float, float, float, float]:
    """Constant, strongest term, summed weight, and summed weight by length."""
    return 1.0, most, math.log1p(total), math.log1p(100 * total / (words + 50))


def held_out(doc_id: str = "doc_id") -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count_terms(rows: DataFrame, wanted: frozenset[str] | None) -> dict[str, int]:
    """Documents by term, of the wanted terms or of all that enough documents have."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[str] = Counter()
        for _, texts in batches(items):
            for text in texts:
                terms = terms_of(text)
                counts.update(terms if wanted is None else terms & wanted)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    found = rows.select("doc_id", "text").mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return {r.term: r.n for r in found.where(F.col("n") >= (MIN_DOCS if wanted is None else 1)).collect()}


#: Toxic documents that must have a term, and the least log-odds in standard errors.
MIN_DOCS, MIN_Z = 3, 2.5
#: Weights of terms that few toxic documents have are drawn to 0: halved at so many documents.
SHRINK = 8


def fit(docs: DataFrame, labels: DataFrame, sample_docs: int = 20_000) -> Lexicon:
    """Learns from training rows, those that aren't held out, of the labels' hashed sample."""
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    chosen = chosen.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs)
    sample = written(doc_texts(docs).join(F.broadcast(chosen), "doc_id"), "toxicity-sample")  # at most sample_docs ids are sent
    counts = {r.toxic: r["count"] for r in sample.groupBy("toxic").count().collect()}
    toxic, clean = counts.get(1, 0), counts.get(0, 0)
    if not toxic or not clean:
        return Lexicon({}, (math.log((toxic + 0.5) / (clean + 0.5)), 0.0, 0.0, 0.0))
    in_toxic = _count_terms(sample.where("toxic = 1"), None)
    in_clean = _count_terms(sample.where("toxic = 0"), frozenset(in_toxic))
    weights = {}
    for term, a in in_toxic.items():
        b = in_clean.get(term, 0)
        odds = math.log((a + 0.5) / (toxic - a + 0.5)) - math.log((b + 0.5) / (clean - b + 0.5))
        if odds / math.sqrt(1 / (a + 0.5) + 1 / (b + 0.5)) >= MIN_Z and odds > 2:
            weights[term] = odds * a / (a + SHRINK)
    lexicon = Lexicon(weights, (0.0,) * 4)

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in slices(items):
            found = [weigh(text, automaton) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([x[0] for x in found], pa.float64()), pa.array([x[1] for x in found], pa.float64()), pa.array([x[2] for x in found], pa.int64())], names=["toxic", "total", "most", "words"])

    rows = sample.select("toxic", "text").mapInArrow(run, "toxic int, total double, most double, words long").collect()
    x, y = np.array([features(r.total, r.most, r.words) for r in rows]), np.array([r.toxic for r in rows], float)
    return Lexicon(weights, tuple(_logistic(x, y).tolist()))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small penalty, so that separable labels stay finite."""
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def score_documents(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, curve = lexicon.automaton(), np.array(lexicon.curve)
        for keys, texts in batches(items):
            x = np.array([features(*weigh(text, automaton)) for text in texts])
            scores = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = doc_texts(docs).mapInArrow(run, "doc_id long, score double, predicted int")
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def keep_clean(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7) -> DataFrame:
    """The documents below the threshold, as they are."""
    schema: T.StructType = docs.schema
    place = schema.fieldNames().index("text")

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, curve = lexicon.automaton(), np.array(lexicon.curve)
        for batch in slices(items, place):
            x = np.array([features(*weigh(text or "", automaton)) for text in batch.column(place).to_pylist()])
            yield batch.filter(pa.array(1 / (1 + np.exp(-np.clip(x @ curve, -30, 30))) < threshold))

    return docs.mapInArrow(run, schema)
