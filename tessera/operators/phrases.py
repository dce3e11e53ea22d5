"""Phrases in texts by equi-joins: which documents hold a phrase as a part of their text.

A text that holds a phrase has its inner words, those with blanks on both sides, one
after the other. So phrases of three words or more are looked up by a shingle of
inner words, and shorter ones by the words of the vocabulary that contain their
longest word. Ids alone are joined; texts are looked at once, to verify what was
found. No text meets a phrase with which it shares no word.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut_lineage

SHINGLE, GRAM = 8, 3


def _words(x: Column) -> Column:
    return F.filter(F.split(x, "\\s+"), lambda w: w != "")


def _grams(x: Column, n: int) -> Column:
    """Distinct stretches of n characters."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.char_length(x) - n + 1))
    return F.array_distinct(F.transform(starts, lambda i: F.substr(x, i, F.lit(n))))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word and doc_id, once for each document that has the word."""
    return docs.select("doc_id", F.explode(F.array_distinct(_words(F.col("text")))).alias("word"))


def words_with(vocabulary: DataFrame, parts: DataFrame) -> DataFrame:
    """part and word of the vocabulary's distinct words that contain a part, by the part's rarest three characters."""
    grams = cut_lineage(vocabulary.select("word").distinct().withColumn("gram", F.explode(F.array_union(_grams(F.col("word"), GRAM), F.array_union(_grams(F.col("word"), 2), _grams(F.col("word"), 1))))), "grams")
    counts = grams.groupBy("gram").agg(F.count("*").alias("n"))
    size = lambda n: F.when(F.char_length("part") >= n, n)
    own = parts.select("part").distinct().withColumn("size", F.coalesce(size(GRAM), size(2), F.lit(1)))
    own = own.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("part") - F.col("size") + 1), lambda i: F.substr("part", i, F.col("size")))))
    rarest = own.join(counts, "gram").groupBy("part").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return rarest.select("part", "gram").join(grams, "gram").where(F.contains("word", F.col("part"))).select("part", "word")


def _parts(phrases: DataFrame) -> DataFrame:
    words = _words(F.col("phrase"))
    longest = F.array_max(F.transform(words, lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w"))))["w"]
    inner = F.when(F.size(words) > 2, F.slice(words, 2, F.least(F.size(words) - 2, F.lit(SHINGLE))))
    return phrases.select("phrase").distinct().where("phrase <> ''").select("phrase", longest.alias("part"), inner.alias("inner"), F.size(words).alias("words"))


def holders(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase and doc_id of every document (doc_id, text) whose text contains the phrase. Phrases of blanks alone are left out."""
    docs = docs.select("doc_id", "text").where("text is not null")
    parts = cut_lineage(_parts(phrases).where("words > 0"), "phrases")
    sizes = [r.n for r in parts.where("inner is not null").select(F.size("inner").alias("n")).distinct().collect()]  # at most SHINGLE numbers
    found = docs.limit(0).select(F.lit("").alias("phrase"), "doc_id")
    if sizes:
        words = docs.select("doc_id", _words(F.col("text")).alias("w"))
        each = words.select("doc_id", "w", F.explode(F.array(*map(F.lit, sizes))).alias("n")).where(F.size("w") >= F.col("n"))
        shingle = lambda w: F.xxhash64(F.array_join(w, " "))
        keys = each.select("doc_id", "n", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("w") - F.col("n") + 1), lambda i: shingle(F.slice("w", i, F.col("n")))))).alias("key"))
        found = found.union(parts.where("inner is not null").select("phrase", F.size("inner").alias("n"), shingle(F.col("inner")).alias("key")).join(keys, ["n", "key"]).select("phrase", "doc_id"))
    short = parts.where("inner is null")
    if not short.isEmpty():
        known = cut_lineage(vocabulary(docs), "vocabulary")
        met = words_with(known, short).join(short.select("phrase", "part"), "part").join(known, "word")
        found = found.union(met.select("phrase", "doc_id"))
    return found.distinct().join(docs, "doc_id").where(F.contains("text", F.col("phrase"))).select("phrase", "doc_id")


#: Tokens, grams or pairs that a worker holds before it sends them on.
HELD = 1 << 17
_SPACE = re.compile(rb"[\t-\r]")


def _tokens(text: bytes, longest: int) -> Iterator[bytes]:
    """The words of a text, and its stretches without a blank that hold other white space; long ones as windows that overlap by the longest phrase."""
    found = set(text.split())
    end = -1
    for m in _SPACE.finditer(text):
        if m.start() > end:
            begin, end = text.rfind(b" ", 0, m.start()) + 1, text.find(b" ", m.start())
            end = len(text) if end < 0 else end
            found.add(text[begin:end])
    for x in found:
        if len(x) <= max(4 * longest, 256):
            yield x
        else:
            whole, width = x.decode("utf-8", "surrogatepass"), max(2 * longest, 128)
            for i in range(0, max(1, len(whole) - longest + 1), width - longest + 1):
                yield whole[i : i + width].encode("utf-8", "surrogatepass")


def _firsts(rows: DataFrame, column: str, each: Callable[[bytes], Iterable[bytes]], name: str) -> DataFrame:
    """What ``each`` finds in the strings of a column, with the smallest doc_id; minima are taken in the workers first."""
    kind = dict(rows.dtypes)["doc_id"]

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: dict[bytes, object] = {}

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(first), pa.binary()).cast(pa.string()), pa.array(list(first.values()), ids)], names=[name, "doc_id"])

        for batch in items:
            ids = batch.column("doc_id").type
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), batch.column(column).cast(pa.binary()).to_pylist(), strict=True):
                for x in each(value):
                    if x not in first or doc_id < first[x]:
                        first[x] = doc_id
                if len(first) >= HELD:
                    yield sent()
                    first.clear()
        if first:
            yield sent()

    return rows.select("doc_id", column).mapInArrow(run, f"{name} string, doc_id {kind}").groupBy(name).agg(F.min("doc_id").alias("doc_id"))


def _short_grams(token: bytes) -> set[bytes]:
    x = token.decode("utf-8", "surrogatepass")
    return {x[i : i + n].encode("utf-8", "surrogatepass") for n in (1, 2) for i in range(len(x) - n + 1)}


def _token_grams(tokens: DataFrame) -> DataFrame:
    """Tokens with their distinct stretches of ``GRAM`` characters."""
    kind = dict(tokens.dtypes)["doc_id"]

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in items:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                grams = [list({x[i : i + GRAM] for i in range(len(x) - GRAM + 1)}) for x in batch.column("token").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("token"), batch.column("doc_id"), pa.array(grams, pa.list_(pa.string()))], names=["token", "doc_id", "grams"])

    return tokens.select("token", "doc_id").mapInArrow(run, f"token string, doc_id {kind}, grams array<string>").select("token", "doc_id", F.explode("grams").alias("gram"))


def first_holders(docs: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrase and the smallest doc_id that holds it.

    A phrase without a blank lies within a token of a text (see ``_tokens``), and a token's first
    document is enough, however common it is; so each text is read once, and what is
    looked through afterwards are the distinct tokens. Phrases of one or two characters are grams
    themselves; longer ones are looked up by their rarest gram. Phrases with blanks go by ``holders``."""
    docs = docs.select("doc_id", "text").where("text is not null")
    asked = phrases.select("phrase").where("phrase <> ''").distinct()
    plain = cut_lineage(asked.where(~F.contains("phrase", F.lit(" "))).withColumn("n", F.char_length("phrase")), "plain-phrases")
    several = holders(docs, asked.where(F.contains("phrase", F.lit(" "))))
    longest = plain.agg(F.max("n")).first()[0]
    if longest is None:
        return several.groupBy("phrase").agg(F.min("doc_id").alias("doc_id"))
    tokens = cut_lineage(_firsts(docs, "text", lambda text: _tokens(text, longest), "token"), "first-tokens")
    met = several
    if not plain.where(F.col("n") < GRAM).isEmpty():
        met = met.union(_firsts(tokens, "token", _short_grams, "phrase").join(plain.where(F.col("n") < GRAM).select("phrase"), "phrase").select("phrase", "doc_id"))
    own = plain.where(F.col("n") >= GRAM).select("phrase", F.explode(_grams(F.col("phrase"), GRAM)).alias("gram"))
    counts = _token_grams(tokens).join(own.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    rarest = own.join(counts, "gram", "left").groupBy("phrase").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("gram"))
    rarest = cut_lineage(rarest, "rarest-grams")
    long = _token_grams(tokens).join(rarest, "gram").where(F.contains("token", F.col("phrase"))).select("phrase", "doc_id")
    return met.union(long).groupBy("phrase").agg(F.min("doc_id").alias("doc_id"))
