"""Line dedup over levelled sorted runs of line hashes, in DataFrame operations only.

Documents come in batches of ascending id. The texts are read once: each line's
hash goes to a table, parted by batch, from which every batch reads its own part.
A batch's distinct hashes, each with its first document, are merge-anti-joined with
the runs; the new ones are a run of their own. When ``fan`` runs of a level have
gathered, they are merged into one of the next level. As batches ascend, a line's
first document over all is the one in the runs or, failing that, the first of
the batch: every other document drops the line.

Runs are tables bucketed and sorted by hash, all with the same buckets, so neither
the anti-joins nor the merges (full outer merge joins of runs without common
hashes) shuffle or sort a run again. A hash is two 64-bit hashes of the key under
different seeds. Hashes are pre-aggregated before they are shuffled, and the joins
that bring decisions back are sort-merge joins of plain tables, which Spark
splits where a hash is hot. Dropped lines are marked by place, in linear time.

Cases: a null or empty text is one empty line; a null doc_id counts as larger
than all others; rows with one doc_id are one document to the runs and are
each returned; an empty table gives an empty result; extra columns are kept by
``deduplicate`` and ignored by ``line_decisions``.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import sized

from .shared import NULL_ID, release, remove, shared_path

LEAST_CHARS = 10
# The white space that keys are stripped of.
BLANKS = " \t\n\x0b\x0c\r"
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EACH = 1 << 20  # lines for each bucket
#: Lets a scan of one sorted file for each bucket count as sorted.
SORTED_SCANS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), CAPITALS, SMALL)


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Settings for the actions inside, and the former ones after them."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value is not None else spark.conf.unset(name)


class Runs:
    """Sorted runs by level, each a bucketed table in the shared folder."""

    def __init__(self, spark: SparkSession, fan: int) -> None:
        self.spark, self.fan, self.levels, self.paths = spark, fan, [[]], {}
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        self.paths[name] = shared_path(self.spark, "line-run")
        rows.write.format("parquet").option("path", self.paths[name]).bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        return name

    def _new_in(self, name: str) -> DataFrame:
        return self.spark.table(name).where("not seen").select("h1", "h2", "first")

    def add(self, first: DataFrame) -> str:
        """Writes a batch's distinct hashes (h1, h2, first, last), marked where a run has seen them, as a run; its path."""
        names = [name for level in self.levels for name in level]
        for i, name in enumerate(names):
            first = first.join(self._new_in(name).select("h1", "h2", F.lit(True).alias(f"in{i}")).hint("merge"), ["h1", "h2"], "left")
        seen = reduce(lambda a, b: a | b, [F.col(f"in{i}").isNotNull() for i in range(len(names))], F.lit(False))
        new = self._write(first.select("h1", "h2", "first", "last", seen.alias("seen")))
        self.levels[0].append(new)
        return self.paths[new]

    def compact(self) -> None:
        """Merges the runs of each level that has ``fan`` of them."""
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fan:
            old, self.levels[level] = self.levels[level], []
            if level + 1 == len(self.levels):
                self.levels.append([])
            merged = reduce(lambda a, b: a.join(b.hint("merge"), ["h1", "h2"], "full").select("h1", "h2", F.coalesce(a["first"], b["first"]).alias("first")), map(self._new_in, old))
            self.levels[level + 1].append(self._write(merged.select("h1", "h2", "first", F.col("first").alias("last"), F.lit(False).alias("seen"))))
            for name in old:
                self._remove(name)
            level += 1

    def _remove(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE {name}")
        remove(self.spark, self.paths.pop(name))

    def close(self) -> None:
        for name in [*self.paths]:
            self._remove(name)


def _decided(docs: DataFrame, batches: int, fan: int, least_chars: int) -> DataFrame:
    """The documents with ``_drops``, the sorted places of the lines to drop, or null."""
    spark = docs.sparkSession
    docs = docs.withColumn("_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("_sig", F.xxhash64(F.coalesce("text", F.lit(""))))
    marks = docs.agg(F.percentile_approx("_id", [i / batches for i in range(1, batches)], 1000).alias("m")).first().m or []
    marks = sorted(set(marks))
    batch = reduce(lambda a, b: a + b, [(F.col("_id") > m).cast("int") for m in marks], F.lit(0))
    lines = docs.select("_id", "_sig", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("place", "line"))
    keyed = lines.select("_id", "_sig", "place", line_key(F.col("line")).alias("key")).where(F.char_length("key") >= least_chars)
    hashed = keyed.select(batch.alias("batch"), "_id", "_sig", "place", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"))
    path, rows = shared_path(spark, "lines"), docs.count()
    sized(hashed, rows, 1 << 13).write.partitionBy("batch").parquet(path)
    held_all = spark.read.schema("_id long, _sig long, place int, h1 long, h2 long, batch int").parquet(path)
    buckets = max(spark.sparkContext.defaultParallelism, -(-held_all.count() // EACH))
    decided = shared_path(spark, "line-drops")
    with _settings(spark, {SORTED_SCANS: "true", "spark.sql.shuffle.partitions": str(buckets)}):
        runs = Runs(spark, fan)
        for number in range(len(marks) + 1):
            held = held_all.where(F.col("batch") == number).drop("batch")
            first = held.groupBy("h1", "h2").agg(F.min("_id").alias("first"), F.max("_id").alias("last"))
            run = spark.read.schema("h1 long, h2 long, first long, last long, seen boolean").parquet(runs.add(first))
            repeated = run.where("seen or first < last").select("h1", "h2", F.when(~F.col("seen"), F.col("first")).alias("owner"))
            drops = held.join(repeated.hint("merge"), ["h1", "h2"]).where("owner is null or owner <> _id")
            drops = drops.groupBy("_id", "_sig").agg(F.sort_array(F.collect_set("place")).alias("_drops"))
            sized(drops, rows, 1 << 15).write.mode("append").parquet(decided)
            if number < len(marks):
                runs.compact()
            release(spark)
        runs.close()
    remove(spark, path)
    drops = spark.read.schema("_id long, _sig long, _drops array<int>").parquet(decided)
    return docs.join(drops, ["_id", "_sig"], "left")


def _kept() -> Column:
    """The lines that stay. Which ones go is spelt out as an array of truth values, one gap between two places after the other."""
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    falses = lambda n: F.array_repeat(F.lit(False), n)
    before = lambda i: F.coalesce(F.get("_drops", i - 1), F.lit(-1))
    gaps = F.flatten(F.transform("_drops", lambda at, i: F.concat(falses(at - before(i) - 1), F.array(F.lit(True)))))
    marked = F.arrays_zip(lines.alias("line"), F.concat(gaps, falses(F.size(lines) - 1 - F.element_at("_drops", -1))).alias("drop"))
    stay = F.array_join(F.transform(F.filter(marked, lambda x: ~x["drop"]), lambda x: x["line"]), "\n")
    return F.when(F.col("_drops").isNull(), F.coalesce("text", F.lit(""))).otherwise(stay)


def deduplicate(docs: DataFrame, batches: int = 4, fan: int = 2, least_chars: int = LEAST_CHARS) -> DataFrame:
    """The documents, repeated lines taken out of their texts. Other columns stay, whatever their names; n_chars, if there, is counted anew; null texts stay null."""
    others = [c for c in docs.columns if c != "text"]
    held = docs.select("doc_id", "text", F.struct(*others).alias("row"))
    out = _decided(held, batches, fan, least_chars).select("row", F.when(F.col("text").isNotNull(), _kept()).alias("text"))
    count = F.char_length("text").cast(docs.schema["n_chars"].dataType) if "n_chars" in others else None
    return out.select(*[F.col("text") if c == "text" else count.alias(c) if c == "n_chars" else F.col("row").getField(c).alias(c) for c in docs.columns])


def line_decisions(docs: DataFrame, batches: int = 4, fan: int = 2) -> DataFrame:
    """Per document the lines, those dropped, and a digest of the rest."""
    out = _decided(docs.select("doc_id", "text"), batches, fan, LEAST_CHARS)
    lines = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1))
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), lines.cast("long").alias("n_lines"), F.coalesce(F.size("_drops"), F.lit(0)).cast("long").alias("n_dropped"), F.sha2(_kept().cast("binary"), 256).alias("kept_sha256"))


LINE_SQL = """
WITH docs AS (
  SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT row_id, doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM docs
), keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), firsts AS (
  SELECT key, min(doc_id) AS first FROM keyed WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1
), marked AS (
  SELECT k.*, (f.first IS NOT NULL AND k.doc_id <> f.first) AS dropped FROM keyed k LEFT JOIN firsts f USING (key)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(CAST(dropped AS INT)) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY row_id
"""
