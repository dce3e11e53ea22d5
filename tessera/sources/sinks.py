"""Sinks: idempotent tables, reports, notes and graph exports.

A table is a folder of versions and a pointer, the name of the newest whole one. A
write adds a version and then moves the pointer in one rename, so readers always
find a whole table, no job overwrites what it reads, and running a write again
changes nothing. Pointers are numbered and the highest counts, so a crash between
two steps leaves the old table.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import sanitize_filename


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at, jvm.org.apache.hadoop.fs.Path


def path_exists(spark: SparkSession, path: str) -> bool:
    files, at, _ = _files(spark, path)
    return files.exists(at)


def _versions(spark: SparkSession, path: str) -> list[str]:
    """Names of the whole versions, oldest first."""
    files, at, _ = _files(spark, path)
    if not files.exists(at):
        return []
    names = [status.getPath().getName() for status in files.listStatus(at)]
    return sorted(n for n in names if n.startswith("v"))


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_versions(spark, path))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of a table."""
    return spark.read.parquet(f"{path}/{_versions(spark, path)[-1]}")


def _add_version(df: DataFrame, path: str) -> list[str]:
    """Writes a version beside the others; a rename makes it the newest. Names of all."""
    spark, new = df.sparkSession, f"{path}/_{uuid.uuid4().hex}"
    df.write.parquet(new)
    known = _versions(spark, path)
    name = f"v{int(known[-1][1:]) + 1 if known else 0:012d}"
    files, at, of = _files(spark, new)
    if files.exists(of(f"{path}/{name}")) or not files.rename(at, of(f"{path}/{name}")):
        raise RuntimeError(f"another writer took version {name} of {path}")
    return [*known, name]


def replace_table(df: DataFrame, path: str, keep: int = 2) -> None:
    """A new version of the whole table. The ``keep`` newest stay for those who read them."""
    files, _, of = _files(df.sparkSession, path)
    for name in _add_version(df, path)[:-keep]:
        files.delete(of(f"{path}/{name}"), True)


def read_all(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """All versions together, of a table to which rows are only added."""
    found = [f"{path}/{name}" for name in _versions(spark, path)]
    return spark.read.parquet(*found) if found else spark.createDataFrame([], like.schema)


def read_or_empty(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    return read_table(spark, path) if exists(spark, path) else spark.createDataFrame([], like.schema)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows in place of old ones with their key. Of new rows with one key the last in order of all columns stays."""
    values = [c for c in new.columns if c not in keys]
    last = new.groupBy(*keys).agg(F.max(F.struct(*values)).alias("_v")).select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def upsert_edges(spark: SparkSession, edges: DataFrame, path: str, cutoff: float = 0.035) -> DataFrame:
    """Edges above the cutoff into a table by (src, dst); returns what was written and skipped."""
    kept = edges.where(F.col("weight") > cutoff).select("src", "dst", "relation", "weight")
    replace_table(upserted(read_or_empty(spark, path, kept), kept, ["src", "dst"]), path)
    return edges.agg(F.sum((F.col("weight") > cutoff).cast("long")).alias("written"), F.sum((~(F.col("weight") > cutoff)).cast("long")).alias("skipped"))


def insert_if_absent(spark: SparkSession, rows: DataFrame, path: str, key: str) -> None:
    """Adds rows whose key the table doesn't hold, as a version that has these alone; ``read_all`` reads the table."""
    _add_version(rows.dropDuplicates([key]).join(read_all(spark, path, rows).select(key), key, "left_anti").select(*rows.columns), path)


def upsert_figures(spark: SparkSession, figures: DataFrame, links: DataFrame, chunks: DataFrame, path: str) -> None:
    """Figures by id into a table, and the links to chunks that exist into one beside it."""
    kept = links.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi").select("figure_id", "chunk_id").distinct()
    replace_table(upserted(read_or_empty(spark, f"{path}/figures", figures), figures, ["figure_id"]), f"{path}/figures")
    old = read_or_empty(spark, f"{path}/aligned_with", kept)
    replace_table(old.unionByName(kept).distinct(), f"{path}/aligned_with")


def with_provenance(edges: DataFrame, title: str) -> DataFrame:
    """Edges without a source get the document's title, those without a section 'unknown', those without a confidence 1."""
    have = lambda c, kind: F.col(c) if c in edges.columns else F.lit(None).cast(kind)
    return edges.withColumns({"source_paper": F.coalesce(have("source_paper", "string"), F.lit(title)), "section": F.coalesce(have("section", "string"), F.lit("unknown")), "confidence": F.coalesce(have("confidence", "double"), F.lit(1.0))})


def upsert_files(spark: SparkSession, files: DataFrame, path: str) -> None:
    """File records by hash: known ones change only when they were last checked."""
    now = files.dropDuplicates(["file_hash"]).withColumn("last_checked", F.current_timestamp())
    old = read_or_empty(spark, path, now)
    seen = now.select("file_hash", F.col("last_checked").alias("_now"))
    kept = old.join(seen, "file_hash", "left").withColumn("last_checked", F.coalesce("_now", "last_checked")).drop("_now").select(*now.columns)
    replace_table(kept.unionByName(now.join(old.select("file_hash"), "file_hash", "left_anti").select(*now.columns)), path)


def parsed_files(sections: DataFrame) -> DataFrame:
    """One record for each parsed file: its metadata, its sections in order, and their number."""
    section = F.struct("section_index", "section", "text")
    own = F.transform(F.array_sort(F.collect_list(section)), lambda x: F.struct(x["section"].alias("section"), x["text"].alias("text")))  # bounded by one file
    found = sections.where("status = 'success'").groupBy("path", "title", "source_format").agg(own.alias("documents"))
    return found.select("path", F.struct("title", "source_format").alias("metadata"), "documents", F.size("documents").alias("count"), F.current_timestamp().alias("created_at"))


def save_documents(docs: DataFrame, path: str) -> None:
    docs.write.json(path)


def save_by_path(sections: DataFrame, path: str) -> None:
    """Parsed files as JSON, a folder for each file's path."""
    found = parsed_files(sections)
    found.withColumn("file", F.sha2("path", 256).substr(1, 16)).write.partitionBy("file").json(path)


def save_errors(sections: DataFrame, path: str) -> None:
    sections.where("status = 'failed'").select("path", "error").write.json(path)


def save_review_queue(queue: DataFrame, path: str) -> None:
    queue.write.option("header", True).csv(f"{path}/csv")
    queue.write.json(f"{path}/json")


def notes(sections: DataFrame) -> DataFrame:
    """Each section as a Markdown note, linked to the ones before and after: (title, file, note)."""
    order = Window.partitionBy("path").orderBy("section_index")
    name = F.concat(F.format_string("%02d_", F.col("section_index")), sanitize_filename(F.col("section")))
    rows = sections.where("status = 'success'").withColumn("name", name).withColumns({"before": F.lag("name").over(order), "after": F.lead("name").over(order)})
    link = lambda label, c: F.coalesce(F.concat(F.lit(f"\n{label}: [["), F.col(c), F.lit("]]")), F.lit(""))
    note = F.concat(F.lit("---\ntitle: "), "title", F.lit("\nsection: "), "section", F.lit("\n---\n\n# "), "section", F.lit("\n\n"), "text", F.lit("\n"), link("Previous", "before"), link("Next", "after"))
    return rows.select("path", "title", F.concat("name", F.lit(".md")).alias("file"), note.alias("note"))


def note_index(sections: DataFrame) -> DataFrame:
    """One page for each document that lists its notes."""
    found = notes(sections)
    return found.groupBy("path", "title").agg(F.array_join(F.transform(F.array_sort(F.collect_list("file")), lambda f: F.concat(F.lit("- [["), F.regexp_replace(f, "\\.md$", ""), F.lit("]]"))), "\n").alias("index"))


def write_notes(rows: DataFrame, root: str) -> DataFrame:
    """Writes note files below a folder that all executors share and returns their names."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, folder = fs.FileSystem.from_uri(root)
        for batch in batches:
            for title, name, note in zip(batch["title"], batch["file"], batch["note"], strict=True):
                own = "".join(c if c.isalnum() else "_" for c in title)[:50] or "untitled"
                files.create_dir(f"{folder}/{own}", recursive=True)
                with files.open_output_stream(f"{folder}/{own}/{name}") as out:
                    out.write(note.encode())
            yield batch[["file"]]

    return rows.select("title", "file", "note").mapInPandas(run, "file string")


def export_graph(edges: DataFrame, path: str, kind: str) -> None:
    """Edges as Parquet, JSON lines or N-Triples."""
    if kind == "parquet":
        edges.write.parquet(path)
    elif kind == "json":
        edges.write.json(path)
    elif kind == "ntriples":
        iri = lambda c: F.concat(F.lit("<urn:entity:"), F.url_encode(F.col(c)), F.lit(">"))
        edges.select(F.concat(iri("src"), F.lit(" "), iri("relation"), F.lit(" "), iri("dst"), F.lit(" .")).alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown export {kind}")


def run(spark: SparkSession, statement: str, **values: object) -> DataFrame:
    """Any statement over registered tables, with named values."""
    return spark.sql(statement, args=values)


def is_unique(df: DataFrame, *keys: str) -> bool:
    """Whether no two rows share the keys."""
    return df.groupBy(*keys).count().where("count > 1").isEmpty()
