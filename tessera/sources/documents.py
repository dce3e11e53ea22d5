"""JSON documents, raw texts, path files, provenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators.phrases import holders

DOCUMENT = "text string, metadata struct<title:string,authors:string,section:string,section_index:int,source_format:string>"


def load_json(spark: SparkSession, path: str) -> DataFrame:
    """json_id, text and metadata of {"documents": [...]} files; the id is the place in the list."""
    rows = spark.read.schema(f"documents array<struct<{DOCUMENT.replace('text string', 'text:string').replace('metadata struct', 'metadata:struct')}>>").option("multiLine", True).json(path)
    return rows.select(F.posexplode("documents").alias("json_id", "d")).select("json_id", "d.text", "d.metadata")


def load_texts(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "raw_id int, text string")


def load_documents(json_docs: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """JSON and raw documents in one frame, the first of each text kept; JSON comes first."""
    both = json_docs.select(F.lit(0).alias("part"), F.col("json_id").alias("place"), "text", "metadata")
    if raw is not None:
        both = both.unionByName(raw.select(F.lit(1).alias("part"), F.col("raw_id").alias("place"), "text"), allowMissingColumns=True)
    from tessera.operators.dedup import first_of_each

    return first_of_each(both, fn.text_hash(F.col("text")), F.struct("part", "place"))


def load_paths(spark: SparkSession, path: str) -> DataFrame:
    """Path records of JSON lines; rows without paths are left out. Pickles aren't read."""
    schema = "question string, translated_paths array<array<string>>, reasoning_paths array<array<string>>, path_distances array<double>"
    return spark.read.schema(schema).json(path).where("translated_paths is not null")


def flattened(record: dict) -> dict:
    """A record without the levels that hold a single record each."""
    while len(record) == 1 and isinstance(inner := next(iter(record.values())), dict):
        record = inner
    return record


def missing_keys(record: dict, required: tuple[str, ...]) -> list[str]:
    return sorted(set(required) - set(record))


def path_rows(records: DataFrame) -> DataFrame:
    """question, path, distance: a row for each path."""
    pairs = F.arrays_zip(F.col("translated_paths").alias("path"), F.col("path_distances").alias("distance"))
    return records.select("question", F.explode(pairs).alias("p")).select("question", "p.path", "p.distance").where("path is not null")


def documents_with_paths(docs: DataFrame, records: DataFrame, key: str = "question") -> DataFrame:
    """Each document with the record of its question, or else of the first question that its text holds."""
    exact = docs.join(records, key, "left") if key in docs.columns else docs.withColumns({c: F.lit(None).cast(t) for c, t in records.dtypes})
    missing = exact.where("translated_paths is null").select("doc_id", "text")
    held = holders(missing, records.select(F.col("question").alias("phrase")))
    best = held.groupBy("doc_id").agg(F.min("phrase").alias("_q")).join(records.select(F.col("question").alias("_q"), F.struct("translated_paths", "path_distances").alias("m")), "_q").drop("_q")
    return exact.join(best, "doc_id", "left").withColumns({"translated_paths": F.coalesce("translated_paths", "m.translated_paths"), "path_distances": F.coalesce("path_distances", "m.path_distances")}).drop("m")


def provenance(files: DataFrame) -> DataFrame:
    """Where a file comes from, and its version."""
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), "\\.[^.]*$", "")
    return files.select(F.col("path").alias("source_path"), F.element_at(F.split("path", "\\."), -1).alias("source_type"), F.sha2("content", 256).alias("file_hash"), F.current_timestamp().alias("ingested_at"), fn.file_version(stem, F.col("modificationTime")).alias("version"), F.col("length").alias("file_size"), (F.col("length") / 1048576).alias("size_mb"))


def to_properties(record: Column) -> Column:
    """Open metadata as a JSON string, for flat stores."""
    return F.to_json(record)


def from_properties(text: Column, schema: str) -> Column:
    return F.from_json(text, schema)
