"""Queries that chain sources, extraction, figures and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import triples as tf
from tessera.operators import chunking, dedup, extraction, figures, paths, phrases, retrieval, weighting
from tessera.session import cut_lineage, shared_path, table
from tessera.sources import files, sinks

from .graph_queries import GEO, LOWER, PATHS, PENALTY, chains, geo_triples
from .registry import query


@query("html_sections")
def _sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of raw pages; nesting is broken there, so no SQL says the same."""
    return files.html_sections(table(spark, sf_dir, "pages"))


@query("format_detection", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'html' WHEN page_id % 3 = 1 THEN 'markdown' ELSE 'tei' END AS format FROM pages")
def _formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 3
    name = F.concat(F.lit("page"), F.when(k == 0, ".HTML").when(k == 1, ".md").otherwise(".xml"))
    content = F.when(k == 2, F.concat(F.lit("<?xml version='1.0'?><TEI>"), "html")).otherwise(F.col("html")).cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", files.detect_format(name, content).alias("format"))


FIGURES = """f AS (SELECT page_id // 2 % 3 AS doc_id, page_id AS figure_id, page_id % 10 AS page, length(html) % 800 AS y FROM pages WHERE page_id % 2 = 0),
c AS (SELECT page_id // 2 % 3 AS doc_id, 'chunk_' || page_id AS chunk_id, (page_id % 10) * 3 % 14 AS page, length(html) * 7 % 800 AS y, page_id AS seq FROM pages WHERE page_id % 2 = 1)"""


@query("figure_align", f"""WITH {FIGURES}, near AS (SELECT figure_id, chunk_id, row_number() OVER (PARTITION BY figure_id ORDER BY CASE WHEN c.page = f.page THEN 0 WHEN abs(c.page - f.page) = 1 THEN 1 ELSE 2 END,
  CASE WHEN c.page = f.page THEN abs(c.y - f.y) WHEN abs(c.page - f.page) = 1 THEN 0 ELSE abs(c.page - f.page) END, seq) AS k FROM f JOIN c USING (doc_id)) SELECT figure_id, chunk_id FROM near WHERE k = 1""")
def _figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as figures and chunks of three documents."""
    pages = table(spark, sf_dir, "pages").withColumn("n", F.char_length("html")).withColumn("doc_id", F.expr("page_id div 2 % 3"))
    box = lambda y: F.array(F.lit(0.0), y.cast("double"), F.lit(100.0), y.cast("double"))
    f = pages.where("page_id % 2 = 0").select("doc_id", F.col("page_id").alias("figure_id"), (F.col("page_id") % 10).alias("page"), box(F.col("n") % 800).alias("bbox"))
    c = pages.where("page_id % 2 = 1").select("doc_id", F.concat(F.lit("chunk_"), F.col("page_id").cast("string")).alias("chunk_id"), ((F.col("page_id") % 10) * 3 % 14).alias("page"), box(F.col("n") * 7 % 800).alias("bbox"), F.col("page_id").alias("seq"))
    return figures.aligned(f, c)


BENCHMARK_TRIPLES = """w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), t AS (SELECT item_id * 10000 + k AS triple_idx, w[3 * k + 1] AS s, w[3 * k + 2] AS r, w[3 * k + 3] AS o FROM (SELECT item_id, w, unnest(range(len(w) // 3)) AS k FROM w))"""


@query("triple_to_doc", f"""WITH {BENCHMARK_TRIPLES}, n AS (SELECT DISTINCT lower(x) AS name FROM (SELECT s AS x FROM t UNION ALL SELECT o FROM t)), d AS (SELECT doc_id, lower(text) AS x FROM documents),
held AS (SELECT name, min(doc_id) AS doc_id FROM n JOIN d ON contains(x, name) WHERE name <> '' GROUP BY 1)
SELECT triple_idx, s, o, coalesce(least(a.doc_id, b.doc_id), a.doc_id, b.doc_id, (SELECT min(doc_id) FROM documents)) AS doc_id FROM t LEFT JOIN held a ON a.name = lower(s) LEFT JOIN held b ON b.name = lower(o)""")
def _to_doc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each three words of a benchmark passage as a triple, with the first document that holds its subject or object."""
    words = F.split("text", " ")
    rows = table(spark, sf_dir, "benchmark").select("item_id", words.alias("w")).where(F.size("w") >= 3).select("item_id", "w", F.explode(F.sequence(F.lit(0), F.floor(F.size("w") / 3).cast("int") - 1)).alias("k"))
    word = lambda i: F.element_at("w", 3 * F.col("k") + i)
    triples = rows.select((F.col("item_id") * 10000 + F.col("k")).alias("triple_idx"), F.lit(None).cast("long").alias("doc_id"), word(1).alias("s"), word(2).alias("r"), word(3).alias("o"))
    return extraction.to_documents(triples, table(spark, sf_dir, "documents")).select("triple_idx", "s", "o", "doc_id")


@query("benchmark_contamination", "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def _contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with each benchmark passage that it holds."""
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("phrase"))
    return phrases.holders(table(spark, sf_dir, "documents"), items).join(items, "phrase").select("doc_id", "item_id")


@query("extracted_triples", rf"""WITH c AS (SELECT doc_id, list_filter(regexp_split_to_array(substr(text, i * 462 + 1, 512), '\s+'), lambda x: x <> '') AS w
  FROM (SELECT *, unnest(range(0, CAST(greatest(0, ceil((length(text) - 512) / 462)) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)),
t AS (SELECT doc_id, CAST(k AS INT) AS triple_idx, w[3 * k + 1] AS s, w[3 * k + 2] AS r, w[3 * k + 3] AS o FROM (SELECT doc_id, w, unnest(range(least(15, len(w) // 3))) AS k FROM c)),
l AS ({LOWER}), q AS (SELECT doc_id, triple_idx, s, r, o, round(CAST({PENALTY} AS DOUBLE), 6) AS quality FROM l) SELECT * FROM q WHERE quality >= 0.3""")
def _extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to 15 triples of each graph chunk by the stand-in extractor, filtered; triple_idx counts within a chunk."""
    chunks = chunking.window_chunks(table(spark, sf_dir, "documents"), 512, 462, "structural")
    return extraction.filtered(extraction.extract_triples(chunks), 0.3).withColumn("quality", F.round("quality", 6))


@query("consistent_triples")
def _consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(r) for pair in tf.CONTRADICTIONS for r in pair])
    rows = geo_triples(spark, sf_dir).withColumn("r", F.element_at(names, (F.col("triple_idx") % F.size(names) + 1).cast("int")))
    doubled = rows.union(rows.select("doc_id", (F.col("triple_idx") + 1_000_000).alias("triple_idx"), F.col("o").alias("s"), F.element_at(names, ((F.col("triple_idx") + 1) % F.size(names) + 1).cast("int")).alias("r"), F.col("s").alias("o")))
    return extraction.consistent(doubled)


@query("merged_paths", f"WITH {GEO}, {PATHS}, e AS (SELECT p[1] AS a, p[2] AS b FROM chains UNION ALL SELECT p[2], p[3] FROM chains), s AS (SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*) AS n FROM e GROUP BY 1, 2), g AS (SELECT least(s, o) AS src, greatest(s, o) AS dst, arg_min(r, (doc_id, triple_idx)) AS relation FROM geo GROUP BY 1, 2) SELECT src, dst, coalesce(relation, 'path_inferred') AS relation, coalesce(n, 0) AS path_support FROM g FULL JOIN s USING (src, dst)")
def _merged_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.merge_paths(weighting.edge_list(geo_triples(spark, sf_dir)), chains(spark, sf_dir)).select("src", "dst", "relation", "path_support")


@query("edge_upsert", f"WITH {GEO}, old AS (SELECT DISTINCT least(s, o) AS src, greatest(s, o) AS dst, 0.5::DOUBLE AS weight FROM geo WHERE r <> 'belongs_to'), new AS (SELECT DISTINCT least(s, o) AS src, greatest(s, o) AS dst, 0.9::DOUBLE AS weight FROM geo WHERE r <> 'part_of') SELECT * FROM new UNION ALL SELECT * FROM old WHERE (src, dst) NOT IN (SELECT src, dst FROM new)")
def _upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of nations and suppliers, into which the edges of all suppliers and customers are upserted; read back from the table."""
    path = shared_path(spark, "edge-upsert")
    triples = geo_triples(spark, sf_dir)
    edges = lambda rows, w: rows.select(F.least("s", "o").alias("src"), F.greatest("s", "o").alias("dst"), F.col("r").alias("relation"), F.lit(w).alias("weight")).distinct()
    sinks.upsert_edges(spark, edges(triples.where("r <> 'belongs_to'"), 0.5), path)
    sinks.upsert_edges(spark, edges(triples.where("r <> 'part_of'"), 0.9), path)
    return sinks.read_table(spark, path).select("src", "dst", "weight")


@query("file_upsert", "SELECT sha256(html) AS file_hash, max(length(html)) AS file_size FROM pages GROUP BY 1")
def _file_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files, upserted by hash: first those of even ids, then all; read back from the table."""
    path = shared_path(spark, "file-upsert")
    pages = table(spark, sf_dir, "pages").select("page_id", F.sha2("html", 256).alias("file_hash"), F.char_length("html").cast("long").alias("file_size"))
    sinks.upsert_files(spark, pages.where("page_id % 2 = 0").drop("page_id"), path)
    sinks.upsert_files(spark, pages.drop("page_id"), path)
    return sinks.read_table(spark, path).select("file_hash", "file_size")


@query("content_registry", "SELECT sha256(text) AS text_hash, min(doc_id) AS doc_id, length(any_value(text)) AS text_length FROM documents GROUP BY text")
def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = dedup.content_records(dedup.exact_dedup(table(spark, sf_dir, "documents")))
    return records.select("text_hash", "doc_id", F.col("text_length").cast("long").alias("text_length"))


@query("retrieval_store")
def _store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit vectors of all retrieval chunks, each distinct text embedded once; components to six places."""
    chunks = chunking.dual_chunks(table(spark, sf_dir, "documents")).where("chunk_type = 'semantic'")
    return retrieval.build_store(cut_lineage(chunks, "chunks")).select("doc_id", "chunk_id", F.transform("emb", lambda x: F.round(x, 6)).alias("emb"))


@query("event_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.streaming.ingest import windowed_counts

    return windowed_counts(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))
