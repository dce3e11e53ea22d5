"""Queries over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.operators import chunking, dedup, models, quality
from tessera.session import table

from .registry import query

SPACES = r"[\s\x1c-\x1f\x85\xa0]"
CLEAN = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("clean_text", f"SELECT doc_id, md5({CLEAN}) AS cleaned_md5, length({CLEAN}) AS cleaned_length FROM documents")
def _clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = fn.clean_text(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(cleaned.cast("binary")).alias("cleaned_md5"), F.char_length(cleaned).cast("long").alias("cleaned_length"))


@query("text_hash", "SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5, 'doc_' || substr(sha256(text), 1, 8) AS short_id, CAST(doc_id AS VARCHAR) || '_chunk0_' || substr(md5(substr(text, 1, 100)), 1, 8) AS chunk_id, length(text) // 4 AS tokens FROM documents")
def _hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", fn.text_hash(x).alias("sha256"), fn.text_hash(x, "md5").alias("md5"), fn.generate_id(x, "doc_").alias("short_id"), fn.chunk_id(x, F.col("doc_id"), F.lit(0)).alias("chunk_id"), fn.token_estimate(x).alias("tokens"))


FUZZY = r"""array_to_string(list_transform(list_filter([1, 11, 21, 31, 41], lambda i: i <= length(p) - 2), lambda i: substr(md5(substr(p, i, 3)), 1, 8)), '-')"""
FUZZY_CTE = rf"WITH f AS (SELECT doc_id, text, {FUZZY} AS fuzzy_hash FROM (SELECT *, regexp_replace(lower(text), '\s+', '', 'g') AS p FROM documents))"


@query("fuzzy_hash", f"{FUZZY_CTE} SELECT doc_id, fuzzy_hash FROM f")
def _fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", fn.fuzzy_hash(F.col("text")).alias("fuzzy_hash"))


@query("exact_dedup", "SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text")
def _exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text")


@query("registry_insert_if_absent", "WITH r AS (SELECT DISTINCT text FROM documents WHERE source = 'src0') SELECT doc_id, sha256(text) AS text_hash FROM documents WHERE text NOT IN (SELECT text FROM r)")
def _registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    registry = dedup.content_records(docs.where("source = 'src0'"))
    return dedup.not_registered(docs, registry).select("doc_id", "text_hash")


@query("fuzzy_blocks", f"{FUZZY_CTE} SELECT string_split(fuzzy_hash, '-')[1] AS block, count(*) AS docs, min(doc_id) AS first_doc FROM f WHERE fuzzy_hash <> '' GROUP BY 1")
def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.fuzzy_keys(table(spark, sf_dir, "documents")).groupBy("block").agg(F.count("*").alias("docs"), F.min("doc_id").alias("first_doc"))


@query("fuzzy_dups_levenshtein")
def _levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances in characters; the SQL at hand measures bytes, so there is none to compare with."""
    pairs = dedup.fuzzy_pairs(table(spark, sf_dir, "documents"), measure="levenshtein")
    return pairs.withColumn("similarity", F.round("similarity", 6))


@query("fuzzy_dups_ratio")
def _ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier duplicates of each document; a later copy of a text has its first one alone, at 1.0, and shares that one's pairs."""
    docs = table(spark, sf_dir, "documents")
    return dedup.ranked_duplicates(dedup.fuzzy_pairs(docs).union(dedup.copies(docs))).withColumn("similarity", F.round("similarity", 6))


def _share(ranges: str, n: int = 300) -> str:
    return f"len(regexp_extract_all(substr(text, 1, {n}), '[{ranges}]')) / length(substr(text, 1, {n}))"


KANA, HAN, KOR = r"\x{3040}-\x{309f}\x{30a0}-\x{30ff}", r"\x{4e00}-\x{9fff}", r"\x{ac00}-\x{d7af}"


def _language_sql(korean: bool) -> str:
    ko = f"WHEN {_share(KOR)} > 0.3 THEN 'ko'" if korean else ""
    return f"CASE WHEN coalesce(length(text), 0) = 0 THEN 'unknown' WHEN {_share(KANA)} > 0.15 THEN 'ja' {ko} WHEN {_share(HAN)} > 0.3 AND {_share(KANA)} < 0.05 THEN 'zh' WHEN {_share(chr(92) + 'x00-' + chr(92) + 'x7f')} > 0.7 THEN 'en' ELSE 'other' END"


@query("lang_detect", f"SELECT doc_id, {_language_sql(False)} AS by_text, {_language_sql(True)} AS by_core, CASE WHEN length(text) > 0 AND {_share(KANA + HAN, 500)} > 0.3 THEN 'ja' ELSE 'en' END AS by_document FROM documents")
def _language(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", fn.detect_language(x).alias("by_text"), fn.detect_language(x, korean=True).alias("by_core"), fn.document_language(x).alias("by_document"))


@query("lang_majority", "WITH f AS (SELECT lang, doc_id FROM documents ORDER BY doc_id LIMIT 5) SELECT lang, count(*) AS n FROM f GROUP BY lang ORDER BY n DESC, min(doc_id) LIMIT 1")
def _majority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of most of the first five documents; ties go to the one seen first. The five are the feature."""
    first = table(spark, sf_dir, "documents").select("lang", "doc_id").orderBy("doc_id").limit(5)
    return first.groupBy("lang").agg(F.count("*").alias("n"), F.min("doc_id").alias("seen")).orderBy(F.desc("n"), "seen").limit(1).select("lang", "n")


def _window_sql(size: int, step: int, kind: str) -> str:
    return f"""SELECT doc_id, i AS chunk_index, '{kind}' AS chunk_type, i * {step} AS start_char, least(i * {step} + {size}, length(text)) AS end_char, substr(text, i * {step} + 1, {size}) AS chunk
FROM (SELECT *, unnest(range(0, CAST(greatest(0, ceil((length(text) - {size}) / {step})) AS BIGINT) + 1)) AS i FROM documents WHERE length(text) > 0)"""


CHUNKS = f"WITH c AS ({_window_sql(320, 200, 'semantic')} UNION ALL {_window_sql(512, 462, 'structural')}), k AS (SELECT *, CAST(doc_id AS VARCHAR) || '_chunk' || chunk_index || '_' || substr(md5(substr(chunk, 1, 100)), 1, 8) AS chunk_id FROM c)"


@query("dual_chunks", f"{CHUNKS} SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, chunk_type, CAST(start_char AS INT) AS start_char, CAST(end_char AS INT) AS end_char, md5(chunk) AS chunk_md5, chunk_id FROM k")
def _dual(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.dual_chunks(table(spark, sf_dir, "documents")).select("doc_id", "chunk_index", "chunk_type", "start_char", F.col("end_char").cast("int").alias("end_char"), F.md5(F.col("chunk").cast("binary")).alias("chunk_md5"), "chunk_id")


@query("chunk_overlap_map", f"{CHUNKS} SELECT a.doc_id, a.chunk_id AS retrieval_chunk_id, b.chunk_id AS graph_chunk_id FROM k a JOIN k b ON a.doc_id = b.doc_id AND a.chunk_type = 'semantic' AND b.chunk_type = 'structural' AND a.start_char < b.end_char AND b.start_char < a.end_char")
def _overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.overlapping(chunking.dual_chunks(table(spark, sf_dir, "documents")))


@query("paragraph_chunks")
def _paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.paragraph_chunks(table(spark, sf_dir, "documents"), separator="\n")


SENTENCE_LISTS = r"""d AS (SELECT doc_id, list_filter(string_split(regexp_replace(text, '([。．.!?])[ \t\n\r\f\v]+', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(13)) <> '') AS p FROM documents)"""
SENTENCES = f"WITH {SENTENCE_LISTS}, s AS (SELECT doc_id, unnest(p) AS sentence, unnest(range(len(p))) AS position, p FROM d)"


@query("sentence_split", f"{SENTENCES} SELECT doc_id, CAST(position AS INT) AS position, sentence FROM s")
def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sentences(table(spark, sf_dir, "documents"))


@query("sentence_context", f"{SENTENCES} SELECT doc_id, CAST(position AS INT) AS position, array_to_string(p[greatest(1, position) : position + 2], ' ') AS context FROM s")
def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.sentence_context(table(spark, sf_dir, "documents")).select("doc_id", "position", "context")


MENTIONS = """m AS (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ')[5] AS entity FROM documents UNION SELECT doc_id, 'zz' || doc_id % 7 FROM documents), u AS (SELECT * FROM m WHERE entity <> '')"""


@query("entity_contexts", f"""WITH {SENTENCE_LISTS}, {MENTIONS}, f AS (SELECT entity, min(doc_id) AS first FROM u GROUP BY 1),
x AS (SELECT u.entity, u.doc_id, p, text, first, list_filter(range(len(p)), lambda i: contains(lower(p[i + 1]), lower(u.entity))) AS places FROM u JOIN f USING (entity) JOIN d USING (doc_id) JOIN documents USING (doc_id)),
y AS (SELECT *, unnest(CASE WHEN len(places) = 0 AND doc_id = first THEN [-1] ELSE places END) AS position FROM x)
SELECT entity, doc_id, CAST(position AS INT) AS position, CASE WHEN position < 0 THEN coalesce(p[1], substr(text, 1, 200)) ELSE array_to_string(p[greatest(1, position) : position + 2], ' ') END AS context FROM y""")
def _entity_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifth word of each document, and names that occur nowhere, with the sentences around them."""
    docs = table(spark, sf_dir, "documents")
    word = F.get(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " "), F.lit(4))
    mentions = docs.select("doc_id", F.explode(F.array(word, F.concat(F.lit("zz"), (F.col("doc_id") % 7).cast("string")))).alias("entity"))
    return chunking.entity_contexts(docs, mentions)


LINES = r"len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x, '\s+', '', 'g') <> ''))"
ISSUES = f"SELECT *, CASE WHEN trim(text) = '' THEN 'empty' WHEN {LINES} < 3 THEN 'too_short' ELSE '' END AS issue FROM documents"


@query("quality_issues", f"SELECT doc_id, issue AS issues, 'low' AS severity, CASE WHEN issue = '' THEN 'clean' ELSE 'flagged' END AS route FROM ({ISSUES})")
def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.routed(table(spark, sf_dir, "documents")).select("doc_id", F.concat_ws(", ", "issues").alias("issues"), "severity", "route")


@query("review_queue", f"SELECT doc_id, 'low' AS severity, issue AS issues, substr(text, 1, 100) || '...' AS preview FROM ({ISSUES}) WHERE issue <> ''")
def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.review_queue(table(spark, sf_dir, "documents"))


@query("quality_vs_labels", f"SELECT CASE WHEN issue = '' THEN 'clean' ELSE 'flagged' END AS route, l.quality, count(*) AS docs FROM ({ISSUES}) d JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1, 2")
def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = quality.routed(table(spark, sf_dir, "documents")).select("doc_id", "route")
    return routes.join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id").groupBy("route", "quality").agg(F.count("*").alias("docs"))


@query("quality_deep", f"""WITH documents AS (SELECT d.doc_id, CASE WHEN doc_id % 3 = 0 THEN lower(text) ELSE text END || CASE WHEN doc_id % 5 = 0 THEN ' (' ELSE '' END || CASE WHEN doc_id % 7 = 0 THEN ' See figure 1.' ELSE '' END AS text FROM main.documents d), i AS ({ISSUES}), a AS (SELECT doc_id, list_filter([issue, CASE WHEN issue <> '' AND regexp_matches(text, '^\\p{{Ll}}') THEN 'missing_subject' ELSE '' END,
  CASE WHEN issue <> '' AND length(replace(text, '(', '')) <> length(replace(text, ')', '')) THEN 'structural_damage' ELSE '' END, CASE WHEN issue <> '' AND contains(lower(text), 'figure') THEN 'missing_visual' ELSE '' END], lambda x: x <> '') AS f FROM i)
SELECT doc_id, array_to_string(f, ', ') AS issues, CASE WHEN list_contains(f, 'missing_subject') OR list_contains(f, 'structural_damage') THEN 'high' WHEN list_contains(f, 'missing_visual') THEN 'medium' ELSE 'low' END AS severity, CASE WHEN len(f) = 0 THEN 'clean' ELSE 'flagged' END AS route FROM a""")
def _deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Issues with those that the stand-in model finds in flagged documents. Every third text begins in lower case, every fifth lacks a bracket, every seventh speaks of a figure."""
    k = F.col("doc_id")
    text = F.when(k % 3 == 0, F.lower("text")).otherwise(F.col("text"))
    text = F.concat(text, F.when(k % 5 == 0, " (").otherwise(""), F.when(k % 7 == 0, " See figure 1.").otherwise(""))
    docs = table(spark, sf_dir, "documents").withColumn("text", text)
    return quality.routed(docs, check=models.plain_check).select("doc_id", F.concat_ws(", ", "issues").alias("issues"), "severity", "route")


@query("conversation_nav", "SELECT conv_id, turn, row_number() OVER w - 1 AS position, count(*) OVER (PARTITION BY conv_id) AS total, lag(role) OVER w AS previous, lead(role) OVER w AS next FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _navigation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.neighbours(table(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", F.col("position").cast("long").alias("position"), "total", "previous", "next")


TITLE = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g'))"


@query("html_title", f"SELECT page_id, {TITLE} AS title, length(html) AS size FROM pages")
def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = fn.clean_text(F.regexp_extract("html", "(?is)<title[^>]*>(.*?)</title>", 1))
    return table(spark, sf_dir, "pages").select("page_id", title.alias("title"), F.char_length("html").cast("long").alias("size"))


@query("run_stats", "SELECT count(*) AS total, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS failed, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END)::BIGINT AS success, round(avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END), 6) AS error_rate FROM events")
def _run_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.stats import run_summary

    log = table(spark, sf_dir, "events").select(F.when(F.col("event_type") == "error", "failed").otherwise("success").alias("status"))
    return run_summary(log)
