"""Queries over triples derived from the relational tables, all of their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import relations as rel
from tessera.functions import text as fn
from tessera.functions import triples as tf
from tessera.functions import vectors as vf
from tessera.operators import chunking, extraction, linking, paths, questions, retrieval, weighting
from tessera.session import cut_lineage, table

from .registry import query

GEO = """geo AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, r, o) AS INT) AS triple_idx, s, r, o FROM (
    SELECT n_regionkey AS doc_id, n_name AS s, 'part_of' AS r, r_name AS o FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT n_regionkey, s_name, 'located_in', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
    UNION ALL SELECT n_regionkey, c_name, 'belongs_to', n_name FROM customer JOIN nation ON c_nationkey = n_nationkey))"""
BRAND = """brand AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY s, r, o) AS INT) AS triple_idx, s, r, o FROM (
    SELECT o_custkey AS doc_id, 'order_' || o_orderkey AS s, 'belongs_to' AS r, c_name AS o FROM orders JOIN customer ON o_custkey = c_custkey
    UNION ALL SELECT DISTINCT o_custkey, 'order_' || o_orderkey, 'contains', p_brand FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey))"""


def _indexed(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("doc_id").orderBy("s", "r", "o")
    return rows.withColumn("triple_idx", F.row_number().over(order)).select("doc_id", "triple_idx", "s", "r", "o")


def geo_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    triple = lambda s, r, o: (F.col("n_regionkey").alias("doc_id"), F.col(s).alias("s"), F.lit(r).alias("r"), F.col(o).alias("o"))
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(*triple("n_name", "part_of", "r_name"))
    for name, key, column, relation in (("supplier", "s_nationkey", "s_name", "located_in"), ("customer", "c_nationkey", "c_name", "belongs_to")):
        rows = rows.union(table(spark, sf_dir, name).join(nation, F.col(key) == F.col("n_nationkey")).select(*triple(column, relation, "n_name")))
    return _indexed(rows)


#: Rows of a task of the joins of orders and of their lines: what a task holds doesn't grow with the tables, as a split of a file or a merged partition would.
TASK_ROWS = 1 << 19


def _tasks(rows: DataFrame) -> int:
    """Tasks of some ``TASK_ROWS`` for a stored table, at least one for each core; the number of rows comes from the files' footers."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))


def brand_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their customer, and with the brands of their lines; the brands of an order are made distinct by its key, where its lines are joined, before names are made."""
    orders, customer = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    name = F.concat(F.lit("order_"), F.col("o_orderkey").cast("string"))
    triple = lambda r, o: (F.col("o_custkey").alias("doc_id"), name.alias("s"), F.lit(r).alias("r"), F.col(o).alias("o"))
    own = orders.repartition(_tasks(orders), "o_custkey").join(customer, F.col("o_custkey") == F.col("c_custkey")).select(*triple("belongs_to", "c_name"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    tasks = _tasks(lines)
    lines = lines.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "p_brand")
    held = orders.join(lines.repartition(tasks, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey")).select("o_custkey", "o_orderkey", "p_brand").distinct()
    return _indexed(own.union(held.select(*triple("contains", "p_brand"))))


def _values(rows: list[tuple]) -> str:
    return "(VALUES " + ", ".join("(" + ", ".join(f"'{x}'" for x in row) + ")" for row in rows) + ")"


COMPAT = f"""inverse(a, b) AS {_values(list(rel.INVERSE))},
groups(name, r) AS {_values([(n, r) for n, rs in rel.GROUPS.items() for r in rs])},
kinds(name, r) AS {_values([(n, r) for n, rs in rel.CATEGORIES.items() for r in rs])},
compat AS (SELECT r1, r2, CASE WHEN x = y THEN 1.0::DOUBLE
  WHEN (x, y) IN (SELECT a, b FROM inverse UNION ALL SELECT b, a FROM inverse) THEN 0.9
  WHEN (x, y) IN (SELECT g.r, h.r FROM groups g JOIN groups h USING (name)) THEN 0.7
  WHEN (x, y) IN (SELECT g.r, h.r FROM kinds g JOIN kinds h USING (name)) THEN 0.5 ELSE 0.3 END AS c
  FROM (SELECT a.r AS r1, b.r AS r2, replace(lower(a.r), '-', '_') AS x, replace(lower(b.r), '-', '_') AS y FROM names a, names b))"""
RELATION_NAMES = sorted({r for rs in (*rel.GROUPS.values(), *rel.CATEGORIES.values()) for r in rs} | {r for pair in rel.INVERSE for r in pair} | {"foo", "Part-Of", "LEADS-TO"})


@query("relation_compat", f"WITH names(r) AS {_values([(r,) for r in RELATION_NAMES])}, {COMPAT} SELECT r1, r2, c AS compat FROM compat")
def _compat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of the fixed vocabulary."""
    return rel.compatibility_table(spark.createDataFrame([(r,) for r in RELATION_NAMES], "r string"))


# --- scores -----------------------------------------------------------------------------------
TEXT_TRIPLES = r"""t AS (SELECT doc_id, k AS triple_idx, w[3 * k + 1] AS s, w[3 * k + 2] AS r, w[3 * k + 3] AS o FROM (
  SELECT doc_id, w, unnest(range(len(w) // 3)) AS k FROM (SELECT doc_id, string_split(replace(text, chr(10), ' '), ' ') AS w FROM documents)))"""


def text_triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each three words of a text as a triple."""
    words = F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")
    rows = table(spark, sf_dir, "documents").select("doc_id", words.alias("w")).where(F.size("w") >= 3)
    rows = rows.select("doc_id", "w", F.explode(F.sequence(F.lit(0), F.floor(F.size("w") / 3).cast("int") - 1)).alias("triple_idx"))
    word = lambda i: F.element_at("w", 3 * F.col("triple_idx") + i)
    return rows.select("doc_id", "triple_idx", word(1).alias("s"), word(2).alias("r"), word(3).alias("o"))


def _in(names: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


DIGITS, ALNUM = "'^[0-9]+$'", r"'[\p{L}\p{N}]'"
LOWER = "SELECT *, trim(lower(s)) AS ls, trim(lower(r)) AS lr, trim(lower(o)) AS lo FROM t"
PENALTY = f"""greatest(0.0, least(1.0, 1.0 - CASE WHEN length(ls) < 2 OR length(lr) < 2 OR length(lo) < 2 THEN 0.4 ELSE 0.0 END
 - CASE WHEN regexp_matches(ls, {DIGITS}) OR regexp_matches(lo, {DIGITS}) OR NOT regexp_matches(ls, {ALNUM}) THEN 0.3 ELSE 0.0 END
 - CASE WHEN lr IN {_in(tf.BLACKLIST)} THEN 0.3 ELSE 0.0 END - CASE WHEN ls = lo THEN 0.5 ELSE 0.0 END - CASE WHEN ls = lr OR lo = lr THEN 0.3 ELSE 0.0 END))"""
CLARITY = f"CASE WHEN lr IN {_in(tf.BLACKLIST)} OR length(lr) < 2 THEN 0.0 WHEN lr IN {_in(tf.HIGH)} THEN 1.0 WHEN lr IN {_in(tf.MEDIUM)} THEN 0.7 WHEN regexp_matches(lr, '(s|ed|ing)$') THEN 0.6 ELSE 0.3 END"
SPECIFIC = lambda x: f"CASE WHEN length({x}) < 2 OR {x} IN {_in(tf.PRONOUNS)} THEN 0.0 ELSE 0.5 END"  # noqa: E731  the words of text triples have no blanks
GRAMMAR = f"""greatest(0.0, 1.0 - CASE WHEN s = lower(s) AND regexp_matches(s, '\\p{{Ll}}') AND o = lower(o) AND regexp_matches(o, '\\p{{Ll}}') THEN 0.2 ELSE 0.0 END
 - CASE WHEN regexp_matches(s, {DIGITS}) OR regexp_matches(o, {DIGITS}) THEN 0.3 ELSE 0.0 END - CASE WHEN NOT regexp_matches(s, {ALNUM}) OR NOT regexp_matches(o, {ALNUM}) THEN 0.5 ELSE 0.0 END
 - CASE WHEN lower(s) = lower(o) THEN 0.5 ELSE 0.0 END - CASE WHEN length(lr) < 2 THEN 0.4 ELSE 0.0 END - CASE WHEN lr IN {_in(tf.BLACKLIST)} THEN 0.3 ELSE 0.0 END
 - CASE WHEN NOT regexp_matches(r, {ALNUM}) THEN 0.4 ELSE 0.0 END - CASE WHEN lower(s) = lr THEN 0.3 ELSE 0.0 END - CASE WHEN lower(o) = lr THEN 0.3 ELSE 0.0 END
 - CASE WHEN lower(s) = lr AND lr = lower(o) THEN 0.5 ELSE 0.0 END)"""


@query("triple_quality", f"WITH {TEXT_TRIPLES}, l AS ({LOWER}) SELECT doc_id, CAST(triple_idx AS INT) AS triple_idx, round(CAST({PENALTY} AS DOUBLE), 6) AS penalty, round(CAST(least(1.0, 0.4 * {CLARITY} + 0.3 * ({SPECIFIC('ls')} + {SPECIFIC('lo')}) / 2 + 0.3 * {GRAMMAR}) AS DOUBLE), 6) AS weighted FROM l")
def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, r, o = map(F.col, "sro")
    return text_triples(spark, sf_dir).select("doc_id", "triple_idx", F.round(tf.quality_penalty(s, r, o), 6).alias("penalty"), F.round(tf.quality_weighted(s, r, o), 6).alias("weighted"))


@query("triple_filter_stats", f"WITH {TEXT_TRIPLES}, l AS ({LOWER}), q AS (SELECT round(CAST({PENALTY} AS DOUBLE), 6) AS score FROM l) SELECT count(*) AS original, sum(CASE WHEN score >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS kept, sum(CASE WHEN score < 0.5 THEN 1 ELSE 0 END)::BIGINT AS rejected, round(avg(score), 6) AS avg_quality FROM q")
def _filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.round(tf.quality_penalty(*map(F.col, "sro")), 6)
    kept = (F.col("score") >= 0.5).cast("long")
    return text_triples(spark, sf_dir).select(score.alias("score")).agg(F.count("*").alias("original"), F.sum(kept).alias("kept"), F.sum(1 - kept).alias("rejected"), F.round(F.avg("score"), 6).alias("avg_quality"))


@query("triple_alignment", f"""WITH {TEXT_TRIPLES}, l AS (SELECT t.*, lower(s) AS ls, replace(lower(r), '_', ' ') AS lr, lower(o) AS lo, lower(text) AS x FROM t JOIN documents USING (doc_id))
SELECT doc_id, CAST(triple_idx AS INT) AS triple_idx, round(least(1.0, 0.5 + 0.3 + CASE WHEN abs(instr(x, lo) - instr(x, ls)) < 50 THEN 0.2 WHEN abs(instr(x, lo) - instr(x, ls)) < 100 THEN 0.1 ELSE 0.0 END)::DOUBLE, 6) AS alignment FROM l""")
def _alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triples cut from a text occur in it, so both entities and the relation count."""
    rows = extraction.alignments(text_triples(spark, sf_dir), table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "triple_idx", F.round("alignment", 6).alias("alignment"))


PARSE = "SELECT '(' || n_name || ', located in, ' || r_name || ') and (' || r_name || ',has,' || n_name || ')' AS said, n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey"


@query("triple_parse", f"WITH p AS ({PARSE}) SELECT n_nationkey, n_name AS s, 'located in' AS r, r_name AS o FROM p UNION ALL SELECT n_nationkey, r_name, 'has', n_name FROM p UNION ALL SELECT n_nationkey, n_name, 'json', r_name FROM p")
def _parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model output in both forms, parsed again."""
    rows = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    said = F.format_string("(%s, located in, %s) and (%s,has,%s)", "n_name", "r_name", "r_name", "n_name")
    fenced = F.format_string('```json\n[["%s", "json", "%s"], ["two", "parts"]]\n```', "n_name", "r_name")
    parsed = F.concat(tf.parse_tuples(said), tf.parse_json_triples(fenced))
    return rows.select("n_nationkey", F.explode(parsed).alias("t")).select("n_nationkey", "t.s", "t.r", "t.o")


# --- weights ----------------------------------------------------------------------------------
EDGES = "edges AS (SELECT least(s, o) AS src, greatest(s, o) AS dst, arg_min(r, (doc_id, triple_idx)) AS relation, count(*) AS mentions FROM triples GROUP BY 1, 2)"
SHARED = "len(list_intersect(list_distinct([a.s, a.o]), list_distinct([b.s, b.o])))"
INTRA = f"""pairs AS (SELECT a.s AS s1, a.o AS o1, b.s AS s2, b.o AS o2, c.c * 0.6 + {SHARED} * 0.5 * 0.4 AS w FROM triples a JOIN triples b ON a.doc_id = b.doc_id AND a.triple_idx < b.triple_idx JOIN compat c ON c.r1 = a.r AND c.r2 = b.r),
intra AS (SELECT src, dst, sum(w) AS intra_raw FROM (SELECT least(s1, o1) AS src, greatest(s1, o1) AS dst, w FROM pairs WHERE w > 0.3 UNION ALL SELECT least(s2, o2), greatest(s2, o2), w FROM pairs WHERE w > 0.3) GROUP BY 1, 2)"""
INTER = f"""mention AS (SELECT doc_id, triple_idx, unnest(list_distinct([s, o])) AS entity FROM triples),
top AS (SELECT entity FROM (SELECT entity, count(*) AS n, min((doc_id, triple_idx)) AS first FROM mention GROUP BY 1 ORDER BY n DESC, first, entity LIMIT 100) WHERE n >= 3),
met AS (SELECT DISTINCT x.doc_id AS d1, x.triple_idx AS i1, y.doc_id AS d2, y.triple_idx AS i2 FROM mention x JOIN mention y USING (entity) JOIN top USING (entity) WHERE (x.doc_id, x.triple_idx) < (y.doc_id, y.triple_idx)),
crossed AS (SELECT a.s AS s1, a.o AS o1, b.s AS s2, b.o AS o2, least(1.0, least({SHARED} * 0.5, 1.0) * 0.4 + c.c * 0.3 + 0.3 * (1 - (CASE WHEN a.s = b.s THEN 0 WHEN e.src IS NOT NULL THEN 1 ELSE 2 END) / 3.0) * 0.1) AS w
  FROM met JOIN triples a ON a.doc_id = d1 AND a.triple_idx = i1 JOIN triples b ON b.doc_id = d2 AND b.triple_idx = i2 JOIN compat c ON c.r1 = a.r AND c.r2 = b.r LEFT JOIN edges e ON e.src = least(a.s, b.s) AND e.dst = greatest(a.s, b.s)),
inter AS (SELECT src, dst, sum(w) AS inter_raw FROM (SELECT least(s1, o1) AS src, greatest(s1, o1) AS dst, w FROM crossed WHERE w > 0.11 UNION ALL SELECT least(s2, o2), greatest(s2, o2), w FROM crossed WHERE w > 0.11) GROUP BY 1, 2)"""
BASE = f"WITH {GEO}, triples AS (SELECT * FROM geo), names AS (SELECT DISTINCT r FROM triples), {COMPAT}, {EDGES}, {INTRA}, {INTER}, raw AS (SELECT e.src, e.dst, relation, coalesce(intra_raw, 0.0) AS intra_raw, coalesce(inter_raw, 0.0) AS inter_raw FROM edges e LEFT JOIN intra USING (src, dst) LEFT JOIN inter USING (src, dst))"


def _norm(value: str) -> str:
    return f"""{BASE}, ents AS (SELECT DISTINCT doc_id, unnest([s, o]) AS entity FROM triples),
touch AS (SELECT DISTINCT doc_id, src, dst, intra_raw, inter_raw FROM raw JOIN ents ON entity = src OR entity = dst),
params AS (SELECT doc_id, {', '.join(f"min(CASE WHEN {k}_raw > 0 THEN {k}_raw END) AS {k}_min, max(CASE WHEN {k}_raw > 0 THEN {k}_raw END) AS {k}_max, avg(CASE WHEN {k}_raw > 0 THEN {k}_raw END) AS {k}_mean, stddev_pop(CASE WHEN {k}_raw > 0 THEN {k}_raw END) AS {k}_std" for k in ("intra", "inter"))} FROM touch GROUP BY 1),
means AS (SELECT src, dst, {', '.join(f"avg(CASE WHEN {k}_raw > 0 THEN {value.replace('#', k)} END) AS {k}_normalized" for k in ("intra", "inter"))} FROM touch JOIN params USING (doc_id) GROUP BY 1, 2),
done AS (SELECT src, dst, relation, coalesce(intra_normalized, intra_raw) AS intra_normalized, coalesce(inter_normalized, inter_raw) AS inter_normalized FROM raw LEFT JOIN means USING (src, dst))
SELECT src, dst, relation, round(intra_normalized, 5) AS intra_normalized, round(inter_normalized, 5) AS inter_normalized, round(least(1.0, intra_normalized * 0.7 + inter_normalized * 0.3), 5) AS weight FROM done"""


MINMAX = "(CASE WHEN #_max - #_min < 1e-9 THEN 0.5 ELSE greatest(0.0, least(1.0, (#_raw - #_min) / (#_max - #_min))) END)"
ZSCORE = "(1 / (1 + exp(-(#_raw - #_mean) / CASE WHEN #_std > 0 THEN #_std ELSE 1.0 END)))"


@query("edge_raw", f"{BASE} SELECT src, dst, relation, round(intra_raw, 5) AS intra_raw, round(inter_raw, 5) AS inter_raw FROM raw")
def _raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighting.raw_edges(geo_triples(spark, sf_dir)).select("src", "dst", "relation", F.round("intra_raw", 5).alias("intra_raw"), F.round("inter_raw", 5).alias("inter_raw"))


def _weighted(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    edges = weighting.weighted_graph(geo_triples(spark, sf_dir), method)
    return edges.select("src", "dst", "relation", *[F.round(c, 5).alias(c) for c in ("intra_normalized", "inter_normalized", "weight")])


@query("edge_weight_minmax", _norm(MINMAX))
def _minmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir, "minmax")


@query("edge_weight_zscore", _norm(ZSCORE))
def _zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir, "zscore")


@query("intra_raw_orders", f"WITH {BRAND}, triples AS (SELECT * FROM brand), names AS (SELECT DISTINCT r FROM triples), {COMPAT}, {INTRA} SELECT src, dst, round(intra_raw, 5) AS intra_raw FROM intra")
def _intra_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = _tasks(table(spark, sf_dir, "lineitem"))
    return weighting.intra_raw(brand_triples(spark, sf_dir), tasks).where("intra_raw > 1e-9").select("src", "dst", F.round("intra_raw", 5).alias("intra_raw"))


@query("intra_pair_weight", f"""WITH {BRAND}, seen AS (SELECT doc_id, s AS e1, o AS e2, r, 1 AS f FROM brand WHERE s <> o UNION ALL SELECT doc_id, o, s, r, 0 FROM brand WHERE s <> o),
g AS (SELECT doc_id, e1, e2, count(*) AS n, count(DISTINCT r) AS kinds, sum(f) AS ahead FROM seen GROUP BY 1, 2, 3)
SELECT doc_id, e1, e2, round(least(n / 5.0, 1.0) * 0.5 + (least(kinds * 0.2, 0.6) * 0.5 + (CASE WHEN 2 * ahead > n THEN ahead / n ELSE 0.7 END) * 0.5) * 0.4, 6)::DOUBLE AS weight FROM g""")
def _intra_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighting.intra_pair_weight(brand_triples(spark, sf_dir)).withColumn("weight", F.round("weight", 6))


@query("bridge_entities", f"WITH {BRAND} SELECT entity, count(DISTINCT doc_id) AS docs FROM (SELECT doc_id, unnest([s, o]) AS entity FROM brand) GROUP BY 1 HAVING count(DISTINCT doc_id) > 2")
def _bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighting.bridge_entities(brand_triples(spark, sf_dir))


@query("doc_links", """WITH e AS (SELECT DISTINCT o_custkey AS doc_id, unnest(['order_' || o_orderkey, 'part_' || l_partkey]) AS entity FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT a.doc_id AS d1, b.doc_id AS d2, count(*) AS shared FROM e a JOIN e b ON a.entity = b.entity AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING count(*) > 2""")
def _doc_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as documents, linked by the parts that they have ordered."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    name = lambda kind, key: F.concat(F.lit(f"{kind}_"), F.col(key).cast("string"))
    return weighting.doc_links(rows.select(F.col("o_custkey").alias("doc_id"), name("order", "o_orderkey").alias("s"), name("part", "l_partkey").alias("o")))


@query("degree_centrality", f"WITH {BRAND}, triples AS (SELECT * FROM brand), {EDGES}, d AS (SELECT node, count(*) AS degree FROM (SELECT unnest([src, dst]) AS node FROM edges) GROUP BY 1) SELECT node, degree, round(degree / ((SELECT count(*) FROM d) - 1), 9) AS centrality FROM d")
def _centrality(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = weighting.edge_list(brand_triples(spark, sf_dir))
    return weighting.degree_centrality(edges).withColumn("centrality", F.round("centrality", 9))


@query("triple_union", f"WITH {GEO}, {BRAND} SELECT s, r, o FROM geo UNION SELECT s, r, o FROM brand")
def _union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo_triples(spark, sf_dir).union(brand_triples(spark, sf_dir)).select("s", "r", "o").distinct()


# --- linking ----------------------------------------------------------------------------------
VARIANTS = """v AS (SELECT DISTINCT p_brand AS b, unnest([p_name, replace(p_name, ' ', '-'), upper(replace(p_name, ' ', '_'))]) AS entity FROM part),
linked AS (SELECT row_number() OVER (ORDER BY b, entity) AS seq, least(b, entity) AS src, greatest(b, entity) AS dst, CASE WHEN entity = upper(entity) THEN 'shouts' ELSE 'names' END AS relation, 1.0::DOUBLE AS weight FROM v)"""
CANON = f"""{VARIANTS}, names AS (SELECT DISTINCT entity, replace(replace(replace(lower(entity), '-', ''), '_', ''), ' ', '') AS cluster FROM v),
clusters AS (SELECT * FROM names WHERE cluster IN (SELECT cluster FROM names GROUP BY 1 HAVING count(*) > 1)),
deg AS (SELECT node, count(*) AS degree FROM (SELECT unnest([src, dst]) AS node FROM linked) GROUP BY 1),
canon AS (SELECT entity AS old, first_value(entity) OVER (PARTITION BY cluster ORDER BY coalesce(degree, 0) * 10 + length(entity) DESC, entity) AS canonical FROM clusters LEFT JOIN deg ON node = entity)"""


def _variant_edges(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    name = F.col("p_name")
    v = part.select(F.col("p_brand").alias("b"), F.explode(F.array(name, F.replace(name, F.lit(" "), F.lit("-")), F.upper(F.replace(name, F.lit(" "), F.lit("_"))))).alias("entity")).distinct()
    kind = F.when(F.col("entity") == F.upper("entity"), "shouts").otherwise("names")
    return v, v.select(F.struct("b", "entity").alias("seq"), F.least("b", "entity").alias("src"), F.greatest("b", "entity").alias("dst"), kind.alias("relation"), F.lit(1.0).alias("weight"))


def _names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    v, edges = _variant_edges(spark, sf_dir)
    return edges, linking.canonical_names(linking.string_clusters(v.select("entity")), weighting.degrees(edges))


@query("canonical_names", f"WITH {CANON} SELECT * FROM canon")
def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir)[1]


@query("merged_edges", f"""WITH {CANON}, m AS (SELECT seq, coalesce(a.canonical, src) AS x, coalesce(b.canonical, dst) AS y, relation, weight FROM linked LEFT JOIN canon a ON a.old = src LEFT JOIN canon b ON b.old = dst)
SELECT least(x, y) AS src, greatest(x, y) AS dst, sum(weight) AS weight, arg_min(relation, seq) AS relation, count(DISTINCT relation)::INT AS kinds FROM m WHERE x <> y GROUP BY 1, 2""")
def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, names = _names(spark, sf_dir)
    return linking.merged_edges(edges, names).select("src", "dst", "weight", "relation", F.size("relation_types").alias("kinds"))


@query("renamed_triples", f"WITH {CANON} SELECT seq AS triple_idx, coalesce(c.canonical, l.src) AS s, l.relation AS r, coalesce(d.canonical, l.dst) AS o FROM linked l LEFT JOIN canon c ON c.old = l.src LEFT JOIN canon d ON d.old = l.dst WHERE coalesce(c.canonical, l.src) <> coalesce(d.canonical, l.dst)".replace("seq AS triple_idx, ", ""))
def _renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, names = _names(spark, sf_dir)
    return linking.renamed_triples(edges.select(F.col("src").alias("s"), F.col("relation").alias("r"), F.col("dst").alias("o")), names)


# --- paths ------------------------------------------------------------------------------------
PATHS = "chains AS (SELECT [c_name, n_name, r_name] AS p, c_acctbal::DOUBLE AS distance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"


def chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    rows = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select(fn.path_nodes(F.concat_ws(" -> ", "c_name", "n_name", "r_name")).alias("path"), F.col("c_acctbal").cast("double").alias("distance"))


@query("path_node_stats", f"WITH {PATHS} SELECT node, count(*) AS path_frequency, round(avg(distance), 4) AS avg_path_distance FROM (SELECT unnest(p) AS node, distance FROM chains) GROUP BY 1")
def _node_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.node_stats(chains(spark, sf_dir)).withColumn("avg_path_distance", F.round("avg_path_distance", 4))


@query("path_edge_support", f"WITH {PATHS}, e AS (SELECT p[1] AS a, p[2] AS b FROM chains UNION ALL SELECT p[2], p[3] FROM chains) SELECT least(a, b) AS src, greatest(a, b) AS dst, count(*) AS path_support FROM e GROUP BY 1, 2")
def _edge_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.edge_support(chains(spark, sf_dir)).select("src", "dst", "path_support")


def _search(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The weighted graph, one start for each region, and similarities of node names to the start's."""
    edges = weighting.weighted_graph(geo_triples(spark, sf_dir))
    starts = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("query_id"), F.col("r_name").alias("start"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("emb", vf.hashing_embedding(F.col("node")))
    asked = starts.withColumn("q", vf.hashing_embedding(F.col("start")))
    return edges, starts, nodes.join(F.broadcast(asked), F.lit(True)).select("query_id", "node", vf.dot(F.col("q"), F.col("emb")).alias("sim"))


@query("beam_paths")
def _beam(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges, starts, sims = _search(spark, sf_dir)
    return paths.beam_paths(edges, starts, sims).withColumn("score", F.round("score", 6))


@query("multihop_query")
def _multihop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.answers(paths.multi_hop(*_search(spark, sf_dir)))


# --- questions --------------------------------------------------------------------------------
ASKED_CHUNKS = """nodes AS (SELECT n_name AS node, ['chunk_' || n_nationkey, 'chunk_r' || n_regionkey] AS chunk_ids FROM nation UNION ALL SELECT r_name, [] FROM region),
asked AS (SELECT n_nationkey AS query_id, n_name AS chunk_id FROM nation UNION SELECT n_nationkey, 'chunk_' || n_nationkey FROM nation UNION SELECT n_nationkey + 100, 'chunk_r' || n_regionkey FROM nation
  UNION SELECT n_nationkey + 200, 'doc_' || lower(n_name) || '_chunk3' FROM nation UNION SELECT n_nationkey + 300, lower(substr(n_name, 2, 5)) FROM nation UNION SELECT n_nationkey + 400, lower(substr(n_name, 1, 3)) FROM nation)"""


@query("chunk_nodes", f"""WITH {ASKED_CHUNKS} SELECT DISTINCT query_id, node FROM asked JOIN nodes ON CASE WHEN chunk_id IN (SELECT node FROM nodes) THEN chunk_id = node
  ELSE list_contains(chunk_ids, chunk_id) OR (length(node) >= 5 AND contains(lower(chunk_id), lower(node))) OR (length(chunk_id) >= 5 AND contains(lower(node), lower(chunk_id))) END""")
def _chunk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk ids of all kinds, by name, list and part, resolved to the nodes of nations and regions."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key, name = F.col("n_nationkey").cast("long"), F.col("n_name")
    chunk = lambda prefix, c: F.concat(F.lit(f"chunk_{prefix}"), F.col(c).cast("string"))
    nodes = nation.select(name.alias("node"), F.array(chunk("", "n_nationkey"), chunk("r", "n_regionkey")).alias("chunk_ids")).union(region.select("r_name", F.array().cast("array<string>")))
    kinds = [(0, name), (0, chunk("", "n_nationkey")), (100, chunk("r", "n_regionkey")), (200, F.concat(F.lit("doc_"), F.lower(name), F.lit("_chunk3"))), (300, F.lower(F.substring(name, 2, 5))), (400, F.lower(F.substring(name, 1, 3)))]
    asked = nation.select(F.explode(F.array(*[F.struct((key + n).alias("query_id"), c.alias("chunk_id")) for n, c in kinds])).alias("x")).select("x.*")
    return questions.nodes_of_chunks(asked, nodes)


def question_set(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    """Questions about each region, the weighted graph, its nodes, and a retrieval store of a text for each nation with its mapping."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    asked = region.select(F.col("r_regionkey").cast("long").alias("query_id"), F.format_string("Which nations are part of %s?", "r_name").alias("question"))
    docs = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").cast("long").alias("doc_id"), "n_name", F.format_string("%s is one of the nations that are part of %s.", "n_name", "r_name").alias("text"))
    chunks = cut_lineage(chunking.dual_chunks(docs.drop("n_name")), "chunks")
    store = retrieval.build_store(chunks.where("chunk_type = 'semantic'"))
    edges = weighting.weighted_graph(geo_triples(spark, sf_dir))
    held = chunks.where("chunk_type = 'structural'").join(docs.select("doc_id", "n_name"), "doc_id").select(F.col("n_name").alias("node"), "chunk_id")
    names = edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    nodes = cut_lineage(names.join(held.groupBy("node").agg(F.collect_set("chunk_id").alias("chunk_ids")), "node", "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<string>"))), "nodes")
    return asked, cut_lineage(edges, "graph"), nodes, store, chunking.overlapping(chunks)


@query("question_entities")
def _question_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nodes of the graph most like each question."""
    asked, _, nodes, _, _ = question_set(spark, sf_dir)
    return questions.nodes_for_questions(asked, nodes)


@query("answered_questions")
def _answered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From question to answer, over all of the graph and the store."""
    return questions.answer(*question_set(spark, sf_dir)).select("query_id", "question", "answer", "documents", F.round("confidence", 6).alias("confidence"))


@query("sample_questions")
def _sample_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.sample_questions(table(spark, sf_dir, "documents"), weighting.weighted_graph(geo_triples(spark, sf_dir)), 30)


@query("precomputed_paths")
def _precomputed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of sample questions, merged into the graph as support of its edges."""
    _, edges, nodes, _, _ = question_set(spark, sf_dir)
    found = questions.precomputed_paths(table(spark, sf_dir, "documents"), edges, nodes)
    return paths.merge_paths(edges, found).where("path_support > 0").select("src", "dst", "relation", "path_support")


# --- vectors ----------------------------------------------------------------------------------
UNIT = "u AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings)"


@query("vector_pairs_threshold", f"WITH {UNIT} SELECT a.vec_id AS a, b.vec_id AS b, round(list_inner_product(a.e, b.e), 6) AS similarity FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_inner_product(a.e, b.e) >= 0.4")
def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.similar_pairs(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb")), 0.4).withColumn("similarity", F.round("similarity", 6))


@query("vector_components", f"""WITH RECURSIVE {UNIT}, l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id WHERE list_inner_product(a.e, b.e) >= 0.4),
reach(node, low) AS (SELECT a, a FROM l UNION SELECT l.b, low FROM reach JOIN l ON l.a = node) SELECT node AS id, min(low) AS component FROM reach GROUP BY 1""")
def _components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.embedding_clusters(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("emb")), 0.4)


@query("vector_topk", f"WITH {UNIT}, q AS (SELECT label, list(m ORDER BY i) AS c FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(e) AS x, unnest(range(len(e))) AS i FROM u) GROUP BY 1, 2) GROUP BY 1), s AS (SELECT q.label AS query_label, vec_id, list_inner_product(c, e) AS score FROM q, u) SELECT query_label, vec_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_label ORDER BY round(score, 9) DESC, vec_id) AS k FROM s) WHERE k <= 5")
def _topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five vectors nearest to each label's centroid; centroids are a row a label."""
    unit = table(spark, sf_dir, "embeddings").select("vec_id", "label", vf.l2_normalize(F.col("embedding")).alias("emb"))
    means = unit.select("label", F.posexplode("emb").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("m"))
    centroids = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x["m"]).alias("q")).withColumnRenamed("label", "query_label")
    return retrieval.top_k(unit, centroids, 5).select("query_label", "vec_id", F.round("score", 6).alias("score"))
