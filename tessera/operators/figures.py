"""Figures: alignment with chunks, parsing of model answers, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ANSWER = "type string, confidence double, summary string, key_values array<struct<label:string,value:string,metric:string>>, trend string"


def large_enough(figures: DataFrame, least: float = 50.0) -> DataFrame:
    return figures.where((F.col("bbox")[2] - F.col("bbox")[0] >= least) & (F.col("bbox")[3] - F.col("bbox")[1] >= least))


def captions(figures: DataFrame, lines: DataFrame, reach: float = 60.0, preview: int = 150) -> DataFrame:
    """figure_id and caption: the nearest line that starts like a caption within reach below a figure, else above it; else the first characters of the lines in reach.

    Figures (doc_id, figure_id, page, bbox) meet the lines (doc_id, page, y0, y1, text) of their page alone."""
    top, bottom = F.col("bbox")[1], F.col("bbox")[3]
    below, above = F.col("y0") - bottom, top - F.col("y1")
    met = figures.select("doc_id", "figure_id", "page", "bbox").join(lines, ["doc_id", "page"])
    side = F.when((below >= 0) & (below <= reach), 0).when((above >= 0) & (above <= reach), 1)
    met = met.withColumns({"side": side, "apart": F.when(side == 0, below).otherwise(above)}).where("side is not null")
    named = F.col("text").rlike("(?i)^\\s*(figure|fig\\.|table|tab\\.)")
    near = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y0", "text"))), lambda l: l["text"]), " ")  # a few lines of a page
    found = met.groupBy("figure_id").agg(F.min_by(F.when(named, F.col("text")), F.when(named, F.struct("side", "apart", "text"))).alias("caption"), near.alias("near"))
    out = figures.select("figure_id").join(found, "figure_id", "left")
    return out.select("figure_id", F.coalesce("caption", F.substring("near", 1, preview), F.lit("")).alias("caption"))


def aligned(figures: DataFrame, chunks: DataFrame, far: bool = True) -> DataFrame:
    """figure_id and chunk_id: on the page the chunk nearest by centre, or the first one; else the first on a page beside; else the first of the nearest page of the document.

    No figure meets the chunks one by one: the nearest centres above and below a place on a page
    are the neighbours in one sorted run of both, and a page stands for its chunks by its first
    one. Places and centres that occur often are put together first."""
    known = lambda y: F.when(~F.isnan(y), y)
    centre = lambda box: known((box[1] + box[3]) / 2)
    c = chunks.select("doc_id", "page", "chunk_id", "seq", centre(F.col("bbox")).alias("y"))
    f = figures.select("doc_id", "figure_id", "page", centre(F.col("bbox")).alias("y"))
    one = F.min(F.struct("seq", "chunk_id")).alias("one")
    centres = c.groupBy("doc_id", "page", "y").agg(one)
    pages = centres.groupBy("doc_id", "page").agg(F.min("one").alias("one"))
    spots = f.select("doc_id", "page", "y").distinct()
    # On the page: the run of centres and places, each place with the centre before and after it.
    both = centres.where("y is not null").select("doc_id", "page", "y", F.struct(F.col("y").alias("cy"), "one").alias("c")).unionByName(spots.where("y is not null"), allowMissingColumns=True)
    run = Window.partitionBy("doc_id", "page")
    so_far = lambda order: F.last("c", True).over(run.orderBy(order).rangeBetween(Window.unboundedPreceding, Window.currentRow))
    both = both.withColumns({"before": so_far(F.asc("y")), "after": so_far(F.desc("y"))}).where("c is null")
    near = lambda x: F.when(F.col(x).isNotNull(), F.struct(F.abs(F.col("y") - F.col(x)["cy"]).alias("apart"), F.col(x)["one"].alias("one")))
    nearest = both.select("doc_id", "page", "y", F.least(near("before"), near("after"))["one"].alias("nearest"))
    spots = spots.withColumn("key", F.coalesce("y", F.lit(float("nan"))))
    nearest = nearest.withColumn("key", F.col("y")).drop("y")
    at = spots.join(nearest, ["doc_id", "page", "key"], "left").join(pages, ["doc_id", "page"], "left")
    at = at.select("doc_id", "page", "key", F.coalesce("nearest", "one").alias("own"))
    beside = pages.select("doc_id", F.explode(F.array(F.col("page") - 1, F.col("page") + 1)).alias("page"), "one").groupBy("doc_id", "page").agg(F.min("one").alias("beside"))
    at = at.join(beside, ["doc_id", "page"], "left")
    best = lambda tier, c: F.when(F.col(c).isNotNull(), F.struct(F.lit(tier).alias("tier"), F.col(c).alias("one")))
    at = at.select("doc_id", "page", "key", F.coalesce(best(0, "own"), best(1, "beside")).alias("best"))
    f = f.select("doc_id", "figure_id", "page", F.coalesce("y", F.lit(float("nan"))).alias("key"))
    chosen = lambda rows: rows.groupBy("figure_id").agg(F.min("best")["one"]["chunk_id"].alias("chunk_id"))
    out = chosen(f.join(at.where("best is not null"), ["doc_id", "page", "key"]))
    if not far:
        return out
    rest = f.join(out, "figure_id", "left_anti").select("doc_id", "figure_id", "page")
    away = rest.select("doc_id", F.col("page").alias("at")).distinct().join(pages, "doc_id").groupBy("doc_id", "at").agg(F.min(F.struct(F.abs(F.col("page") - F.col("at")).alias("away"), "one")).alias("best"))
    return out.union(chosen(rest.join(away.withColumnRenamed("at", "page"), ["doc_id", "page"])))


def parse_answer(x: Column) -> Column:
    """The JSON object in a model's answer, with defaults; an unreadable one is 'unknown' with its first 200 characters."""
    body = F.from_json(F.regexp_extract(x, "(?s)\\{.*\\}", 0), ANSWER)
    read = body["type"].isNotNull() | body["summary"].isNotNull() | body["confidence"].isNotNull()
    return F.struct(
        F.coalesce(body["type"], F.lit("unknown")).alias("type"),
        F.coalesce(body["confidence"], F.when(read, 0.5).otherwise(0.0)).alias("confidence"),
        F.coalesce(body["summary"], F.when(read, "").otherwise(F.substring(x, 1, 200))).alias("summary"),
        F.coalesce(body["key_values"], F.array().cast("array<struct<label:string,value:string,metric:string>>")).alias("key_values"),
        body["trend"].alias("trend"),
    )


def relevant(figures: DataFrame) -> DataFrame:
    return figures.where("type <> 'irrelevant'")


def summary(figures: DataFrame) -> DataFrame:
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return figures.agg(F.count("*").alias("total"), one(F.col("status") == "processed").alias("processed"), one(F.col("status") == "failed").alias("failed"), one(F.col("type") == "chart").alias("chart_count"), one(F.col("type") == "irrelevant").alias("skipped"))


def links_to_known(links: DataFrame, chunks: DataFrame) -> DataFrame:
    """Links whose chunk exists."""
    return links.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_semi")
