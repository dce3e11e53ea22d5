"""Document quality: issues, severity, routing."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as fn
from tessera.functions import vectors as v

from . import models

# Issues of high and of medium severity.
HIGH = ("missing_subject", "contradiction", "structural_damage")
MEDIUM = ("missing_visual",)
FIGURE_WORDS = "(?i)(figure|fig\\.|table|tab\\.)\\s*\\d+|[図表]\\s*\\d+"


def line_count(x: Column) -> Column:
    return F.size(F.filter(F.split(x, "\n"), lambda line: fn.stripped(line) != ""))


def issues(text: Column, embedding: Column | None = None, repeats: Column | None = None) -> Column:
    """Names of what is wrong with a text, with the test of an embedding's norm and of whether lines repeat, if they are known."""
    empty = F.coalesce(fn.stripped(text), F.lit("")) == ""
    found = [F.when(empty, "empty")]
    if embedding is not None:
        found.append(F.when(~empty & (v.norm(embedding) / 0.5 < 0.6), "too_abstract"))
    found.append(F.when(~empty & (line_count(text) < 3), "too_short"))
    if repeats is not None:
        found.append(F.when(~empty & repeats, "potential_contradiction"))
    return F.array_compact(F.array(*found))


def repeats_lines(text: Column, lines: int = 5, threshold: float = 0.98) -> Column:
    """Whether neighbours among the first lines are almost the same, by the hashing embedding."""

    @F.pandas_udf("boolean")
    def run(texts: pd.Series) -> pd.Series:
        heads = [[line.strip() for line in (value or "").split("\n") if line.strip()][:lines] for value in texts]
        of = np.repeat(np.arange(len(heads)), [len(head) for head in heads])
        vectors = v.embedded_all([line for head in heads for line in head])
        alike = (vectors[1:] * vectors[:-1]).sum(1) > threshold
        return pd.Series(np.isin(np.arange(len(heads)), of[1:][alike & (of[1:] == of[:-1])]), index=texts.index)

    return run(text)


def severity(found: Column) -> Column:
    has = lambda names: F.arrays_overlap(found, F.array(*map(F.lit, names)))
    return F.when(has(HIGH), "high").when(has(MEDIUM), "medium").otherwise("low")


def has_figure_context(text: Column) -> Column:
    return text.rlike(FIGURE_WORDS)


def needs_model_check(text: Column) -> Column:
    """Marker words, many Japanese sentences or many commas."""
    return text.rlike("(?i)\\b(however|therefore|moreover)\\b") | (F.regexp_count(text, F.lit("。")) > 10) | (F.regexp_count(text, F.lit("[,、]")) > 20)


def routed(docs: DataFrame, embed: Callable[[Column], Column] | None = None, check: Callable[[str], str] | None = None) -> DataFrame:
    """Documents with issues, severity and where they go.

    ``embed`` adds the tests that need an embedding. ``check``, a model that answers in JSON, is
    asked about documents that have an issue already, and adds its own."""
    text = F.col("text")
    if embed is None:
        out = docs.withColumn("issues", issues(text))
    else:
        out = docs.withColumns({"_emb": embed(text), "_repeats": repeats_lines(text)}).withColumn("issues", issues(text, F.col("_emb"), F.col("_repeats"))).drop("_emb", "_repeats")
    if check is not None:
        out = out.withColumn("_said", models.called(F.when(F.size("issues") > 0, text), models.with_retries(check)))
        out = out.withColumn("issues", F.array_distinct(F.concat("issues", models.issues_in(F.col("_said"))))).drop("_said")
    return out.withColumns({"severity": severity(F.col("issues")), "route": F.when(F.size("issues") == 0, "clean").otherwise("flagged")})


def review_queue(docs: DataFrame) -> DataFrame:
    flagged = routed(docs).where("route = 'flagged'")
    return flagged.select("doc_id", "severity", F.concat_ws(", ", "issues").alias("issues"), F.concat(F.substring("text", 1, 100), F.lit("...")).alias("preview"))
