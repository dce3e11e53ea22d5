"""Calls of models: settings by task, retries, checks of texts and figures, embeddings of distinct strings."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as v


@dataclass(frozen=True)
class Task:
    temperature: float
    max_tokens: int
    model: str = "default"


# Temperature and tokens of each task.
TASKS = {"triplet": Task(0.3, 1024), "quality": Task(0.15, 768), "refiner": Task(0.7, 2048)}
MODES = ("api", "local")
Client = Callable[[str, Task], str]


@dataclass(frozen=True)
class Router:
    """Which client and settings serve a task. Immutable, so a query that has captured one isn't changed by a later switch."""

    clients: dict[str, Client]
    mode: str = "api"
    tasks: dict[str, Task] | None = None

    def __post_init__(self) -> None:
        if self.mode not in MODES or self.mode not in self.clients:
            raise ValueError(f"no client for mode {self.mode}")

    def settings(self, task: str) -> Task:
        return (self.tasks or TASKS)[task]

    def call(self, task: str, prompt: str) -> str:
        return self.clients[self.mode](prompt, self.settings(task))

    def switched(self, mode: str) -> Router:
        return replace(self, mode=mode)

    def updated(self, task: str, **changes: object) -> Router:
        return replace(self, tasks={**(self.tasks or TASKS), task: replace(self.settings(task), **changes)})

    def status(self) -> dict[str, object]:
        return {"mode": self.mode, "available": sorted(self.clients), "tasks": {k: vars(t) for k, t in (self.tasks or TASKS).items()}}


def with_retries(call: Callable[..., object], default: object = None, attempts: int = 3, wait: float = 1.0) -> Callable[..., object]:
    """The call, tried again after twice the wait each time; the default when all attempts fail."""

    def run(*args: object) -> object:
        for attempt in range(attempts):
            try:
                return call(*args)
            except Exception:  # whatever a remote model raises
                if attempt + 1 < attempts:
                    time.sleep(wait * 2**attempt)
        return default

    return run


def called(prompts: Column, call: Callable[[str], str | None], threads: int = 8) -> Column:
    """A call for each prompt, several at a time within an Arrow batch; calls of a remote model wait rather than work."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        with ThreadPoolExecutor(threads) as pool:
            for batch in batches:
                yield pd.Series(list(pool.map(lambda x: None if x is None else call(x), batch)), dtype="object")

    return run(prompts)


def issues_in(answer: Column) -> Column:
    """Names of the issues in a model's JSON answer {"issues": [{"type": ...}, ...] or names}; an unreadable answer has none."""
    body = F.regexp_extract(answer, "(?s)\\{.*\\}", 0)
    named = F.from_json(body, "issues array<struct<type:string>>")["issues"]
    plain = F.from_json(body, "issues array<string>")["issues"]
    of_named = F.filter(F.transform(named, lambda x: x["type"]), lambda x: x.isNotNull())
    return F.coalesce(F.when(F.size(of_named) > 0, of_named), F.filter(plain, lambda x: ~x.startswith("{")), F.array().cast("array<string>"))


def plain_check(text: str) -> str:
    """A deterministic stand-in for a model that checks texts."""
    found = []
    if text[:1].islower():
        found.append("missing_subject")
    if text.count("(") != text.count(")"):
        found.append("structural_damage")
    if "figure" in text.lower():
        found.append("missing_visual")
    return json.dumps({"issues": [{"type": name, "reason": ""} for name in found]})


def analysed_figures(figures: DataFrame, cache: DataFrame, see: Callable[[str, str], str]) -> tuple[DataFrame, DataFrame]:
    """Figures (figure_id, path, caption, image_hash) with a model's answer, and what the cache (image_hash, answer) lacked.

    A picture that the cache knows isn't sent again, and one that several figures show is sent once."""

    @F.pandas_udf("string")
    def look(path: pd.Series, caption: pd.Series) -> pd.Series:
        return pd.Series([see(*x) for x in zip(path, caption, strict=True)], dtype="object")

    unknown = figures.join(cache.select("image_hash"), "image_hash", "left_anti")
    first = unknown.groupBy("image_hash").agg(F.min(F.struct("path", "caption")).alias("x"))
    new = first.select("image_hash", look("x.path", F.coalesce("x.caption", F.lit(""))).alias("answer"))
    return figures.join(cache.select("image_hash", "answer").unionByName(new), "image_hash", "left"), new


def embedded_once(rows: DataFrame, column: str, embed: Callable[[Column], Column] = v.hashing_embedding, name: str = "emb") -> DataFrame:
    """Rows with the unit vector of a string column, each distinct string embedded once; where there is none, zeros of the same length."""
    known = rows.select(F.col(column).alias("_text")).where(F.col(column).isNotNull()).distinct().withColumn(name, embed(F.col("_text"))).withColumn(name, v.l2_normalize(F.col(name)))
    dims = F.coalesce(F.first(F.size(name), ignorenulls=True), F.lit(0))
    zeros = known.agg(F.array_repeat(F.lit(0.0), dims).alias("_zeros"))
    joined = rows.join(known, rows[column] == known["_text"], "left").drop("_text").join(F.broadcast(zeros), F.lit(True))  # one row
    return joined.withColumn(name, F.coalesce(name, "_zeros")).drop("_zeros")
