"""Secret scans through a trigram inverted index.

A Boolean query over trigrams is derived from each rule's regular expression:
what every match must contain. Each Arrow batch of documents gets an inverted
index (a bitmap of documents for every trigram that some rule asks for); the
postings are intersected and united as the query says, and the rule's regular
expression verifies the candidates alone. A rule without mandatory trigrams
(the hex rule) verifies every document. Nothing is shuffled.

Cases: null and empty texts have no spans; very long texts are scanned whole;
repeated rows give repeated results; a null doc_id is kept; an empty table
gives an empty result; extra columns are ignored, or kept by ``redact``.
"""

from __future__ import annotations

import re
import re._parser as sre
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import doc_texts, slices, utf8

#: A query is True, a trigram, or ("and" | "or", parts).
Query = bool | str | tuple
MOST_STRINGS = 64


def all_of(parts: list[Query]) -> Query:
    parts = [x for x in dict.fromkeys(parts) if x is not True]
    return True if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def any_of(parts: list[Query]) -> Query:
    parts = list(dict.fromkeys(parts))
    return True if True in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def trigrams_of(strings: set[str]) -> Query:
    """What a text holds that holds one of the strings; trigrams are lower-case UTF-8 bytes as Latin-1."""
    folded = [x.encode().lower().decode("latin-1") for x in strings]
    return any_of([all_of([x[i : i + 3] for i in range(len(x) - 2)]) for x in sorted(folded)])


def _walk(tree: object) -> tuple[set[str] | None, Query]:
    """The strings a part can match, if they are few, and else what its matches contain."""
    run: set[str] | None = {""}  # strings that the parts since the last unknown one can spell
    needs: list[Query] = []
    only = True

    def flush() -> None:
        nonlocal run, only
        if run:
            needs.append(trigrams_of(run))
        run, only = {""}, False

    for kind, value in tree:
        strings, need = _one(kind, value)
        if strings is None:
            flush()
            needs.append(need)
        elif len(run) * len(strings) > MOST_STRINGS:
            flush()
            run = strings
        else:
            run = {a + b for a in run for b in strings}
    if only:
        return run, trigrams_of(run)
    flush()
    return None, all_of(needs)


def _one(kind: object, value: object) -> tuple[set[str] | None, Query]:
    if kind is sre.LITERAL:
        return {chr(value).lower()}, True
    if kind is sre.AT:
        return {""}, True
    if kind is sre.IN:
        chars: set[str] = set()
        for what, x in value:
            if what is sre.LITERAL:
                chars.add(chr(x).lower())
            elif what is sre.RANGE and x[1] - x[0] < 8:
                chars |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None, True
        return (chars, True) if len(chars) <= 8 else (None, True)
    if kind is sre.SUBPATTERN:
        return _walk(value[3])
    if kind is sre.BRANCH:
        found = [_walk(x) for x in value[1]]
        strings = set().union(*(x[0] or () for x in found))
        if all(x[0] is not None for x in found) and len(strings) <= MOST_STRINGS:
            return strings, True
        return None, any_of([x[1] for x in found])
    if kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
        least, most, inner = value
        strings, need = _walk(inner)
        if most == 1 and strings is not None and len(strings) < MOST_STRINGS:
            return (strings if least else strings | {""}), True
        return None, need if least else True
    return None, True


def trigram_query(pattern: str) -> Query:
    return _walk(sre.parse(pattern))[1]


@dataclass(frozen=True)
class Rule:
    """``least``: characters that ``group`` must have; shorter matches are dropped after matching."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    any_case: bool = False
    base: bool = False
    regex: re.Pattern = field(init=False)
    query: Query = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "regex", re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0)))
        object.__setattr__(self, "query", trigram_query(self.pattern))

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.regex.finditer(text) if m.end(self.group) - m.start(self.group) >= self.least]


#: The base rules, in the order of ties. A run of hex digits is matched from 24 on, which drops the same runs as matching all and dropping the shorter.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, any_case=True, base=True),
    Rule("access", r"AKIA[A-Z0-9]+", 20, base=True),
    Rule("hex", r"[0-9a-f]{24,}", base=True),
)
#: Formats of widely used credentials.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
RULES = BASE + MORE


class Index:
    """Bitmaps of the documents that hold each wanted trigram."""

    def __init__(self, queries: list[Query]) -> None:
        self.slots: dict[str, int] = {}

        def note(query: Query) -> None:
            if isinstance(query, str):
                self.slots.setdefault(query, len(self.slots))
            elif isinstance(query, tuple):
                for x in query[1]:
                    note(x)

        for query in queries:
            note(query)
        codes = np.array([int.from_bytes(x.encode("latin-1"), "big") for x in self.slots], np.int32)
        self.order = np.argsort(codes)
        self.codes = codes[self.order]
        self.ends = np.zeros(1 << 16, bool)  # the last two bytes of a wanted trigram
        self.ends[codes & 0xFFFF] = True

    def build(self, data: np.ndarray, offsets: np.ndarray, block: int = 1 << 19) -> None:
        self.docs = len(offsets) - 1
        self.postings = np.zeros((len(self.slots), self.docs), bool)
        for start in range(0, max(0, len(data) - 2), block):
            part = data[start : start + block + 2]
            part = np.where((part >= 65) & (part <= 90), part + 32, part).astype(np.int32)
            at = np.flatnonzero(self.ends[part[1:-1] << 8 | part[2:]])
            codes = part[at] << 16 | part[at + 1] << 8 | part[at + 2]
            place = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
            wanted = self.codes[place] == codes
            at, slots = at[wanted], self.order[place[wanted]]
            own = np.searchsorted(offsets, at + start, "right") - 1
            inside = at + start + 3 <= offsets[own + 1]  # not across two documents
            self.postings[slots[inside], own[inside]] = True

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.ones(self.docs, bool)
        if isinstance(query, str):
            return self.postings[self.slots[query]]
        return (np.logical_and if query[0] == "and" else np.logical_or).reduce([self.candidates(x) for x in query[1]])


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def found_spans(column: pa.Array, index: Index, rules: tuple[Rule, ...]) -> list[list[tuple[str, int, int]]]:
    """Spans of each text in code points, by start, then in the order of the rules."""
    index.build(*utf8(column))
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
    texts: dict[int, str] = {}
    for order, rule in enumerate(rules):
        for i in np.flatnonzero(index.candidates(rule.query)).tolist():
            if i not in texts:
                texts[i] = column[i].as_py()
            out[i] += [(start, order, end) for start, end in rule.spans(texts[i])]
    return [[(rules[order].kind, start, end) for start, order, end in sorted(x)] for x in out]


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def scan_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and the spans found, an array of (kind, start, end)."""

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([rule.query for rule in rules])
        for batch in slices(items):
            spans = found_spans(batch.column("text"), index, rules)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x] for x in spans], SPAN_ARROW)], names=["doc_id", "spans"])

    return doc_texts(docs).mapInArrow(run, T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("spans", T.ArrayType(SPAN))]))


def span_digests(spans: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""

    def text(which: Column) -> Column:
        return F.array_join(F.transform(which, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    kinds = [rule.kind for rule in BASE]
    of_kinds = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of_kinds(kind)).cast("long").alias(f"n_{kind}") for kind in kinds]
    return spans.select("doc_id", *counts, F.sha2(text(of_kinds(*kinds)).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, mask: str = "[SECRET]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents with every span replaced by ``mask``; overlapping spans count as one. Other columns stay; n_chars, if there, is counted anew."""
    schema = docs.schema
    place = schema.fieldNames().index("text")

    def run(items: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index([rule.query for rule in rules])
        for batch in slices(items, place):
            column = batch.column(place)
            texts: list[str | None] | None = None
            for i, spans in enumerate(found_spans(column.fill_null(""), index, rules)):
                if spans:
                    texts = texts or column.to_pylist()
                    parts, at = [], 0
                    for _, start, end in spans:
                        if start >= at:
                            parts += [texts[i][at:start], mask]
                        at = max(at, end)
                    texts[i] = "".join([*parts, texts[i][at:]])
            if texts:
                batch = pa.RecordBatch.from_arrays([pa.array(texts, column.type) if k == place else x for k, x in enumerate(batch.columns)], schema=batch.schema)
            yield batch

    out = docs.mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
