"""Scores of (subject, relation, object) triples and parsers of model output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

# Relations and pronouns that say nothing.
BLACKLIST = ("is", "has", "are", "was", "were", "the", "a", "an", "of", "in", "on", "at")
PRONOUNS = ("it", "this", "that", "these", "those", "they", "them")
# Relations of high and of medium clarity.
HIGH = (
    "causes", "results_in", "leads_to", "enables", "triggers", "produces", "generates", "influences", "affects", "part_of", "component_of",
    "consists_of", "comprises", "contains", "includes", "uses", "utilizes", "employs", "applies", "leverages", "implements", "adopts", "based_on",
    "derived_from", "inspired_by", "extends", "improves_upon", "builds_on", "optimizes", "parameterizes", "regularizes", "approximates", "encodes",
    "decodes", "transforms", "projects", "outperforms", "surpasses", "exceeds", "improves",
)
MEDIUM = (
    "is_a", "type_of", "instance_of", "subclass_of", "related_to", "associated_with", "connected_to", "depends_on", "requires", "needs",
)
# Phrases that stand for a relation.
SYNONYMS = {
    "uses": ("use", "utilizes", "employs", "applies"),
    "causes": ("cause", "leads to", "results in", "triggers"),
    "part of": ("part of", "component of", "belongs to"),
    "is a": ("is a", "type of", "kind of", "instance of"),
    "has": ("have", "contains", "includes", "comprises"),
    "improves": ("improve", "enhances", "optimizes", "boosts"),
    "based on": ("based on", "derived from", "built on", "relies on"),
    "enables": ("enable", "allows", "permits", "facilitates"),
    "requires": ("require", "needs", "depends on", "necessitates"),
}
# Relations that contradict each other between the same two entities.
CONTRADICTIONS = (
    ("causes", "caused by"), ("creates", "created by"), ("produces", "produced by"), ("part of", "contains"), ("component of", "has component"), ("member of", "has member"),
    ("is", "is not"), ("has", "lacks"), ("enables", "prevents"), ("before", "after"), ("precedes", "follows"),
)


def _minus(*penalties: tuple[Column, float]) -> Column:
    return reduce(lambda total, x: total - F.when(x[0], x[1]).otherwise(0.0), penalties, F.lit(1.0))


def _clamped(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def _digits(x: Column) -> Column:
    return x.rlike("^\\p{Nd}+$")


def _no_alnum(x: Column) -> Column:
    return ~x.rlike("[\\p{L}\\p{N}]")


def quality_penalty(s: Column, r: Column, o: Column) -> Column:
    """1 less penalties for short, numeric, meaningless and repeated parts."""
    s, r, o = (stripped(F.lower(x)) for x in (s, r, o))
    short = (F.char_length(s) < 2) | (F.char_length(r) < 2) | (F.char_length(o) < 2)
    return _clamped(_minus((short, 0.4), (_digits(s) | _digits(o) | _no_alnum(s), 0.3), (r.isin(*BLACKLIST), 0.3), (s == o, 0.5), ((s == r) | (o == r), 0.3)))


def relation_clarity(r: Column) -> Column:
    r = stripped(F.lower(r))
    return F.when(r.isin(*BLACKLIST) | (F.char_length(r) < 2), 0.0).when(r.isin(*HIGH), 1.0).when(r.isin(*MEDIUM), 0.7).when(r.rlike("(s|ed|ing)$"), 0.6).otherwise(0.3)


def _specificity(x: Column) -> Column:
    x = stripped(F.lower(x))
    words = F.size(F.split(x, "(?U)\\s+"))
    return F.when((F.char_length(x) < 2) | x.isin(*PRONOUNS), 0.0).when(words >= 3, 1.0).when(words == 2, 0.8).otherwise(0.5)


def entity_specificity(s: Column, o: Column) -> Column:
    return (_specificity(s) + _specificity(o)) / 2


def _lower_case(x: Column) -> Column:
    return (x == F.lower(x)) & x.rlike("\\p{Ll}")


def grammar(s: Column, r: Column, o: Column) -> Column:
    low_s, low_o, low_r = F.lower(s), F.lower(o), stripped(F.lower(r))
    score = _minus(
        (_lower_case(s) & _lower_case(o), 0.2), (_digits(s) | _digits(o), 0.3), (_no_alnum(s) | _no_alnum(o), 0.5), (low_s == low_o, 0.5), (F.char_length(low_r) < 2, 0.4),
        (low_r.isin(*BLACKLIST), 0.3), (_no_alnum(r), 0.4), (low_s == low_r, 0.3), (low_o == low_r, 0.3), ((low_s == low_r) & (low_r == low_o), 0.5),
    )
    return F.greatest(score, F.lit(0.0))


def quality_weighted(s: Column, r: Column, o: Column) -> Column:
    return _clamped(0.4 * relation_clarity(r) + 0.3 * entity_specificity(s, o) + 0.3 * grammar(s, r, o))


def relation_synonyms(r: Column) -> Column:
    """Phrases for a relation: those of the first entry that it names or belongs to, or else itself."""
    phrase = F.replace(F.lower(r), F.lit("_"), F.lit(" "))
    found = F.lit(None).cast("array<string>")
    for key, phrases in reversed(SYNONYMS.items()):
        found = F.when(phrase.isin(key, *phrases), F.array(*map(F.lit, phrases))).otherwise(found)
    return F.coalesce(found, F.array(phrase))


def context_alignment(s: Column, r: Column, o: Column, text: Column) -> Column:
    """How well a text supports a triple, 0 to 1."""
    text, s, o, phrase = F.lower(text), F.lower(s), F.lower(o), F.replace(F.lower(r), F.lit("_"), F.lit(" "))
    has_s, has_o = F.contains(text, s), F.contains(text, o)
    entities = F.when(has_s & has_o, 0.5).when(has_s | has_o, 0.3).otherwise(0.1)
    relation = F.when(F.contains(text, phrase), 0.3).when(F.exists(relation_synonyms(r), lambda x: F.contains(text, x)), 0.2).otherwise(0.0)
    apart = F.abs(F.position(o, text) - F.position(s, text))
    near = F.when(has_s & has_o, F.when(apart < 50, 0.2).when(apart < 100, 0.1).otherwise(0.0)).otherwise(0.0)
    return F.least(entities + relation + near, F.lit(1.0))


def critic_confidence(s: Column, r: Column, o: Column, text: Column) -> Column:
    return 0.3 * entity_specificity(s, o) + 0.3 * relation_clarity(r) + 0.2 * grammar(s, r, o) + 0.2 * context_alignment(s, r, o, text)


def _triple_array(s: Column, r: Column, o: Column) -> Column:
    return F.transform(F.arrays_zip(s.alias("s"), r.alias("r"), o.alias("o")), lambda x: F.struct(stripped(x["s"]).alias("s"), stripped(x["r"]).alias("r"), stripped(x["o"]).alias("o")))


def parse_tuples(x: Column) -> Column:
    """Triples written as (subject, relation, object)."""
    pattern = F.lit("\\(([^,]+),\\s*([^,]+),\\s*([^)]+)\\)")
    return _triple_array(*[F.regexp_extract_all(x, pattern, F.lit(i)) for i in (1, 2, 3)])


def parse_json_triples(x: Column) -> Column:
    """Triples written as a JSON list of three-element lists, maybe fenced; others are dropped."""
    body = F.regexp_replace(x, "(?s)^\\s*```(?:json)?\\s*|\\s*```\\s*$", "")
    rows = F.filter(F.from_json(body, "array<array<string>>"), lambda t: F.size(t) == 3)
    return F.transform(rows, lambda t: F.struct(stripped(t[0]).alias("s"), stripped(t[1]).alias("r"), stripped(t[2]).alias("o")))


def parse_refined(x: Column) -> Column:
    """A triple in lines Subject:, Relation:, Object:, or null."""
    part = lambda name: stripped(F.regexp_extract(x, f"(?m)^\\s*{name}:\\s*(.*)$", 1))
    s, r, o = part("Subject"), part("Relation"), part("Object")
    return F.when((F.char_length(s) > 1) & (F.char_length(r) > 1) & (F.char_length(o) > 1), F.struct(s.alias("s"), r.alias("r"), o.alias("o")))
