"""Compatibility of relation names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Pairs of relations that are each other's inverse.
INVERSE = (
    ("cause_of", "caused_by"), ("cause_of", "effect_of"), ("part_of", "has_part"), ("component_of", "has_component"), ("parent_of", "child_of"),
    ("author_of", "written_by"), ("owns", "owned_by"), ("manages", "managed_by"), ("teaches", "taught_by"), ("supervises", "supervised_by"),
)
# Groups of related relations.
GROUPS = {
    "cause": (
        "cause_of", "caused_by", "leads_to", "results_in", "triggers", "produces", "generates", "effect_of",
    ),
    "part": (
        "part_of", "has_part", "component_of", "has_component", "contains", "includes", "consists_of", "comprises",
    ),
    "membership": (
        "member_of", "has_member", "belongs_to", "works_at", "employed_by", "affiliated_with",
    ),
    "time": (
        "before", "after", "during", "precedes", "follows", "happens_before", "happens_after",
    ),
    "place": (
        "located_in", "location_of", "near", "adjacent_to", "contains", "inside", "outside",
    ),
    "kind": (
        "is_a", "type_of", "instance_of", "has_property", "characterized_by", "defined_by",
    ),
    "interaction": (
        "interacts_with", "collaborates_with", "competes_with", "influences", "affected_by",
    ),
}
# Categories of verbs.
CATEGORIES = {
    "action": (
        "creates", "builds", "develops", "produces", "makes", "constructs", "designs", "implements", "generates", "enables", "powers", "leverages",
        "accelerates", "utilizes", "parameterizes", "fine_tunes", "approximates", "encodes", "regularizes", "iterates", "optimizes", "traverses",
        "samples", "augments", "normalizes", "quantizes", "distills", "ensembles", "prunes", "compresses", "aggregates", "fuses", "aligns",
        "projects", "embeds", "transforms", "adapts", "detects", "segments", "classifies", "recognizes", "extracts", "filters", "convolves", "pools",
        "tokenizes", "parses", "generates_text", "translates", "attends_to", "masks", "predicts", "propagates", "aggregates_neighbors", "diffuses",
        "clusters", "partitions", "samples_neighbors",
    ),
    "state": (
        "is", "has", "contains", "includes", "comprises", "exists", "represents", "defines", "consists_of", "maintains", "preserves", "exhibits",
        "displays",
    ),
    "relation": (
        "relates_to", "associated_with", "connected_to", "linked_to", "corresponds_to", "depends_on", "derived_from", "based_on", "inspired_by",
    ),
    "computation": (
        "computes", "calculates", "evaluates", "measures", "estimates", "infers", "learns", "trains", "updates", "backpropagates", "forward_passes",
    ),
    "comparison": (
        "outperforms", "surpasses", "exceeds", "improves_upon", "compares_to", "contrasts_with", "benchmarks_against",
    ),
}
SAME, INVERSES, RELATED, SAME_KIND, OTHER = 1.0, 0.9, 0.7, 0.5, 0.3


def normalized(r: Column) -> Column:
    return F.replace(F.lower(r), F.lit("-"), F.lit("_"))


def _mask(r: Column, sets: list[tuple[str, ...]]) -> Column:
    """A bit for each set that holds the relation."""
    bits = [F.when(r.isin(*names), 1 << i).otherwise(0) for i, names in enumerate(sets)]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def tags(r: Column) -> Column:
    """All that compatibility needs of a relation: name, and bits of its inverse pairs by side, groups and categories. Taken once a row, they make pairs cheap."""
    n = normalized(r)
    first, second = ([(pair[i],) for pair in INVERSE] for i in (0, 1))
    groups, kinds = (list(sets.values()) for sets in (GROUPS, CATEGORIES))
    return F.struct(n.alias("name"), _mask(n, first).alias("first"), _mask(n, second).alias("second"), _mask(n, groups).alias("groups"), _mask(n, kinds).alias("kinds"))


def bits(name: str) -> tuple[int, int, int, int]:
    """The bits of ``tags`` for one normalized name, in Python."""
    mask = lambda sets: sum(1 << i for i, names in enumerate(sets) if name in names)
    return mask([(pair[0],) for pair in INVERSE]), mask([(pair[1],) for pair in INVERSE]), mask(GROUPS.values()), mask(CATEGORIES.values())


def bits_compatible(a: tuple[int, int, int, int], b: tuple[int, int, int, int]) -> float:
    """``compatible`` of two relations of different names, in Python."""
    if a[0] & b[1] or a[1] & b[0]:
        return INVERSES
    return RELATED if a[2] & b[2] else SAME_KIND if a[3] & b[3] else OTHER


def compatible(a: Column, b: Column, similarity: Column | None = None) -> Column:
    """Compatibility of two relations by their tags."""
    meet = lambda x, y: a[x].bitwiseAND(b[y]) != 0
    rest = F.lit(OTHER) if similarity is None else F.greatest(F.lit(OTHER), F.coalesce(similarity, F.lit(OTHER)))
    found = F.when(a["name"] == b["name"], SAME).when(meet("first", "second") | meet("second", "first"), INVERSES)
    return found.when(meet("groups", "groups"), RELATED).when(meet("kinds", "kinds"), SAME_KIND).otherwise(rest)


def compatibility(a: Column, b: Column, similarity: Column | None = None) -> Column:
    """Same, inverse, related, of one kind of verb, or else ``similarity``, 0.3 at least."""
    return compatible(tags(a), tags(b), similarity)


def compatibility_table(relations: DataFrame, column: str = "r") -> DataFrame:
    """Every pair of the distinct relations: evaluated once for each pair of names, not for each pair of rows. The vocabulary is small and bounded by the schema of relations."""
    names = relations.select(F.col(column).alias("r1")).distinct().withColumn("t1", tags(F.col("r1")))
    return names.join(names.toDF("r2", "t2"), F.lit(True)).select("r1", "r2", compatible(F.col("t1"), F.col("t2")).alias("compat"))
