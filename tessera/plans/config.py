"""Settings of a graph build, with presets and checks."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields, replace


@dataclass(frozen=True)
class Settings:
    entity_linking_threshold: float = 0.88
    retrieval_chunk_size: int = 320
    retrieval_chunk_overlap: int = 120
    graph_chunk_size: int = 512
    graph_chunk_overlap: int = 50
    relation_compat_threshold: float = 0.11
    final_weight_cutoff: float = 0.035
    max_triplets_per_chunk: int = 15
    quality_threshold: float = 0.3
    quality_mode: str = "penalty"
    normalize: str = "minmax"
    top_entities: int = 100
    least_support: int = 3

    def __post_init__(self) -> None:
        for name, (low, high) in RANGES.items():
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}")
        for kind in ("retrieval", "graph"):
            if getattr(self, f"{kind}_chunk_overlap") >= getattr(self, f"{kind}_chunk_size"):
                raise ValueError(f"{kind}_chunk_overlap must be smaller than the chunk")
        if self.quality_mode not in ("penalty", "weighted") or self.normalize not in ("minmax", "zscore", "none"):
            raise ValueError("unknown quality_mode or normalize")


RANGES = {"entity_linking_threshold": (0.0, 1.0), "relation_compat_threshold": (0.0, 1.0), "final_weight_cutoff": (0.0, 1.0), "quality_threshold": (0.0, 1.0), "retrieval_chunk_size": (1, 100_000), "graph_chunk_size": (1, 100_000), "retrieval_chunk_overlap": (0, 100_000), "graph_chunk_overlap": (0, 100_000), "max_triplets_per_chunk": (1, 1000)}
# The presets' linking threshold, relation threshold, weight cutoff and triples a chunk; chunk sizes are the same in all.
PRESETS = {
    name: Settings(entity_linking_threshold=linking, relation_compat_threshold=relation, final_weight_cutoff=cutoff, max_triplets_per_chunk=most)
    for name, linking, relation, cutoff, most in (
        ("general", 0.88, 0.11, 0.035, 15),
        ("strict_quality", 0.92, 0.13, 0.04, 12),
        ("high_coverage", 0.85, 0.09, 0.025, 18),
        ("cv", 0.90, 0.13, 0.04, 15),
        ("nlp", 0.87, 0.10, 0.03, 15),
        ("ml", 0.88, 0.12, 0.04, 15),
        ("graph", 0.89, 0.11, 0.035, 15),
        ("bio", 0.92, 0.09, 0.03, 15),
    )
}


# Sizes and overlaps in characters of retrieval and of graph chunks, by language.
CHUNKS_BY_LANGUAGE = {"en": ((320, 120), (512, 50)), "ja": ((200, 80), (350, 35))}


def settings(preset: str = "general", **changes: object) -> Settings:
    """A preset with changes; unknown names are refused."""
    known = {f.name for f in fields(Settings)}
    if unknown := set(changes) - known:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return replace(PRESETS[preset], **changes)


def merged(base: dict, override: dict) -> dict:
    """Nested dictionaries merged, the override's values first."""
    return base | {k: merged(base[k], v) if isinstance(v, dict) and isinstance(base.get(k), dict) else v for k, v in override.items()}


def as_dict(s: Settings) -> dict[str, object]:
    return asdict(s)
