"""Every threshold of the operators in one place."""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class Options:
    # fixed values: defaults that results depend on
    max_hops: int = 5
    max_fanout: int | None = 20
    file_cap: int = 5_000
    work_budget: int = 7_000_000
    least_files: int = 12
    edge_budget: int | None = None
    focus_boost: float = 10.0
    private_mult: float = 0.1
    well_named_length: int = 8
    well_named_mult: float = 10.0
    common_threshold: int = 5
    common_mult: float = 0.1
    confidence_high: float = 1.0
    confidence_low: float = 0.25
    damping: float = 0.85
    max_rounds: int = 100
    tolerance: float = 1e-6
    tokens_per_symbol: int = 12
    token_budget: int = 2_000
    winnow_k: int = 5
    winnow_w: int = 4
    min_nodes: int = 15
    min_similarity: float = 0.8
    flood_df: int = 50
    min_shared: int = 3
    weight_duplicate: float = 0.30
    weight_cognitive: float = 0.30
    weight_bloat: float = 0.25
    bloat_range: tuple[float, float] = (80.0, 200.0)
    cognitive_range: tuple[float, float] = (8.0, 25.0)
    markers: tuple[str, ...] = ("TODO", "FIXME", "HACK", "XXX", "BUG", "NOTE")
    coverage_kinds: tuple[str, ...] = ("function", "class", "method", "interface")
    language_sample: int = 1_000
    language_ratio: float = 0.6
    candidate_files: int = 400
    output_budget: int = 40
    debounce_ms: int = 2_000
    idle_ttl_s: int = 10_800
    quota_bytes: int = 10 << 30
    quota_ratio: float = 0.9
    missing_days: int = 30
    idle_days: int = 14
    #: Kinds that references can point at.
    referenceable: tuple[str, ...] = field(default=("function", "class", "method", "interface", "type", "enum", "struct", "trait", "variable", "constructor", "property", "module", "protocol"))

    def __post_init__(self) -> None:
        if not 0.0 <= self.min_similarity <= 1.0:
            object.__setattr__(self, "min_similarity", min(1.0, max(0.0, self.min_similarity)) if self.min_similarity == self.min_similarity else 0.8)


    @classmethod
    def from_env(cls, env: dict[str, str], prefix: str = "ORRERY_") -> Options:
        """Numbers from variables such as ``ORRERY_MAX_HOPS``; what is missing, no number or NaN keeps the default."""
        found = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None or not isinstance(f.default, int | float):
                continue
            try:
                value = type(f.default)(raw)
            except ValueError:
                continue
            if value == value:
                found[f.name] = value
        return cls(**found)


DEFAULTS = Options()
