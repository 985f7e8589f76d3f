"""Job parameters. Plain keyword values, passed explicitly to the operators."""

from __future__ import annotations

from dataclasses import dataclass

# Leading titles that are dropped to form a second search form.
HONORIFICS = (
    "mr", "mrs", "ms", "miss", "dr", "prof", "sir", "lord", "lady",
    "haji", "hajji", "hadji", "al hajj", "al haj", "alhaj", "el hajj",
    "mullah", "mulla", "maulavi", "maulawi", "mawlawi", "moulavi",
    "sheikh", "shaykh", "sheik", "shaikh", "sayyid", "sayed", "syed",
    "imam", "ustad", "qari", "hafiz",
    "general", "colonel", "major", "captain", "lieutenant", "brigadier",
    "eng", "engineer",
)

# The closed vocabularies of the stored tables.
ENTITY_TYPES = ("individual", "entity", "vessel", "aircraft")
NAME_TYPES = ("primary", "alias", "aka", "fka", "nka", "original_script")
SOURCE_LISTS = ("DFAT", "OFAC", "UN")
LOG_STATUSES = ("success", "fallback_cache", "failed")

LAYERS = ("exact", "phonetic", "fuzzy", "embedding")


@dataclass(frozen=True)
class ScreeningParams:
    """Scoring and candidate settings with the published defaults."""

    strategy: str = "max"  # or "weighted_sum"
    weight_exact: float = 1.0
    weight_phonetic: float = 0.90
    weight_fuzzy: float = 0.97
    weight_embedding: float = 0.85
    corroboration_bonus: float = 3.0
    corroboration_floor: float = 80.0
    corroboration_min_layers: int = 2
    score_cap: float = 99.0
    token_sort_weight: float = 0.7
    partial_weight: float = 0.3
    fuzzy_cutoff: float = 60.0
    fuzzy_limit: int = 64
    cosine_cutoff: float = 0.45
    vector_limit: int = 64
    default_threshold: float = 75.0
    default_max_results: int = 10
    # The largest max_results a request may ask for; larger ones are rejected
    # by request validation, so results per query are bounded by it.
    max_results_bound: int = 100
    honorifics: tuple[str, ...] = HONORIFICS

    def weight(self, layer: str) -> float:
        return getattr(self, f"weight_{layer}")
