"""All queries of this subpackage; importing it registers them."""

from cohortloom.llm import (
    decontamination,
    license_scan,
    near_duplicates,
    neighbours,
    packing,
    personal_data,
    quality,
    ranked_search,
    secret_scan,
    suffix_dedup,
    token_counts,
    toxicity,
    vector_codes,
)
from cohortloom.llm.common import ORACLES, QUERIES

__all__ = [
    "ORACLES",
    "QUERIES",
    "decontamination",
    "license_scan",
    "near_duplicates",
    "neighbours",
    "packing",
    "personal_data",
    "quality",
    "ranked_search",
    "secret_scan",
    "suffix_dedup",
    "token_counts",
    "toxicity",
    "vector_codes",
]
