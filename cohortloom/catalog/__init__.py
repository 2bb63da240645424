"""Registered queries with their SQL counterparts."""

from cohortloom.catalog import (
    boosting,
    features,
    models,
    profiles,
    radial,
    record_columns,
    records,
    samples,
    texts,
)
from cohortloom.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "boosting", "features", "models", "profiles", "radial", "record_columns", "records", "samples", "texts"]
