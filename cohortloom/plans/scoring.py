"""Cohort scoring: ongoing records to a ranked, bucketed table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.operators import cohort
from cohortloom.operators.attribution import importance_table, mean_abs
from cohortloom.operators.columns import align_features
from cohortloom.operators.impute import coerce_numeric
from cohortloom.plans.audit import explained


def score_cohort(
    candidates: Sequence[DataFrame],
    default: DataFrame,
    model,
    metadata: dict,
    id_col: str = fv.ID_COLUMN,
    **filters,
) -> DataFrame:
    """Pick a source, filter the cohort, score it, rank it and assign risk buckets.

    Features are aligned to the model's list first, so a feature the model knows is
    never dropped because it is constant within the cohort.
    """
    source = cohort.pick_source(candidates, cohort.is_ongoing(), default)
    rows = cohort.filter_cohort(source, **filters)
    names = metadata["feature_names"]
    # the row travels beside its aligned features, so rows with equal ids stay apart
    whole = F.struct(*[F.col(c) for c in rows.columns if c != "p_completion"]).alias("_row")
    aligned = coerce_numeric(align_features(rows.select("*", whole), names, keep=["_row"]), names)
    scored = cohort.score(aligned, model).select("_row.*", "p_completion")
    return cohort.scored_table(scored, names, id_col=id_col)


def cohort_importance(
    features: DataFrame, model, names: Sequence[str], shown: int = 20, id_col: str = fv.ID_COLUMN
) -> DataFrame:
    """Which features move the scores of a cohort most, over all its rows."""
    parts = explained(features.select(id_col, *names), model, list(names), id_col)
    return importance_table(mean_abs(parts, [f"phi_{n}" for n in names], prefix="phi_"), shown)
