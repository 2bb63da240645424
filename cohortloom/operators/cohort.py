"""Deployment cohort: source choice, filter, scoring and the tables behind the charts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.functions.text import keyword_match, shorten
from cohortloom.operators import columns as c
from cohortloom.operators import profile
from cohortloom.operators.ranking import rank_desc, ranked_thresholds, risk_buckets, top_n


def is_ongoing(status: str = "overall_status") -> Column:
    return F.col(status).isin(*fv.COHORT_STATUSES)


def pick_source(candidates: Sequence[DataFrame], predicate: Column, default: DataFrame) -> DataFrame:
    """First candidate with a row that fulfils the predicate, else the default.

    Each look stops at its first hit and reads only the predicate's columns. A
    candidate without those columns is passed over.
    """
    for candidate in candidates:
        try:
            hit = candidate.filter(predicate).select(F.lit(1))
        except AnalysisException:
            continue
        if hit.take(1):
            return candidate
    return default


def filter_cohort(
    df: DataFrame,
    flag: str = "is_nsclc",
    text_col: str = "condition_text",
    keywords: Sequence[str] = tuple(fv.COHORT_KEYWORDS),
    status: str = "overall_status",
    statuses: Sequence[str] = tuple(fv.COHORT_STATUSES),
    extra: Column | None = None,
) -> DataFrame:
    """Rows of the disease with an ongoing status.

    The disease is decided by the flag column, or by keywords in the text when there
    is no flag; a filter whose columns are absent is left out.
    """
    kept = df
    if flag in df.columns:
        kept = kept.filter(F.col(flag) == 1)
    elif text_col in df.columns:
        kept = kept.filter(keyword_match(F.lower(text_col), keywords))
    if status in df.columns:
        kept = kept.filter(F.col(status).isin(*statuses))
    return kept if extra is None else kept.filter(extra)


def score(df: DataFrame, model, out: str = "p_completion", features: str = "features") -> DataFrame:
    """Probability of class 1; an error when there is nothing to score."""
    if df.isEmpty():
        raise ValueError("nothing to score: the feature table has no rows")
    scored = model.transform(df)
    probability = vector_to_array("probability")[1]
    keep = [name for name in df.columns if name != features]
    return scored.select(*keep, probability.alias(out))


def scored_table(
    df: DataFrame,
    features: Sequence[str],
    score_col: str = "p_completion",
    id_col: str = fv.ID_COLUMN,
    required: Sequence[str] = tuple(fv.SCORED_COLUMNS),
    alternatives: Mapping[str, str] = fv.SCORED_ALTERNATIVES,
    extras: Sequence[str] = tuple(fv.SCORED_EXTRAS),
    rank_col: str = "rank_nsclc",
) -> DataFrame:
    """Cohort columns with probability, rank and risk bucket, in rank order when written."""
    wanted = c.output_columns(df.columns, features, id_col, required, alternatives, extras)
    rows = df.select(*dict.fromkeys([*wanted, score_col]))
    ranked = rank_desc(rows, score_col, id_col, rank_col, costly=True)
    thresholds = ranked_thresholds(ranked, score_col, rank_col)
    return risk_buckets(ranked, score_col, thresholds).select(
        *wanted, *[x for x in (score_col, rank_col, "risk_bucket") if x not in wanted]
    )


def chart_data(
    df: DataFrame,
    kind: str,
    score_col: str = "p_completion",
    rank_col: str = "rank_nsclc",
    id_col: str = fv.ID_COLUMN,
) -> DataFrame:
    """The table behind one chart of the scored cohort.

    ``distribution``: probability histogram; ``buckets``: rows per risk bucket;
    ``top``: the 25 best ranked; ``enrollment`` and ``facilities``: scatter points.
    """
    if kind == "distribution":
        return profile.histogram(df, score_col)
    if kind == "buckets":
        return profile.value_counts(df, "risk_bucket", fv.BUCKETS)
    if kind == "top":
        sponsor = [s for s in ("sponsor_name", "lead_sponsor_name") if s in df.columns][:1]
        best = top_n(df, [F.col(rank_col).asc()], 25)
        names = [shorten(F.col(s), 30).alias(s) for s in sponsor]
        return best.select(id_col, *names, rank_col, score_col, "risk_bucket")
    axis = {"enrollment": ["enrollment_planned_num"], "facilities": fv.FACILITY_COLUMNS}[kind]
    present = [name for name in axis if name in df.columns]
    if not present:
        raise ValueError(f"none of {axis} is in the table")
    return df.select(present[0], score_col, "risk_bucket")
