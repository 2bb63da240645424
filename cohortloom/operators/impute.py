"""Imputation, coercion, encoding and scaling; fitted on one frame, applied to others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom.operators.columns import numeric_columns
from cohortloom.operators.quantiles import modes, quantiles
from cohortloom.operators.ranking import with_row_number

# --- fixed values: what counts as a number in text ---------------------------
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def fit_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Exact medians; 0 for a column without values."""
    return {c: found[0.5] or 0.0 for c, found in quantiles(df, cols, [0.5]).items()}


def fit_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent values (smallest on ties); "0" for a column without values."""
    found = modes(df, cols)
    return {c: found.get(c, "0") for c in cols}


def fit_impute(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, object]:
    """Medians of numeric columns and modes of the others."""
    cols = list(cols or df.columns)
    numeric = set(numeric_columns(df, with_booleans=False))
    medians = [c for c in cols if c in numeric]
    others = [c for c in cols if c not in numeric]
    fitted: dict[str, object] = {}
    if medians:
        fitted.update(fit_medians(df, medians))
    if others:
        fitted.update(fit_modes(df, others))
    return fitted


def apply_impute(df: DataFrame, fitted: dict[str, object]) -> DataFrame:
    """Nulls (and NaN in numeric columns) replaced by the fitted values."""
    kinds = dict(df.dtypes)

    def filled(c: str) -> Column:
        if c not in fitted:
            return F.col(c)
        if kinds[c] in ("double", "float"):
            return F.coalesce(F.nanvl(c, F.lit(None).cast(kinds[c])), F.lit(fitted[c])).alias(c)
        if kinds[c] in ("string", "boolean"):
            return F.coalesce(F.col(c), F.lit(fitted[c]).cast(kinds[c])).alias(c)
        return F.coalesce(F.col(c).cast("double"), F.lit(fitted[c])).alias(c)

    return df.select(*[filled(c) for c in df.columns])


def number_or_zero(text: Column) -> Column:
    """Text as a double where it is a plain number, else 0."""
    number = F.when(text.rlike(NUMBER_PATTERN), F.trim(text).try_cast("double"))
    return F.coalesce(number, F.lit(0.0))


def fit_codes(df: DataFrame, cols: Sequence[str]) -> dict[str, DataFrame]:
    """Category codes per column: a table of its distinct values with their sorted position.

    The tables stay distributed, so a column may have any number of values.
    """
    tables = {}
    for c in cols:
        values = df.filter(F.col(c).isNotNull()).select(c).distinct()
        numbered = with_row_number(values, [F.col(c).asc()], "_code")
        tables[c] = numbered.select(c, (F.col("_code") - 1).alias("_code"))
    return tables


def apply_codes(df: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """Columns replaced by their codes; unseen and null values share the next free code."""
    names = df.columns
    for c, table in tables.items():
        free = table.agg(F.count("*")).first()[0]
        coded = df.join(table, c, "left").withColumn(
            c, F.coalesce(F.col("_code"), F.lit(free)).cast("double")
        )
        df = coded.select(*names)
    return df


def coerce_numeric(
    df: DataFrame,
    cols: Sequence[str],
    categoricals: str = "zero",
    codes: dict[str, DataFrame] | None = None,
) -> DataFrame:
    """All ``cols`` as doubles without nulls.

    Text that is a number becomes it, other text becomes 0 (``categoricals="zero"``)
    or its position in the sorted values (``"index"``, fitted here or passed in as
    ``codes``). Booleans become 0/1; nulls and NaN become 0.
    """
    if categoricals == "index":
        texts = [c for c, kind in df.dtypes if c in cols and kind == "string"]
        df = apply_codes(df, codes or fit_codes(df, texts))
    kinds = dict(df.dtypes)

    def coerced(c: str) -> Column:
        if kinds[c] == "string":
            value = number_or_zero(F.col(c))
        elif kinds[c] in ("double", "float"):
            value = F.nanvl(c, F.lit(0.0))
        else:
            value = F.col(c)
        return F.coalesce(value.cast("double"), F.lit(0.0)).alias(c)

    others = [c for c in kinds if c not in cols]
    return df.select(*others, *[coerced(c) for c in cols])


def fit_scale(df: DataFrame, cols: Sequence[str], how: str = "standard") -> dict[str, tuple[float, float]]:
    """(offset, divisor) per column from one aggregate; a constant column divides by 1."""
    if how == "standard":
        measures = [(F.avg(c), F.stddev_pop(c)) for c in cols]
    elif how == "minmax":
        measures = [(F.min(c), F.max(c) - F.min(c)) for c in cols]
    else:
        raise ValueError(f"unknown scaling: {how}")
    aggregates = [
        m.cast("double").alias(f"{part}{i}")
        for i, pair in enumerate(measures)
        for part, m in zip("od", pair)
    ]
    row = df.agg(*aggregates).first()
    return {c: (row[f"o{i}"] or 0.0, row[f"d{i}"] or 1.0) for i, c in enumerate(cols)}


def apply_scale(df: DataFrame, fitted: dict[str, tuple[float, float]]) -> DataFrame:
    def scaled(c: str) -> Column:
        if c not in fitted:
            return F.col(c)
        offset, divisor = fitted[c]
        return ((F.col(c) - offset) / divisor).alias(c)

    return df.select(*[scaled(c) for c in df.columns])


def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Missing values per column, counted in one pass: column, missing, share."""
    kinds = dict(df.dtypes)
    cols = list(cols or df.columns)

    def missing(c: str) -> Column:
        is_nan = F.isnan(c) if kinds[c] in ("double", "float") else F.lit(False)
        return F.count_if(F.col(c).isNull() | is_nan)

    one = df.agg(F.count("*").alias("rows"), *[missing(c).alias(c) for c in cols])
    return one.unpivot("rows", cols, "column", "missing").select(
        "column", "missing", (F.col("missing") / F.col("rows")).alias("share")
    )
