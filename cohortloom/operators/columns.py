"""Column selection by rule: prefix, group, pattern, type and content."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def columns_with_prefix(df: DataFrame, prefix: str) -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def drop_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*columns_with_prefix(df, prefix))


def tabular_columns(
    df: DataFrame,
    groups: Sequence[Sequence[str]] = (fv.TEXT_COLUMNS, fv.NESTED_COLUMNS, fv.EXCLUDED_COLUMNS),
    leakage: Sequence[str] | None = tuple(fv.LEAKAGE_COLUMNS),
    leakage_patterns: Sequence[str] = tuple(fv.LEAKAGE_PATTERNS),
    keys: Sequence[str] = (fv.ID_COLUMN, fv.LABEL_COLUMN, "feasibility_label"),
    vector_prefix: str = fv.PCA_PREFIX,
) -> list[str]:
    """All columns except keys, the listed groups, vector components and leakage.

    ``leakage=None`` keeps leakage columns, listed or matched by pattern.
    """
    excluded = set(keys).union(*groups, columns_with_prefix(df, vector_prefix))
    if leakage is not None:
        excluded.update(leakage)
        excluded.update(
            c for c in df.columns if any(pattern in c.lower() for pattern in leakage_patterns)
        )
    return [c for c in df.columns if c not in excluded]


def feature_columns(df: DataFrame, mode: str, **rules) -> list[str]:
    """Columns of an input mode; the second mode adds the vector components."""
    if mode not in fv.INPUT_MODES:
        raise ValueError(f"invalid mode: {mode}; must be one of {fv.INPUT_MODES}")
    cols = tabular_columns(df, **rules)
    if mode == "tabular_plus_embeddings":
        cols += columns_with_prefix(df, rules.get("vector_prefix", fv.PCA_PREFIX))
    return cols


def feature_view(
    df: DataFrame,
    mode: str,
    label: str = fv.LABEL_COLUMN,
    id_col: str = fv.ID_COLUMN,
    **rules,
) -> DataFrame:
    """Id, label and the feature columns of a mode, for labelled rows only."""
    if label not in df.columns:
        raise ValueError(f"label column {label} not found")
    cols = [c for c in feature_columns(df, mode, **rules) if c not in (label, id_col)]
    return df.filter(F.col(label).isNotNull()).select(
        id_col, F.col(label).cast("int").alias(label), *cols
    )


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Feature columns as one vector; nulls must have been filled before."""
    return VectorAssembler(inputCols=list(cols), outputCol=out).transform(df)


def constant_columns(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """Columns with at most one distinct non-null value: one min/max aggregate, no distinct."""
    cols = list(cols or df.columns)
    same = df.agg(
        *[F.min(c).eqNullSafe(F.max(c)).alias(f"c{i}") for i, c in enumerate(cols)]
    ).first()
    return [c for i, c in enumerate(cols) if same[f"c{i}"]]


def apply_feature_mask(
    df: DataFrame, mask: Sequence[bool], names: Sequence[str] | None = None
) -> DataFrame:
    """Columns whose mask entry is true; names that are absent are passed over."""
    names = list(names or df.columns)
    return df.select(*[c for c, keep in zip(names, mask) if keep and c in df.columns])


def align_features(
    df: DataFrame, names: Sequence[str], keep: Sequence[str] = (), fill: float = 0
) -> DataFrame:
    """``keep`` columns, then exactly ``names`` in that order; an absent one is ``fill``."""
    present = set(df.columns)
    return df.select(
        *keep, *[F.col(c) if c in present else F.lit(fill).alias(c) for c in names]
    )


def numeric_columns(df: DataFrame, with_booleans: bool = True) -> list[str]:
    wanted = NUMERIC + (("boolean",) if with_booleans else ())
    return [c for c, kind in df.dtypes if kind.startswith(wanted)]


def categorical_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c not in numeric_columns(df, with_booleans=False)]


def common_columns(a: DataFrame, b: DataFrame) -> list[str]:
    present = set(b.columns)
    return [c for c in a.columns if c in present]


def output_columns(
    available: Sequence[str],
    features: Sequence[str],
    id_col: str = fv.ID_COLUMN,
    required: Sequence[str] = tuple(fv.SCORED_COLUMNS),
    alternatives: Mapping[str, str] = fv.SCORED_ALTERNATIVES,
    extras: Sequence[str] = tuple(fv.SCORED_EXTRAS),
    skip_prefix: str = "pca_emb",
) -> list[str]:
    """Id, features (no vector components), required columns or their stand-ins, extras."""
    wanted = [id_col, *[f for f in features if not f.startswith(skip_prefix)]]
    wanted += [c if c in available else alternatives.get(c, c) for c in required]
    wanted += extras
    return list(dict.fromkeys(c for c in wanted if c in available))


def feature_groups(
    names: Sequence[str], groups: Mapping[str, tuple[str, Sequence[str]]]
) -> dict[str, list[str]]:
    """Column names per group; a group is a prefix and substrings of which one must occur."""
    return {
        group: [c for c in names if c.startswith(prefix) and any(p in c for p in parts)]
        for group, (prefix, parts) in groups.items()
    }


def group_counts(
    df: DataFrame,
    id_col: str = fv.ID_COLUMN,
    label: str = fv.LABEL_COLUMN,
    groups: Mapping[str, tuple[str, Sequence[str]]] | None = None,
) -> dict[str, int]:
    """Columns per feature group; what no group, key or label holds is ``other``."""
    if groups is None:
        groups = {
            "pca": (fv.PCA_PREFIX, ("",)),
            "disease": (fv.FLAG_PREFIX, fv.DISEASE_GROUP),
            "intervention": (fv.FLAG_PREFIX, fv.INTERVENTION_GROUP),
            "complexity": ("", fv.COMPLEXITY_GROUP),
        }
    counts = {name: len(cols) for name, cols in feature_groups(df.columns, groups).items()}
    keys = sum(c in df.columns for c in (id_col, label))
    return {**counts, "other": len(df.columns) - sum(counts.values()) - keys}


def exclude_prefix(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Rows whose name does not start with ``prefix``."""
    return df.filter(~F.col(column).startswith(prefix))


def check_columns(df: DataFrame, required: Sequence[str] = tuple(fv.CRITICAL_COLUMNS)) -> DataFrame:
    """One row per required column with whether the table has it."""
    present = F.array(*[F.lit(c) for c in df.columns])
    names = F.explode(F.array(*[F.lit(c) for c in required])).alias("column")
    return df.sparkSession.range(1).select(names).withColumn(
        "present", F.array_contains(present, F.col("column"))
    )


def expand_vector(df: DataFrame, array_col: str, size: int, prefix: str) -> DataFrame:
    """One column per array element, null where the array is null or shorter; longer ones are an error."""
    message = F.concat(F.lit(f"{array_col} has more than {size} elements: "), F.size(array_col))
    whole = F.when(F.size(array_col) > size, F.raise_error(message)).otherwise(F.col(array_col))
    parts: list[Column] = [F.get(whole, F.lit(i)).alias(f"{prefix}{i}") for i in range(size)]
    return df.select("*", *parts)
