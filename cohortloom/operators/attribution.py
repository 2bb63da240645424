"""Additive attribution of model scores to features, and the tables made from it."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.functions.text import display_name
from cohortloom.operators.ranking import with_rank
from cohortloom.operators.tree_paths import leaf_paths, path_contributions

# leaves shipped with one pass; a leaf takes about 100 bytes per level of its tree
LEAVES_PER_PASS = 50_000


def linear_attribution(
    df: DataFrame,
    weights: dict[str, float],
    means: dict[str, float] | None = None,
    prefix: str = "phi_",
) -> DataFrame:
    """``weight * (value - mean)`` per feature; the parts add up to score minus mean score."""
    if means is None:
        row = df.agg(*[F.avg(name).alias(f"m{i}") for i, name in enumerate(weights)]).first()
        means = {name: row[f"m{i}"] for i, name in enumerate(weights)}
    return df.select(
        "*",
        *[
            (F.lit(float(w)) * (F.col(name) - F.lit(float(means[name])))).alias(f"{prefix}{name}")
            for name, w in weights.items()
        ],
    )


def tree_attribution(
    df: DataFrame, model, features: str = "features", out: str = "phi"
) -> DataFrame:
    """Exact path-dependent tree attribution as an array column, plus ``base``.

    For boosted trees base + sum(phi) is the margin, for forests the probability of
    class 1. The ensemble is flattened into leaf paths once (its size is that of the
    model, not of the data) and shipped in parts of at most ``LEAVES_PER_PASS``
    leaves; contributions are additive, so parts are added up. Rows stream through in
    Arrow batches, vectorised over the batch.
    """
    paths, base = leaf_paths(model)
    size = model.numFeatures
    keep = [c for c in df.columns if c != features]
    started = df.select(
        *keep,
        vector_to_array(features).alias("_x"),
        F.array_repeat(F.lit(0.0), size).alias(out),
    )
    for start in range(0, len(paths), LEAVES_PER_PASS):
        part = [tuple(p) for p in paths[start : start + LEAVES_PER_PASS]]
        started = _add_contributions(started, part, size, out)
    return started.select(*keep, out, F.lit(base).alias("base"))


def _add_contributions(df: DataFrame, paths: list[tuple], size: int, out: str) -> DataFrame:
    shipped = df.sparkSession.sparkContext.broadcast(paths)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                rows = np.stack(batch["_x"].to_numpy())
                added = path_contributions(shipped.value, rows, size)
                batch[out] = list(np.stack(batch[out].to_numpy()) + added)
            yield batch

    return df.mapInPandas(explain, df.schema)


def mean_abs(df: DataFrame, cols: Sequence[str], prefix: str = "") -> DataFrame:
    """Mean absolute value per column: feature, mean_abs; one aggregate."""
    averages = df.agg(*[F.avg(F.abs(c)).alias(f"c{i}") for i, c in enumerate(cols)])
    rows = [
        F.struct(F.lit(c.removeprefix(prefix)).alias("feature"), F.col(f"c{i}").alias("mean_abs"))
        for i, c in enumerate(cols)
    ]
    return averages.select(F.inline(F.array(*rows)))


def mean_abs_array(df: DataFrame, array_col: str, names: Sequence[str]) -> DataFrame:
    """Mean absolute value per element of an array column, named by position; one aggregate."""
    vector = array_to_vector(F.col(array_col).cast("array<double>"))
    sums = df.filter(F.col(array_col).isNotNull()).agg(
        vector_to_array(Summarizer.normL1(vector)).alias("sums"), F.count("*").alias("rows")
    )
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("pos") + 1)
    return sums.select("rows", F.posexplode("sums").alias("pos", "x")).select(
        named.alias("feature"), (F.col("x") / F.col("rows")).alias("mean_abs")
    )


def group_features(table: DataFrame, skip_prefix: str = "pca_emb") -> DataFrame:
    """Sum importances of features that share a base name.

    The base is the name without its last token, else without its last two, if more
    than one feature starts with it; a feature without such a base stands alone.
    Counting goes over the prefixes of every name, joined back by equality.
    """
    names = table.filter(~F.col("feature").startswith(skip_prefix))
    tokens = F.split("feature", "_")

    def without_last(n: int) -> Column:
        kept = F.array_join(F.slice(tokens, F.lit(1), F.size(tokens) - n), "_")
        return F.when(F.size(tokens) > n, F.nullif(kept, F.lit("")))

    with_bases = names.select(
        "feature", "mean_abs", without_last(1).alias("base1"), without_last(2).alias("base2")
    )
    steps = F.sequence(F.lit(1), F.size(tokens) - 1)
    prefixes = F.transform(steps, lambda n: F.array_join(F.slice(tokens, F.lit(1), n), "_"))
    shared = (
        names.filter(F.size(tokens) > 1)
        .select(F.explode(prefixes).alias("base"))
        .groupBy("base")
        .agg(F.count("*").alias("n"))
        .filter(F.col("n") > 1)
        .select("base")
    )
    one = shared.select(F.col("base").alias("base1"), F.lit(True).alias("use1"))
    two = shared.select(F.col("base").alias("base2"), F.lit(True).alias("use2"))
    chosen = (
        F.when(F.col("use1"), F.col("base1"))
        .when(F.col("use2"), F.col("base2"))
        .otherwise(F.col("feature"))
    )
    return (
        with_bases.join(one, "base1", "left")
        .join(two, "base2", "left")
        .groupBy(chosen.alias("feature"))
        .agg(F.sum("mean_abs").alias("mean_abs"))
    )


def importance_table(
    table: DataFrame, top: int = 20, grouped: bool = False, skip_prefix: str = "pca_emb"
) -> DataFrame:
    """Top features with rank and display name; vector components are left out."""
    shown = table.filter(~F.col("feature").startswith(skip_prefix))
    if grouped:
        shown = group_features(shown, skip_prefix)
    order = [F.col("mean_abs").desc(), F.col("feature").asc()]
    return with_rank(shown, order, top).select(
        "rank", "feature", display_name(F.col("feature")).alias("feature_display"), "mean_abs"
    )


def resolve_feature(name: str, names: Sequence[str]) -> str | None:
    """The feature itself, else the first one whose name contains it."""
    if name in names:
        return name
    return next((n for n in names if name in n), None)


def dependence(
    df: DataFrame, wanted: Sequence[str], names: Sequence[str], prefix: str = "phi_"
) -> DataFrame:
    """Value and attribution of the resolved features: feature, value, phi."""
    shown = [n for n in wanted if not n.startswith("pca_emb")]
    found = [r for r in (resolve_feature(n, names) for n in shown) if r]
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("feature"),
                F.col(n).cast("double").alias("value"),
                F.col(f"{prefix}{n}").alias("phi"),
            )
            for n in found
        ]
    )
    return df.select(F.inline(rows))


def direction(df: DataFrame, value: str = "value", phi: str = "phi", key: str = "feature") -> DataFrame:
    """Correlation of value and attribution per feature: above 0 "increases", else "decreases".

    Where one side is constant there is no correlation, which counts as "decreases".
    """
    spread = F.nullif(F.stddev_pop(value) * F.stddev_pop(phi), F.lit(0.0))
    related = df.groupBy(key).agg((F.covar_pop(value, phi) / spread).alias("correlation"))
    towards = F.when(F.col("correlation") > 0, "increases").otherwise("decreases")
    return related.select(key, "correlation", towards.alias("direction"))


def report_points(
    df: DataFrame, wanted: Sequence[str], names: Sequence[str], prefix: str = "phi_"
) -> DataFrame:
    """Value and attribution of (grouped) features: the mean over all features they match."""

    def mean(cols: list[str]) -> Column:
        total = F.lit(0.0)
        for c in cols:
            total = total + F.col(c).cast("double")
        return total / len(cols)

    rows = []
    for name in wanted:
        matched = [n for n in names if name in n or n in name]
        if matched:
            phi = mean([f"{prefix}{n}" for n in matched])
            point = [F.lit(name).alias("feature"), mean(matched).alias("value"), phi.alias("phi")]
            rows.append(F.struct(*point))
    return df.select(F.inline(F.array(*rows)))


def name_table(spark: SparkSession, names: Sequence[str]) -> DataFrame:
    """Feature names as a one-column table."""
    return spark.range(1).select(F.explode(F.array(*[F.lit(n) for n in names])).alias("feature"))


def leakage_matches(
    names: DataFrame, patterns: Sequence[str] = tuple(fv.LEAKAGE_AUDIT_PATTERNS)
) -> DataFrame:
    """Each name next to each audit pattern, with ``leaks``: one holds the other, ignoring case."""
    low, wanted = F.lower("feature"), F.lower("pattern")
    paired = names.select("feature", F.explode(F.array(*[F.lit(p) for p in patterns])).alias("pattern"))
    return paired.withColumn("leaks", F.contains(low, wanted) | F.contains(wanted, low))


def leakage_audit(
    names: DataFrame, patterns: Sequence[str] = tuple(fv.LEAKAGE_AUDIT_PATTERNS)
) -> DataFrame:
    """One row per pattern: how many features it matches and whether it was found."""
    return (
        leakage_matches(names, patterns)
        .groupBy("pattern")
        .agg(F.count_if("leaks").alias("matches"))
        .withColumn("found", F.col("matches") > 0)
    )


class LeakageError(ValueError):
    """Raised after the report when a feature leaks the outcome."""


def require_no_leakage(
    names: DataFrame, patterns: Sequence[str] = tuple(fv.LEAKAGE_AUDIT_PATTERNS), shown: int = 20
) -> None:
    """Raise when any feature leaks; the message names the first few."""
    leaking = leakage_matches(names, patterns).filter("leaks").select("feature").distinct()
    found = [row["feature"] for row in leaking.orderBy("feature").limit(shown).collect()]
    if found:
        raise LeakageError(f"leaking features: {found}")
