"""Counts, summaries, histograms and data checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.operators.quantiles import quantiles


def value_counts(df: DataFrame, column: str, keys: Sequence[str] | None = None) -> DataFrame:
    """Rows per value; with ``keys`` exactly those values, 0 where a key does not occur."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    if keys is None:
        return counts
    listed = df.sparkSession.range(1).select(
        F.explode(F.array(*[F.lit(k) for k in keys])).alias(column)
    )
    # at most one count per key is left, so the counted side is no larger than the key list
    wanted = counts.filter(F.col(column).isin(*keys))
    return listed.join(F.broadcast(wanted), column, "left").select(
        column, F.coalesce("n", F.lit(0)).alias("n")
    )


def summary(df: DataFrame, column: str) -> DataFrame:
    """Minimum, exact median, maximum, mean and population deviation in one row."""
    median = quantiles(df, [column], [0.5])[column][0.5]
    return df.agg(
        F.min(column).alias("min"),
        F.lit(median).cast("double").alias("median"),
        F.max(column).alias("max"),
        F.avg(column).alias("mean"),
        F.stddev_pop(column).alias("std"),
    )


def feature_totals(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sum and mean per column, one row per column; one aggregate, no shuffle of rows."""
    totals = df.agg(
        *[F.sum(F.col(c).cast("double")).alias(f"s{i}") for i, c in enumerate(cols)],
        *[F.avg(c).alias(f"a{i}") for i, c in enumerate(cols)],
    )
    rows = [
        F.struct(
            F.lit(c).alias("feature"), F.col(f"s{i}").alias("total"), F.col(f"a{i}").alias("mean")
        )
        for i, c in enumerate(cols)
    ]
    return totals.select(F.inline(F.array(*rows)))


def histogram(df: DataFrame, column: str, bins: int = fv.HISTOGRAM_BINS) -> DataFrame:
    """Equal bins from minimum to maximum, the last one closed, empty bins included."""
    values = df.filter(F.col(column).isNotNull())
    low, high = values.agg(
        F.min(column).cast("double"), F.max(column).cast("double")
    ).first()
    if low is None:
        low, high = 0.0, 1.0
    if low == high:
        # a single value sits in a unit-wide range around it
        low, high = low - 0.5, high + 0.5
    width = (high - low) / bins
    place = F.width_bucket(F.col(column).cast("double"), F.lit(low), F.lit(high), F.lit(bins))
    number = F.least(place, F.lit(bins))
    counted = values.groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    edge = F.lit(low) + (F.col("bin") - 1) * F.lit(width)
    return every.join(F.broadcast(counted), "bin", "left").select(
        "bin",
        edge.alias("from_value"),
        (edge + F.lit(width)).alias("to_value"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def check_no_ongoing(
    df: DataFrame,
    status: str = "overall_status",
    label: str = fv.LABEL_COLUMN,
    statuses: Sequence[str] = tuple(fv.ONGOING_STATUSES),
) -> DataFrame:
    """One row: ongoing rows, ongoing rows that carry a label, and whether the check holds."""
    ongoing = F.col(status).isin(*statuses)
    labelled = F.count_if(ongoing & F.col(label).isNotNull())
    return df.agg(
        F.count_if(ongoing).alias("ongoing"),
        labelled.alias("ongoing_labelled"),
        (labelled == 0).alias("passed"),
    )


def status_breakdown(
    df: DataFrame, status: str = "overall_status", statuses: Sequence[str] = tuple(fv.ONGOING_STATUSES)
) -> DataFrame:
    """Rows per ongoing status that are still in the table."""
    return value_counts(df.filter(F.col(status).isin(*statuses)), status)
