"""Global row numbers, ranks, percentile buckets and top-n tables."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.operators.quantiles import quantiles
from cohortloom.session import cut_lineage


def with_row_number(
    df: DataFrame, order: Sequence[Column], out: str = "row", costly: bool = False
) -> DataFrame:
    """1-based position in a total order, without gathering the rows in one task.

    Rows are range-partitioned and sorted on the full order (so equal leading keys
    spread over tasks as long as the last key tells rows apart), stamped with their
    partition and place in it, and stored; the stored stamps make the partition
    sizes and the rows agree even when tasks are rerun. Only the sizes, one row
    per partition, are summed up and broadcast. Range bounds take a sampling pass over
    the input; a ``costly`` input is kept until the rows are stored, so it runs once.
    """
    place = F.monotonically_increasing_id()
    source = df.persist() if costly else df
    stamped = cut_lineage(
        source.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_range", F.shiftright(place, 33))
        .withColumn("_place", place.bitwiseAND(F.lit((1 << 33) - 1)))
    )
    if costly:
        source.unpersist()
    sizes = stamped.groupBy("_range").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start")
    )
    return stamped.join(F.broadcast(starts), "_range").select(
        *df.columns, (F.col("_start") + F.col("_place") + 1).alias(out)
    )


def rank_desc(
    df: DataFrame, score: str, id_col: str, out: str = "rank", costly: bool = False
) -> DataFrame:
    """Unique rank, 1 for the highest score; equal scores by id."""
    return with_row_number(df, [F.col(score).desc(), F.col(id_col).asc()], out, costly)


def bucket_thresholds(
    df: DataFrame,
    score: str,
    low: float = fv.LOW_RISK_PERCENTILE,
    high: float = fv.HIGH_RISK_PERCENTILE,
) -> tuple[float, float]:
    """(LOW threshold, HIGH threshold): exact percentiles of the score."""
    found = quantiles(df, [score], [low, high])[score]
    return found[low], found[high]


def ranked_thresholds(
    ranked: DataFrame,
    score: str,
    rank: str,
    low: float = fv.LOW_RISK_PERCENTILE,
    high: float = fv.HIGH_RISK_PERCENTILE,
) -> tuple[float, float]:
    """The same percentiles of rows that have a rank already: a look at four ranks; no rows, no thresholds."""
    rows = ranked.agg(F.max(rank)).first()[0]
    if rows is None:
        return None, None
    spots = [(rows - 1) * q for q in (low, high)]
    places = {rows - p for at in spots for p in (math.floor(at), math.ceil(at))}
    found = {
        r[rank]: r[score] for r in ranked.filter(F.col(rank).isin(*places)).select(rank, score).collect()
    }
    thresholds = []
    for at in spots:
        lower, upper = found[rows - math.floor(at)], found[rows - math.ceil(at)]
        thresholds.append(lower + (upper - lower) * (at - math.floor(at)))
    return thresholds[0], thresholds[1]


def risk_buckets(
    df: DataFrame, score: str, thresholds: tuple[float, float] | None = None, out: str = "risk_bucket"
) -> DataFrame:
    """LOW at or above the upper threshold, HIGH at or below the lower one, else MEDIUM."""
    low, high = thresholds or bucket_thresholds(df, score)
    bucket = (
        F.when(F.col(score) >= low, "LOW").when(F.col(score) <= high, "HIGH").otherwise("MEDIUM")
    )
    return df.withColumn(out, bucket)


def bucket_info(
    df: DataFrame, thresholds: tuple[float, float], bucket: str = "risk_bucket"
) -> DataFrame:
    """One row: both thresholds and the number of rows per bucket."""
    low, high = thresholds
    return df.agg(
        F.lit(low).alias("low_threshold"),
        F.lit(high).alias("high_threshold"),
        *[F.count_if(F.col(bucket) == b).alias(f"{b.lower()}_count") for b in fv.BUCKETS],
    )


def top_n(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of an order; each task keeps n rows at most."""
    return df.orderBy(*order).limit(n)


def with_rank(df: DataFrame, order: Sequence[Column], n: int, out: str = "rank") -> DataFrame:
    """The first ``n`` rows with their 1-based rank (a report, so n is small)."""
    ranked = Window.orderBy(*order)
    return top_n(df, order, n).withColumn(out, F.row_number().over(ranked))
