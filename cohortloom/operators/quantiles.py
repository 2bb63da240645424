"""Exact order statistics of data of any size, by histograms.

``percentile`` keeps every distinct value of a group in one task. Here the interval that holds a
wanted rank is cut into ``BINS`` bins, one map-side combined aggregate counts them, and the rank's bin, from
its smallest to its largest value, is the next interval. Bins are as wide as each other on a logarithmic
scale while an interval spans more than a factor of two or changes sign, and on a linear one after that, so any
double is reached in five passes; evenly spread values take one or two. An interval with ``LISTED_VALUES`` values or
fewer is counted value by value. A hot value is one row per task and bin, and becomes an interval of
its own. The searches are a table, one row per wanted rank, so there may be any number of keys.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom.session import cut_lineage

BINS = 16_384
# values of one rank's interval that are counted one by one
LISTED_VALUES = 4_096
# searches that are kept as a local table and broadcast to the values; more are stored and joined by key
BROADCAST_SEARCHES = 50_000
SEARCH = "key bigint, rank bigint, low double, high double, below bigint, inside bigint"


@dataclass
class Statistic:
    """Value at a rank, with how many values are smaller and how many are equal."""

    value: float
    below: int
    equal: int


def order_statistics(
    values: DataFrame,
    ranks: dict[int, Sequence[int]],
    counts: dict[int, int],
    listed: int = LISTED_VALUES,
    bounds: dict[int, tuple[float, float]] | None = None,
    even: bool = False,
) -> dict[tuple[int, int], Statistic]:
    """Exact values at zero-based ``ranks`` of a few keys, on the driver.

    ``counts`` holds the number of values of each key, ``bounds`` their least and largest, if known; see
    ``rank_values``.
    """
    wanted = [(key, rank, counts[key]) for key, found in ranks.items() for rank in sorted(set(found))]
    for key, rank, inside in wanted:
        if not 0 <= rank < inside:
            raise ValueError(f"rank {rank} is outside 0..{inside - 1}")
    found = rank_values(values, searches(values, wanted, bounds), listed, even)
    return {(r["key"], r["rank"]): Statistic(r["value"], r["below"], r["equal"]) for r in found.collect()}


def searches(
    values: DataFrame, wanted: Sequence[tuple[int, int, int]], bounds: dict[int, tuple[float, float]] | None
) -> DataFrame:
    """Table of (key, rank, number of the key's values); ``bounds`` as for ``order_statistics``."""
    rows = [(key, rank, *map(float, bounds[key] if bounds else (math.nan, math.nan)), 0, n) for key, rank, n in wanted]
    return values.sparkSession.createDataFrame(rows, SEARCH) if bounds else _bounded(
        values, values.sparkSession.createDataFrame(rows, SEARCH).drop("low", "high")
    )


def _bounded(values: DataFrame, wanted: DataFrame) -> DataFrame:
    ends = values.groupBy("key").agg(
        F.min("value").cast("double").alias("low"), F.max("value").cast("double").alias("high")
    )
    return wanted.join(ends, "key").select("key", "rank", "low", "high", "below", "inside")


def rank_values(values: DataFrame, searches: DataFrame, listed: int = LISTED_VALUES, even: bool = False) -> DataFrame:
    """(key, rank, value, below, equal) for every search.

    ``values`` has columns ``key`` (an integer naming a column or class) and ``value``
    (a non-null number, exact as a double, infinities included). A search (see ``SEARCH``) has a key, a zero-based
    rank, the key's least and largest value or less and more, 0, and the number of the key's values.
    ``even``: the values are spread evenly, so that linear bins are best from the start.
    """
    numbers = values.select(
        F.col("key").cast("bigint").alias("key"), (F.col("value").cast("double") + 0.0).alias("value")
    )
    while True:
        searches, count, states = _kept(searches, listed)
        if "wide" not in states:
            break
        is_wide = _is_wide(listed)
        narrowed = _narrowed(numbers, searches.where(is_wide), count, even)
        searches = searches.where(~is_wide).unionByName(narrowed) if len(states) > 1 else narrowed
    one = F.col("low") == F.col("high")
    done = searches.where(one).select("key", "rank", F.col("low").alias("value"), "below", F.col("inside").alias("equal"))
    if "few" not in states:
        return done
    picked = _picked(numbers, searches.where(~one), count)
    return done.unionByName(picked) if "one" in states else picked


def _is_wide(listed: int) -> Column:
    return (F.col("low") < F.col("high")) & (F.col("inside") > listed)


def _state(listed: int) -> Column:
    return F.when(F.col("low") == F.col("high"), "one").when(_is_wide(listed), "wide").otherwise("few")


def _kept(searches: DataFrame, listed: int) -> tuple[DataFrame, int, set[str]]:
    """The searches as a local table (or a stored one, if many), their number, and which states they are in."""
    rows = searches.withColumn("state", _state(listed)).limit(BROADCAST_SEARCHES + 1).collect()
    if len(rows) <= BROADCAST_SEARCHES:
        local = searches.sparkSession.createDataFrame([tuple(r)[:-1] for r in rows], SEARCH)
        return local, len(rows), {r["state"] for r in rows}
    kept = cut_lineage(searches)
    return kept, len(rows), {r["state"] for r in kept.select(_state(listed).alias("state")).distinct().collect()}


def _small(table: DataFrame, count: int) -> DataFrame:
    return F.broadcast(table) if count <= BROADCAST_SEARCHES else table


def _inside(values: DataFrame, searches: DataFrame, count: int) -> DataFrame:
    """Values with the different intervals that hold them."""
    intervals = searches.select("key", "low", "high").distinct()
    return values.join(_small(intervals, count), "key").where("value >= low AND value <= high")


def _scale(value: Column) -> Column:
    """Logarithmic and increasing over all doubles: 0 for zero, from 5 on above, down from -5 below it."""
    size = F.when(F.abs(value) == float("inf"), F.lit(1030.0)).otherwise(F.log2(F.abs(value)))
    return F.when(value == 0, F.lit(0.0)).otherwise(F.signum(value) * (size + 1080.0))


def _bin(even: bool) -> Column:
    """Bin of a value in its interval: never less for a larger value, 0 and ``BINS`` for the ends."""
    v, low, high = F.col("value"), F.col("low"), F.col("high")
    linear = (v - low) / (high - low)
    if not even:
        linear = F.when(_scale(high) - _scale(low) > 1, (_scale(v) - _scale(low)) / (_scale(high) - _scale(low))).otherwise(linear)
    return F.floor(F.least(F.greatest(linear, F.lit(0.0)), F.lit(1.0)) * BINS).cast("int")


def _narrowed(values: DataFrame, searches: DataFrame, count: int, even: bool) -> DataFrame:
    """One counting pass: each search moves to the bin of its interval that holds the rank."""
    bins = (
        _inside(values, searches, count).withColumn("bin", _bin(even))
        .groupBy("key", "low", "high", "bin")
        .agg(F.count("*").alias("n"), F.min("value").alias("a"), F.max("value").alias("b"))
    )
    return _at_rank(bins, searches, count, ["bin"]).select(
        "key", "rank", F.col("a").alias("low"), F.col("b").alias("high"), "below", F.col("n").alias("inside")
    )


def _picked(values: DataFrame, searches: DataFrame, count: int) -> DataFrame:
    """The ranks of searches with few values left, from counts of each value."""
    counts = _inside(values, searches, count).groupBy("key", "low", "high", "value").agg(F.count("*").alias("n"))
    return _at_rank(counts, searches, count, ["value"]).select("key", "rank", "value", "below", F.col("n").alias("equal"))


def _at_rank(counts: DataFrame, searches: DataFrame, count: int, order: list[str]) -> DataFrame:
    """The counted row that holds each search's rank; ``below`` becomes the number of values before that row."""
    upto = F.sum("n").over(Window.partitionBy("key", "low", "high").orderBy(*order))
    summed = counts.withColumn("before", upto - F.col("n"))
    found = summed.join(_small(searches.select("key", "low", "high", "rank", F.col("below").alias("under")), count), ["key", "low", "high"])
    return found.withColumn("below", F.col("under") + F.col("before")).where("rank >= below AND rank < below + n")


def long_values(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Columns as rows (key = position, value), nulls and NaN left out; no shuffle."""
    pairs = F.array(
        *[
            F.struct(F.lit(i).alias("key"), F.col(c).cast("double").alias("value"))
            for i, c in enumerate(cols)
        ]
    )
    return df.select(F.inline(pairs)).filter(F.col("value").isNotNull() & ~F.isnan("value"))


def quantiles(
    df: DataFrame,
    cols: Sequence[str],
    fractions: Sequence[float],
    listed: int = LISTED_VALUES,
) -> dict[str, dict[float, float | None]]:
    """Exact quantiles with linear interpolation; None for a column without values."""
    numbers = [F.col(c).cast("double") for c in cols]
    numbers = [F.when(~F.isnan(x), x) for x in numbers]
    found = df.agg(*[
        f(x).alias(f"{name}{i}") for i, x in enumerate(numbers) for name, f in (("n", F.count), ("low", F.min), ("high", F.max))
    ]).first()
    counts = {i: found[f"n{i}"] for i in range(len(cols)) if found[f"n{i}"] > 0}
    bounds = {i: (found[f"low{i}"], found[f"high{i}"]) for i in counts}
    spots = {i: {q: (n - 1) * q for q in fractions} for i, n in counts.items()}
    ranks = {
        i: [r for at in wanted.values() for r in (math.floor(at), math.ceil(at))]
        for i, wanted in spots.items()
    }
    stats = order_statistics(long_values(df, cols), ranks, counts, listed, bounds) if ranks else {}
    result: dict[str, dict[float, float | None]] = {c: dict.fromkeys(fractions) for c in cols}
    for i, wanted in spots.items():
        for q, at in wanted.items():
            lower = stats[(i, math.floor(at))].value
            upper = stats[(i, math.ceil(at))].value
            part = at - math.floor(at)
            # no arithmetic where none is needed: the ends may be infinite
            result[cols[i]][q] = lower if lower == upper or not part else lower + (upper - lower) * part
    return result


def modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str]:
    """Most frequent non-null value per column as text, the smallest on ties; absent if all null.

    Values of all columns are counted together; counting is combined map-side, so a
    hot value costs one row per task.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for c in cols]
    )
    top = (
        df.select(F.inline(pairs))
        .filter(F.col("value").isNotNull())
        .groupBy("key", "value")
        .agg(F.count("*").alias("n"))
        .groupBy("key")
        .agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    )
    return {row["key"]: row["mode"] for row in top.collect()}
