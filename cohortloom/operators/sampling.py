"""Deterministic splits and class resampling with exact counts.

Every row gets a draw that depends only on its id and the seed. A part of a given
size is "the rows with the smallest draws of their class", found through an exact
threshold on the draw: rows are labelled in place by comparing two numbers, no
class is ever sorted or collected, and a rerun gives the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.operators.quantiles import rank_values, searches
from cohortloom.operators.ranking import with_row_number
from cohortloom.session import cut_lineage

# classes whose table is broadcast to the rows; more are joined by class
BROADCAST_CLASSES = 50_000
# --- fixed value: draws are the first 13 hex digits of an MD5, so below 2 ** 52
DRAW_LIMIT = 1 << 52


def draw(id_col: Column, seed: int) -> Column:
    """Pseudo-random 52-bit number of an id; the same in any engine that has MD5."""
    digest = F.md5(F.concat_ws(":", id_col.cast("string"), F.lit(str(seed))))
    return F.conv(F.left(digest, F.lit(13)), 16, 10).cast("bigint")


def class_counts(df: DataFrame, label: str) -> dict[object, int]:
    """Rows per class, null labels left out. Driver: one entry per class."""
    rows = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("n")).collect()
    return {row[label]: row["n"] for row in sorted(rows, key=lambda r: r[label])}


def _with_classes(df: DataFrame, label: str, rows: list[tuple], schema: str) -> DataFrame:
    """Rows with the columns of their class; ``rows`` are (class, ...), other classes get nulls."""
    kind = df.schema[label].dataType.simpleString()
    table = df.sparkSession.createDataFrame(rows, f"_name {kind}, {schema}")
    table = F.broadcast(table) if len(rows) <= BROADCAST_CLASSES else table
    return df.join(table, F.col(label) == F.col("_name"), "left").drop("_name")


def assign_parts(
    df: DataFrame,
    id_col: str,
    sizes: dict[object, Sequence[int]],
    seed: int,
    label: str | None = None,
    out: str = "part",
) -> DataFrame:
    """Number the rows of each class by part: part i takes ``sizes[class][i]`` rows.

    Parts are filled in draw order, ties by id. Rows of a class that is not in
    ``sizes`` get a null part. Without ``label`` all rows form one class.
    """
    drawn = df.withColumn("_draw", draw(F.col(id_col), seed))
    cuts = [[sum(parts[: j + 1]) for j in range(len(parts) - 1)] for parts in sizes.values()]
    totals = [sum(parts) for parts in sizes.values()]
    # a cut at or before the first row is passed by all rows of the class
    passed = [sum(c <= 0 for c in cs) if total else 0 for cs, total in zip(cuts, totals)]
    rows = [(name, i, passed[i]) for i, name in enumerate(sizes)]
    if label:
        drawn = _with_classes(drawn, label, rows, "_class bigint, _passed int")
    else:
        drawn = drawn.withColumn("_class", F.lit(0).cast("bigint")).withColumn("_passed", F.lit(passed[0]))
    wanted = [
        (i, c, total) for i, (cs, total) in enumerate(zip(cuts, totals)) for c in sorted(set(cs)) if 0 < c < total
    ]
    times = [(i, c, cs.count(c)) for i, cs in enumerate(cuts) for c in set(cs)]
    if not wanted:
        return drawn.withColumn(out, F.col("_passed")).select(*df.columns, out)
    draws = drawn.filter(F.col("_class").isNotNull()).select(
        F.col("_class").alias("key"), F.col("_draw").alias("value"), F.col(id_col).alias("id")
    )
    spark = df.sparkSession
    bounds = {key: (0, DRAW_LIMIT) for key, _, _ in wanted}
    found = rank_values(draws.select("key", "value"), searches(draws, wanted, bounds), even=True)
    marks = _kept(
        found.join(spark.createDataFrame(times, "key bigint, rank bigint, times int"), ["key", "rank"])
        .withColumn("value", F.col("value").cast("bigint")), len(wanted)
    )
    tied = marks.where("rank > below").select("key", "rank", "value", (F.col("rank") - F.col("below")).alias("before"))
    if tied.isEmpty():
        # the usual case: draws have 52 bits
        marks = marks.withColumn("first_after", F.lit(None).cast(df.schema[id_col].dataType))
    else:
        # equal draws at a threshold: the ids decide, and only those needed are looked at
        order = Window.partitionBy("key", "rank").orderBy("id")
        firsts = (
            draws.join(_small(tied, len(wanted)), ["key", "value"])
            .withColumn("place", F.row_number().over(order)).where("place = before + 1")
            .select("key", "rank", F.col("id").alias("first_after"))
        )
        marks = marks.join(firsts, ["key", "rank"], "left")
    per_class = marks.groupBy(F.col("key").alias("_class")).agg(
        F.collect_list(F.struct("value", "times", "first_after")).alias("_marks")
    )
    number = F.col("_draw")

    def after(mark: Column) -> Column:
        at_it = (number == mark["value"]) & (mark["first_after"].isNull() | (F.col(id_col) >= mark["first_after"]))
        return F.when((number > mark["value"]) | at_it, mark["times"]).otherwise(0)

    steps = F.aggregate("_marks", F.col("_passed"), lambda total, mark: total + after(mark))
    part = F.when(F.col("_marks").isNull(), F.col("_passed")).otherwise(steps)
    labelled = drawn.join(_small(per_class, len(wanted)), "_class", "left")
    return labelled.withColumn(out, part.cast("int")).select(*df.columns, out)


def _kept(table: DataFrame, rows: int) -> DataFrame:
    """A table of ``rows`` rows that is not computed again: local if these are few, else stored."""
    if rows <= BROADCAST_CLASSES:
        return table.sparkSession.createDataFrame(table.collect(), table.schema)
    return cut_lineage(table)


def _small(table: DataFrame, rows: int) -> DataFrame:
    """A table of at most ``rows`` rows, broadcast if these are few."""
    return F.broadcast(table) if rows <= BROADCAST_CLASSES else table


def proportional_sizes(counts: dict[object, int], total: int) -> dict[object, int]:
    """Split ``total`` over the classes in proportion, the largest remainders rounded up."""
    rows = sum(counts.values())
    exact = {name: total * n / rows for name, n in counts.items()}
    sizes = {name: math.floor(x) for name, x in exact.items()}
    missing = total - sum(sizes.values())
    order = sorted(counts, key=lambda name: sizes[name] - exact[name])
    for name in order[:missing]:
        sizes[name] += 1
    return sizes


def split_sizes(
    counts: dict[object, int], test: float, validation: float
) -> dict[object, tuple[int, int, int]]:
    """Rows per class for (test, validation, train); held-out totals are rounded up."""
    rows = sum(counts.values())
    held = math.ceil(rows * test)
    kept = proportional_sizes(counts, rows - held)
    n_validation = math.ceil((rows - held) * validation)
    train = proportional_sizes(kept, rows - held - n_validation)
    return {name: (n - kept[name], kept[name] - train[name], train[name]) for name, n in counts.items()}


def assign_split(
    df: DataFrame,
    id_col: str,
    label: str,
    test: float = fv.TEST_FRACTION,
    validation: float = fv.VALIDATION_FRACTION,
    seed: int = fv.SEED,
    stratify: bool = True,
    out: str = "split",
) -> DataFrame:
    """Add ``split``: test, validation or train; rows without a label get null."""
    counts = class_counts(df, label)
    if stratify:
        sizes = split_sizes(counts, test, validation)
        parts = assign_parts(df, id_col, sizes, seed, label, "_part")
    else:
        sizes = split_sizes({True: sum(counts.values())}, test, validation)
        labelled = df.withColumn("_labelled", F.when(F.col(label).isNotNull(), F.lit(True)))
        parts = assign_parts(labelled, id_col, sizes, seed, "_labelled", "_part").drop("_labelled")
    name = F.when(F.col("_part") == 0, "test").when(F.col("_part") == 1, "validation")
    return parts.withColumn(out, name.when(F.col("_part") == 2, "train")).drop("_part")


def attach_split(df: DataFrame, splits: DataFrame, id_col: str, split: str = "split") -> DataFrame:
    """Give another view of the same rows the split of ``splits``, matched by id."""
    return df.join(splits.select(id_col, split), id_col)


def assign_folds(
    df: DataFrame, id_col: str, label: str, folds: int = fv.FOLDS, seed: int = fv.SEED, out: str = "fold"
) -> DataFrame:
    """Stratified folds 0..folds-1; sizes within a class differ by at most one."""
    sizes = {
        name: [n * (i + 1) // folds - n * i // folds for i in range(folds)]
        for name, n in class_counts(df, label).items()
    }
    return assign_parts(df, id_col, sizes, seed, label, out)


def _ends(counts: dict[object, int]) -> tuple[object, object]:
    """(minority, majority) class; the first one in class order on ties."""
    return min(counts, key=counts.get), max(counts, key=counts.get)


def downsample(
    df: DataFrame, label: str, id_col: str, ratio: float = 1.0, seed: int = fv.SEED
) -> DataFrame:
    """Keep int(minority * ratio) majority rows at most; all other rows stay."""
    counts = class_counts(df, label)
    minority, majority = _ends(counts)
    target = min(int(counts[minority] * ratio), counts[majority])
    sizes = {majority: (target, counts[majority] - target)}
    parts = assign_parts(df, id_col, sizes, seed, label, "_part")
    return parts.filter(F.coalesce(F.col("_part"), F.lit(0)) == 0).drop("_part")


def oversample(
    df: DataFrame, label: str, id_col: str, ratio: float = 1.0, seed: int = fv.SEED
) -> DataFrame:
    """Repeat minority rows, drawn with replacement, until there are int(majority * ratio).

    Originals stay. Each extra draws a row number; extras and numbered minority rows
    meet in an equi-join on that number, which is evenly spread by construction.
    """
    counts = class_counts(df, label)
    minority, majority = _ends(counts)
    extra = max(int(counts[majority] * ratio) - counts[minority], 0)
    if extra == 0:
        return df
    smaller = df.filter(F.col(label) == F.lit(minority))
    numbered = with_row_number(smaller, [F.col(id_col).asc()], "_row")
    picks = df.sparkSession.range(extra).select(
        (F.pmod(draw(F.col("id"), seed), F.lit(counts[minority])) + 1).alias("_row")
    )
    return df.unionByName(numbered.join(picks, "_row").select(*df.columns))


def rebalance(
    df: DataFrame,
    label: str,
    id_col: str,
    strategy: str,
    seed: int = fv.SEED,
    ratio: float | None = None,
) -> DataFrame:
    """Resample by strategy name; ``class_weight`` leaves the rows as they are."""
    if strategy not in fv.STRATEGY_RATIOS:
        raise ValueError(f"unknown strategy: {strategy}")
    target = fv.STRATEGY_RATIOS[strategy]
    if target is None:
        return df
    if strategy == "partial_downsample" and ratio is not None:
        target = ratio
    return downsample(df, label, id_col, target, seed)


def class_weights(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """Balanced weights: rows / (classes * rows of the class)."""
    counts = class_counts(df, label)
    rows = sum(counts.values())
    each = [(name, rows / (len(counts) * n)) for name, n in counts.items()]
    return _with_classes(df.drop(out), label, each, f"{out} double")


def sample_n(df: DataFrame, id_col: str, n: int, seed: int = fv.SEED) -> DataFrame:
    """At most ``n`` rows without replacement: those with the smallest draws."""
    return df.orderBy(draw(F.col(id_col), seed), F.col(id_col)).limit(n)
