"""Gradient boosting of trees by histograms of first and second derivatives.

Features are cut into bins once, at most ``max_bins`` each, all distinct values where there are no more.
For every level of a tree, one map-side combined aggregate sums the loss's first and second
derivatives per (node, feature, bin); running sums over the bins give every cut's gain with missing values on
either side, and the best cut of each node reaches the driver. So what travels has the size of the model times
the bins, whatever the number of rows. Rows are relabelled in place with their new node.

With G and H the sums of a node, its value is -G / (H + penalty), and a cut's gain is
GL^2 / (HL + penalty) + GR^2 / (HR + penalty) - G^2 / (H + penalty). Equal gains go to the first feature, the lowest
cut, and missing values to the left.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import astuple, dataclass, field, fields

import numpy as np
import pandas as pd
from pyspark.ml.base import Estimator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.operators.sampling import DRAW_LIMIT, draw
from cohortloom.session import cut_lineage
from cohortloom.sources.stored import StoredModel

MAX_BINS = 256
#: Gains are compared with so many decimals, so that sums added in another order give the same tree.
GAIN_DECIMALS = 9
MISSING = -1


@dataclass
class Split:
    """A cut of a node: values up to ``cut`` go left, missing ones as ``missing_left`` says."""

    feature: int
    cut: float
    bin: int
    missing_left: bool
    gain: float
    rows: int


@dataclass
class Tree:
    """Nodes by number: the root is 1, the children of n are 2n and 2n + 1."""

    splits: dict[int, Split] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def scores(self, x: np.ndarray) -> np.ndarray:
        node = np.ones(len(x), np.int64)
        for _ in range(max(self.splits or {1: None}).bit_length()):
            for number in np.unique(node).tolist():
                split = self.splits.get(number)
                if split:
                    here = np.flatnonzero(node == number)
                    value = x[here, split.feature]
                    left = np.where(np.isnan(value), split.missing_left, value <= split.cut)
                    node[here] = 2 * number + ~left
        return np.array([self.values.get(n, 0.0) for n in node.tolist()])


def with_missing(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    """Columns as one vector, null as NaN, which counts as missing."""
    values = [F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for c in cols]
    return df.withColumn(out, array_to_vector(F.array(*values)))


def cut_points(df: DataFrame, cols: Sequence[str], max_bins: int = MAX_BINS) -> list[list[float]]:
    """Ascending cuts per column: all values but the largest if there are at most ``max_bins``, else quantiles."""
    numbers = [F.col(c).cast("double") for c in cols]
    counts = df.agg(*[F.approx_count_distinct(F.nanvl(x, F.lit(None)), 0.02).alias(f"n{i}") for i, x in enumerate(numbers)]).first()
    few = [i for i in range(len(cols)) if counts[f"n{i}"] <= max_bins * 0.9]
    cuts: list[list[float]] = [[] for _ in cols]
    if few:
        found = df.agg(*[F.array_sort(F.collect_set(F.when(~F.isnan(numbers[i]), numbers[i]))).alias(f"v{i}") for i in few]).first()
        for i in few:
            cuts[i] = found[f"v{i}"][:-1]
    many = [i for i in range(len(cols)) if i not in few]
    if many:
        shares = [k / max_bins for k in range(1, max_bins)]
        plain = df.select(*[F.when(~F.isnan(numbers[i]), numbers[i]).alias(f"c{i}") for i in many])
        for i, found in zip(many, plain.approxQuantile([f"c{i}" for i in many], shares, 1 / (8 * max_bins))):
            cuts[i] = sorted(set(found))
    return cuts


def _bins(values: Sequence[Column], cuts: list[list[float]]) -> Column:
    """Number of cuts below each value, ``MISSING`` for missing ones; by halving, in the JVM."""

    def place(value: Column, low: int, high: int, own: list[float]) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(value <= own[middle], place(value, low, middle, own)).otherwise(place(value, middle + 1, high, own))

    return F.array(*[
        F.when(x.isNull() | F.isnan(x), F.lit(MISSING)).otherwise(
            place(x, 0, len(own), own) if len(own) <= 32 else _halved(x, own)
        ).cast("int")
        for x, own in zip(values, cuts)
    ])


def _halved(value: Column, own: list[float]) -> Column:
    """The same by search in an array, for many cuts."""
    listed = F.array(*[F.lit(float(c)) for c in own])
    steps = F.sequence(F.lit(1), F.lit(max(1, math.ceil(math.log2(len(own) + 1)))))
    start = F.struct(F.lit(0).alias("low"), F.lit(len(own)).alias("high"))

    def halve(at: Column, _: Column) -> Column:
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        left = value <= listed[middle]
        moved = F.struct(
            F.when(left, at["low"]).otherwise(middle + 1).alias("low"), F.when(left, middle).otherwise(at["high"]).alias("high")
        )
        return F.when(at["low"] < at["high"], moved).otherwise(at)

    return F.aggregate(steps, start, halve, lambda at: at["low"])


def level_histogram(rows: DataFrame) -> DataFrame:
    """(node, feature, bin) sums of both derivatives and rows, of all rows that are in a node."""
    each = rows.where("node > 0").select("node", "g", "h", F.posexplode("bins").alias("feature", "bin"))
    return each.groupBy("node", "feature", "bin").agg(
        F.sum("g").alias("g"), F.sum("h").alias("h"), F.count("*").alias("n")
    )


def best_splits(histogram: DataFrame, penalty: float, least_weight: float, features: Sequence[int] | None = None) -> DataFrame:
    """node, g, h, n and the best cut (feature, bin, missing_left, gain) of each node; no cut: null."""
    if features is not None:
        histogram = histogram.where(F.col("feature").isin(list(features)))
    of_feature = Window.partitionBy("node", "feature")
    upto = of_feature.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    present = F.col("bin") != MISSING

    def summed(name: str, condition: Column, window) -> Column:
        return F.sum(F.when(condition, F.col(name)).otherwise(0)).over(window)

    cuts = histogram.select(
        "node", "feature", "bin",
        *[F.sum(c).over(of_feature).alias(f"{c}_all") for c in ("g", "h", "n")],
        *[summed(c, present, upto).alias(f"{c}_low") for c in ("g", "h")],
        *[summed(c, ~present, of_feature).alias(f"{c}_none") for c in ("g", "h")],
    ).where(present)
    sides = cuts.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("missing_left"))
    left = {c: F.col(f"{c}_low") + F.when(F.col("missing_left"), F.col(f"{c}_none")).otherwise(0) for c in ("g", "h")}
    right = {c: F.col(f"{c}_all") - left[c] for c in ("g", "h")}

    def part(g: Column, h: Column) -> Column:
        return g * g / (h + penalty)

    gain = part(left["g"], left["h"]) + part(right["g"], right["h"]) - part(F.col("g_all"), F.col("h_all"))
    allowed = (left["h"] >= least_weight) & (right["h"] >= least_weight)
    scored = sides.withColumn("gain", F.when(allowed, F.round(gain, GAIN_DECIMALS)))
    # largest gain, then first feature, lowest cut, missing values left
    order = F.when(
        F.col("gain") > 0, F.struct("gain", -F.col("feature"), -F.col("bin"), F.col("missing_left"))
    )
    chosen = F.struct("feature", "bin", "missing_left", "gain")
    return scored.groupBy("node").agg(
        F.first("g_all").alias("g"), F.first("h_all").alias("h"), F.first("n_all").alias("n"),
        F.max_by(F.when(order.isNotNull(), chosen), order).alias("cut"),
    )


def grow(
    rows: DataFrame, cuts: list[list[float]], depth: int, rate: float, penalty: float = 1.0, least_weight: float = 1.0,
    least_gain: float = 0.0, features: Sequence[int] | None = None,
) -> tuple[Tree, DataFrame]:
    """One tree over rows (bins, g, h, node: 1 or, for rows that do not count, -1), and the rows with their leaf."""
    tree = Tree()
    for level in range(depth + 1):
        found = best_splits(level_histogram(rows.where(F.abs("node") >= 1 << level)), penalty, least_weight, features).collect()
        moved = []
        for row in found:
            cut = row["cut"]
            if level == depth or cut is None or cut["gain"] <= least_gain:
                tree.values[row["node"]] = -rate * row["g"] / (row["h"] + penalty)
            else:
                # behind the last cut: all values left, missing ones right
                value = [*cuts[cut["feature"]], math.inf][cut["bin"]]
                split = Split(cut["feature"], value, cut["bin"], cut["missing_left"], cut["gain"], row["n"])
                tree.splits[row["node"]] = split
                moved.append((row["node"], split.feature, split.bin, split.missing_left))
        if not moved:
            break
        # at most 2 ** depth rows
        table = rows.sparkSession.createDataFrame(moved, "at int, feature int, upto int, missing_left boolean")
        joined = rows.join(F.broadcast(table), F.abs("node") == F.col("at"), "left")
        own = F.col("bins")[F.col("feature")]
        left = F.when(own == MISSING, F.col("missing_left")).otherwise(own <= F.col("upto"))
        child = F.signum("node").cast("int") * (2 * F.abs("node") + F.when(left, 0).otherwise(1))
        rows = joined.withColumn("node", F.when(F.col("at").isNull(), F.col("node")).otherwise(child)).select(*rows.columns)
    return tree, rows


class GainBoosting(Estimator):
    """Estimator over a vector column (NaN: missing): ``probability``, ``rawPrediction`` and ``prediction``."""

    def __init__(
        self, featuresCol: str = "features", labelCol: str = "label", weightCol: str | None = None, idCol: str | None = None,
        maxIter: int = 100, maxDepth: int = 6, stepSize: float = 0.3, penalty: float = 1.0, leastWeight: float = 1.0,
        leastGain: float = 0.0, subsamplingRate: float = 1.0, featureShare: float = 1.0, maxBins: int = MAX_BINS, seed: int = fv.SEED,
    ):
        super().__init__()
        self.options = {k: v for k, v in locals().items() if k not in ("self", "__class__")}

    def _fit(self, dataset: DataFrame) -> GainBoosted:
        o = self.options
        first = dataset.select(o["featuresCol"]).first()
        size = len(first[0]) if first else 0
        if not size:
            return GainBoosted(o["featuresCol"], 0)
        names = [f"x{i}" for i in range(size)]
        values = vector_to_array(o["featuresCol"])
        wide = dataset.select(
            *[values[i].alias(n) for i, n in enumerate(names)], F.col(o["labelCol"]).cast("double").alias("y"),
            F.lit(1.0).alias("w") if o["weightCol"] is None else F.col(o["weightCol"]).cast("double").alias("w"),
            (F.col(o["idCol"]).cast("string") if o["idCol"] else F.xxhash64(o["featuresCol"]).cast("string")).alias("id"),
        )
        cuts = cut_points(wide, names, o["maxBins"])
        rows = cut_lineage(wide.select("id", "y", "w", F.lit(0.0).alias("margin"), _bins([F.col(n) for n in names], cuts).alias("bins")))
        model = GainBoosted(o["featuresCol"], size)
        for number in range(o["maxIter"]):
            rng = np.random.default_rng((o["seed"], number))
            p = 1 / (1 + F.exp(-F.col("margin")))
            taken = draw(F.col("id"), o["seed"] + number) < int(DRAW_LIMIT * o["subsamplingRate"])
            started = rows.select(
                "*", (F.col("w") * (p - F.col("y"))).alias("g"), (F.col("w") * p * (1 - p)).alias("h"),
                F.when(taken, 1).otherwise(-1).alias("node"),
            )
            share = None
            if o["featureShare"] < 1:
                share = sorted(rng.choice(size, max(1, int(size * o["featureShare"])), replace=False).tolist())
            tree, placed = grow(
                started, cuts, o["maxDepth"], o["stepSize"], o["penalty"], o["leastWeight"], o["leastGain"], share
            )
            model.trees.append(tree)
            if number + 1 < o["maxIter"]:
                leaves = dataset.sparkSession.createDataFrame([(n, v) for n, v in tree.values.items()] or [(0, 0.0)], "at int, value double")
                rows = cut_lineage(
                    placed.join(F.broadcast(leaves), F.abs("node") == F.col("at"), "left")
                    .select("id", "y", "w", (F.col("margin") + F.coalesce("value", F.lit(0.0))).alias("margin"), "bins")
                )
        return model


class GainBoosted(StoredModel):
    """Trees of a boosting; ``importances`` are average gains per cut, scaled to 1 in all."""

    def __init__(self, features: str, size: int, trees: list[Tree] | None = None):
        super().__init__()
        self.features, self.size, self.trees = features, size, trees or []

    def state(self):
        arrays = {}
        for i, tree in enumerate(self.trees):
            arrays[f"splits/{i}"] = np.array(
                [(n, *astuple(s)) for n, s in tree.splits.items()], float
            ).reshape(-1, 1 + len(fields(Split)))
            arrays[f"values/{i}"] = np.array(list(tree.values.items()), float).reshape(-1, 2)
        return {"features": self.features, "size": self.size, "trees": len(self.trees)}, arrays

    @classmethod
    def from_state(cls, settings, arrays):
        trees = []
        for i in range(settings["trees"]):
            tree = Tree()
            for node, feature, cut, place, left, gain, rows in arrays[f"splits/{i}"].tolist():
                tree.splits[int(node)] = Split(int(feature), cut, int(place), bool(left), gain, int(rows))
            tree.values = {int(n): v for n, v in arrays[f"values/{i}"].tolist()}
            trees.append(tree)
        return cls(settings["features"], settings["size"], trees)

    @property
    def importances(self) -> list[float]:
        sums, counts = np.zeros(self.size), np.zeros(self.size)
        for tree in self.trees:
            for split in tree.splits.values():
                sums[split.feature] += split.gain
                counts[split.feature] += 1
        average = sums / np.maximum(counts, 1)
        return (average / average.sum() if average.sum() else average).tolist()

    def _transform(self, dataset: DataFrame) -> DataFrame:
        shipped = dataset.sparkSession.sparkContext.broadcast(self.trees)

        @F.pandas_udf("double")
        def margins(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for part in parts:
                x = np.stack(part.to_numpy()) if len(part) else np.zeros((0, 1))
                yield pd.Series(sum((t.scores(x) for t in shipped.value), np.zeros(len(x))))

        margin = margins(vector_to_array(self.features))
        scored = dataset.withColumn("_margin", margin)
        p = 1 / (1 + F.exp(-F.col("_margin")))
        return (
            scored.withColumn("rawPrediction", array_to_vector(F.array(-F.col("_margin"), F.col("_margin"))))
            .withColumn("probability", array_to_vector(F.array(1 - p, p)))
            .withColumn("prediction", (F.col("_margin") > 0).cast("double")).drop("_margin")
        )


def split_table(model: GainBoosted, spark, names: Sequence[str]) -> DataFrame:
    """tree, node, feature, cut, missing_left, gain, rows: every cut of a model."""
    rows = [
        (t, n, names[s.feature], float(s.cut), s.missing_left, float(s.gain), s.rows)
        for t, tree in enumerate(model.trees) for n, s in sorted(tree.splits.items())
    ]
    return spark.createDataFrame(rows, "tree int, node int, feature string, cut double, missing_left boolean, gain double, rows bigint")
