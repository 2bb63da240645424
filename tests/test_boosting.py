"""Histogram boosting against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortloom.operators import boosting as b
from cohortloom.operators import training as tr


def plain_tree(x, g, h, depth, penalty=1.0, least=1.0, node=1):
    """Best cuts by trying every value of every feature with missing values on both sides."""
    best = None
    whole = g.sum() ** 2 / (h.sum() + penalty)
    for f in range(x.shape[1]):
        for cut in [*sorted(set(x[~np.isnan(x[:, f]), f]))[:-1], math.inf]:
            for side in (True, False):
                left = np.where(np.isnan(x[:, f]), side, x[:, f] <= cut)
                gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
                if hl < least or hr < least - 1e-12:
                    continue
                gain = round(gl**2 / (hl + penalty) + gr**2 / (hr + penalty) - whole, b.GAIN_DECIMALS)
                if gain > 0 and (best is None or gain > best[0]):
                    best = gain, f, cut, side, left
    if not depth or best is None:
        return {}, {node: -g.sum() / (h.sum() + penalty)}
    gain, f, cut, side, left = best
    splits, values = {node: (f, cut, side, gain)}, {}
    for child, part in ((2 * node, left), (2 * node + 1, ~left)):
        more, leaf = plain_tree(x[part], g[part], h[part], depth - 1, penalty, least, child)
        splits.update(more)
        values.update(leaf)
    return splits, values


def sample(n=600, seed=1):
    rng = np.random.default_rng(seed)
    x = np.stack([rng.integers(0, 12, n), rng.integers(0, 60, n) / 4, rng.integers(0, 5, n)], 1).astype(float)
    x[rng.random(x.shape) < 0.15] = np.nan
    odds = np.where(np.isnan(x[:, 0]), 0.9, np.where(x[:, 0] > 6, 0.8, 0.2))
    odds = np.where(x[:, 1] > 9, 1 - odds, odds)
    return x, (rng.random(n) < odds).astype(float)


def frame(spark, x, y):
    rows = [(i, list(map(float, a)), float(t)) for i, (a, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "i bigint, a array<double>, label double")
    values = F.transform(F.col("a").cast("array<double>"), lambda v: F.coalesce(v, F.lit(float("nan"))))
    return df.select("i", array_to_vector(values).alias("features"), "label").repartition(4)


def test_trees_are_those_of_plain_loops(spark):
    x, y = sample()
    model = b.GainBoosting(maxIter=3, maxDepth=3, stepSize=0.3).fit(frame(spark, x, y))
    margin = np.zeros(len(y))
    for tree in model.trees:
        p = 1 / (1 + np.exp(-margin))
        splits, values = plain_tree(x, p - y, p * (1 - p), 3)
        assert {n: (s.feature, s.cut, s.missing_left) for n, s in tree.splits.items()} == {n: s[:3] for n, s in splits.items()}
        for n, s in tree.splits.items():
            assert s.gain == pytest.approx(splits[n][3], abs=1e-6)
        assert tree.values == pytest.approx({n: 0.3 * v for n, v in values.items()})
        margin += tree.scores(x)
    scored = model.transform(frame(spark, x, y)).select("i", "probability", "prediction").collect()
    for r in scored:
        assert r["probability"][1] == pytest.approx(1 / (1 + math.exp(-margin[r["i"]])))
        assert r["prediction"] == (margin[r["i"]] > 0)


def test_many_values_are_cut_at_quantiles(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 2))
    y = (x[:, 1] > 0.3).astype(float)
    model = b.GainBoosting(maxIter=2, maxDepth=2, maxBins=64).fit(frame(spark, x, y))
    assert model.importances[1] > 0.9 and abs(model.trees[0].splits[1].cut - 0.3) < 0.06
    cuts = b.cut_points(frame(spark, x, y).select(F.lit(1.0).alias("one"), F.lit(None).cast("double").alias("none")), ["one", "none"])
    assert cuts == [[], []]


@pytest.mark.parametrize("count", [1, 31, 32, 33, 255])
def test_bins_count_the_cuts_below(spark, count):
    cuts = [float(i) for i in range(count)]
    values = [None, float("nan"), -1.0, 0.0, 0.5, count - 1.0, count - 0.5, 1e9]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    found = [r[0][0] for r in df.select(b._bins([F.col("v")], [cuts])).collect()]
    assert found == [-1, -1, *(sum(c < v for c in cuts) for v in values[2:])]


def test_samples_and_odd_tables(spark):
    x, y = sample(300, 2)
    options = {"maxIter": 4, "maxDepth": 2, "subsamplingRate": 0.6, "featureShare": 0.7, "idCol": "i"}
    one, two = (b.GainBoosting(**options).fit(frame(spark, x, y)) for _ in range(2))
    assert [t.values for t in one.trees] == [t.values for t in two.trees]
    assert len({tuple(sorted({s.feature for s in t.splits.values()})) for t in one.trees}) > 1
    assert b.GainBoosting(maxIter=2).fit(frame(spark, x[:0].reshape(0, 3), y[:0]).where("false")).trees == []
    same = b.GainBoosting(maxIter=1).fit(frame(spark, np.ones((20, 2)), y[:20]))
    assert same.trees[0].splits == {} and same.importances == [0, 0]


def test_family_in_experiments(spark):
    x, y = sample(800, 3)
    df = spark.createDataFrame(pd.DataFrame({"i": range(800), "u": np.nan_to_num(x[:, 0], nan=20), "v": np.nan_to_num(x[:, 1]), "y": y.astype(int)}))
    split = df.withColumn("split", F.when(F.col("i") % 4 == 0, "test").otherwise("train"))
    config = tr.Config("gain_boosted", strategy="downsample_balanced", params={"maxIter": 10, "maxDepth": 3})
    found = {r["metric_name"]: r["mean"] for r in tr.evaluate(split, ["u", "v"], [config], "i", "y", runs=1).collect()}
    assert found["roc_auc"] > 0.75
    kept, table = tr.select_features(df, ["u", "v"], "y", min_keep=1, params={"maxIter": 3, "maxDepth": 2}, family="gain_boosted")
    assert kept and abs(sum(r["importance"] for r in table.collect()) - 1) < 1e-9


def test_search_leaves_configurations_alone(spark):
    x, y = sample(400, 6)
    df = spark.createDataFrame([(i, float(np.nan_to_num(a[0])), int(t)) for i, (a, t) in enumerate(zip(x, y))], "i bigint, u double, y int")
    split = df.withColumn("split", F.when(F.col("i") % 4 == 0, "test").otherwise("train"))
    config = tr.Config("forest", params={"numTrees": 2})
    _, used = tr.evaluate_tuned(split, ["u"], [config], "i", "y", runs=1, grids={"forest": {"maxDepth": [1, 2]}}, folds=2)
    assert config.params == {"numTrees": 2}
    assert used[0].params["numTrees"] == 2 and used[0].params["maxDepth"] in (1, 2)
