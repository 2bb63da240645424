"""Kernel attribution against exact Shapley values by enumeration."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import training as tr
from cohortloom.operators.kernel_attribution import coalitions, kernel_attribution, regression
from cohortloom.plans.audit import explained

NAMES = list("abcdef")


def plain_shapley(score, x, background):
    size = len(x)

    def value(members):
        mixed = background.copy()
        mixed[:, list(members)] = x[list(members)]
        return score(mixed).mean()

    phi = np.zeros(size)
    for i in range(size):
        rest = [j for j in range(size) if j != i]
        for k in range(size):
            for members in itertools.combinations(rest, k):
                weight = math.factorial(k) * math.factorial(size - k - 1) / math.factorial(size)
                phi[i] += weight * (value((*members, i)) - value(members))
    return phi


def test_exact_for_six_features(spark):
    rng = np.random.default_rng(3)
    data = rng.normal(size=(30, 6))

    def score(m):
        return m[:, 0] * m[:, 1] + np.sin(m[:, 2]) * m[:, 3] + np.maximum(m[:, 4], m[:, 5]) ** 2

    expression = F.expr("a * b + sin(c) * d + pow(greatest(e, f), 2)")
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(data)], "i bigint, " + ", ".join(f"{n} double" for n in NAMES))
    background = df.where("i < 12")
    found = kernel_attribution(df, lambda rows: rows.withColumn("score", expression), NAMES, "i", background).collect()
    assert len(found) == 30
    for r in found:
        assert [r[f"phi_{n}"] for n in NAMES] == pytest.approx(plain_shapley(score, data[r["i"]], data[:12]), abs=1e-9)


def test_few_coalitions_still_add_up():
    rng = np.random.default_rng(4)
    for size in (1, 2, 9, 30):
        table, weights = coalitions(size, 100)
        assert len(table) <= 100 and len(set(map(tuple, table))) == len(table)
        numbers = regression(table, weights)
        slopes = rng.normal(size=size)
        # an additive score is explained whatever the coalitions
        scores = np.r_[0, slopes.sum(), table @ slopes] + 5
        assert numbers @ scores == pytest.approx(slopes, abs=1e-8)
        rough = rng.normal(size=len(scores))
        assert (numbers @ rough).sum() == pytest.approx(rough[1] - rough[0])


def test_network_is_explained_and_adds_up(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), float(c), int(a + b > 1)) for i, (a, b, c) in enumerate(rng.random((200, 3)))]
    df = spark.createDataFrame(rows, "i bigint, a double, b double, c double, y int")
    model = tr.refit(df, ["a", "b", "c"], tr.Config("network", strategy="oversample_1.0", params={"hidden": [4], "maxIter": 40}), "i", "y")
    parts = explained(df.drop("y"), model, ["a", "b", "c"], "i")
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(df).select("i", vector_to_array("probability")[1].alias("p"))
    gap = parts.join(scored, "i").select((F.col("p") - F.col("phi_a") - F.col("phi_b") - F.col("phi_c")).alias("base"))
    low, high = gap.agg(F.min("base"), F.max("base")).first()
    assert high - low < 1e-9 and 0 < low < 1
    sizes = parts.agg(*[F.avg(F.abs(f"phi_{n}")).alias(n) for n in "abc"]).first()
    assert sizes["c"] < sizes["a"] and sizes["c"] < sizes["b"]


def test_empty_tables(spark):
    df = spark.createDataFrame([], "i bigint, a double")
    assert kernel_attribution(df, lambda rows: rows.withColumn("score", F.col("a")), ["a"], "i").count() == 0
