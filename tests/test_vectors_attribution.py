"""Vector reduction and attribution against numpy and brute force."""

from itertools import combinations
from math import factorial

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from cohortloom.operators import attribution as a
from cohortloom.operators import training as tr
from cohortloom.operators import vectors as v
from cohortloom.operators.columns import expand_vector
from cohortloom.operators.tree_paths import leaf_paths, path_contributions


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(1)
    low = rng.normal(size=(200, 3)) @ rng.normal(size=(3, 8)) + 0.05 * rng.normal(size=(200, 8))
    low[:, 7] = 4.0
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(low)]
    rows += [(900, None), (901, [float("nan")] * 8)]
    return low, spark.createDataFrame(rows, "id int, embedding array<double>")


def test_reduction_matches_a_decomposition(vectors):
    matrix, df = vectors
    reduction = v.fit_reduction(df, "embedding")
    std = matrix.std(axis=0)
    scaled = (matrix - matrix.mean(axis=0)) / np.where(std < 1e-12, 1, std)
    _, singular, axes = np.linalg.svd(scaled, full_matrices=False)
    ratios = singular**2 / (singular**2).sum()
    kept = int(np.searchsorted(np.cumsum(ratios), 0.95, side="right") + 1)
    assert reduction.kept == kept
    assert np.allclose(reduction.variance, ratios, atol=1e-8)
    found = {r["id"]: r["pca"] for r in v.apply_reduction(df, "embedding", reduction).collect()}
    assert found[900] is None and found[901] is None
    expected = scaled @ axes[:kept].T
    ours = np.array([found[i] for i in range(200)])
    # the sign of a component is free
    signs = np.sign((ours * expected).sum(axis=0))
    assert np.allclose(ours, expected * signs, atol=1e-6)
    report = v.reduction_report(df, "embedding", reduction).first()
    assert (report["valid_rows"], report["missing_rows"]) == (200, 2)
    assert report["variance_kept"] > 0.95


def test_reduction_needs_vectors(vectors):
    with pytest.raises(ValueError):
        v.fit_reduction(vectors[1].filter("id >= 900"), "embedding")


def test_text_vectors_keep_null(spark):
    df = spark.createDataFrame([("one two",), (None,), ("",)], "t string")
    model = v.fit_text_vectors(df, "t", 16)
    found = [r["embedding"] for r in v.text_vectors(df, "t", model).collect()]
    assert len(found[0]) == 16 and found[1] is None and sum(found[2]) == 0


def test_batched_encoder_sees_bounded_batches(spark):
    def make():
        def encode(texts):
            assert len(texts) <= 4
            return np.array([[len(x), len(texts)] for x in texts])

        return encode

    df = spark.range(30).select(F.when(F.col("id") != 3, F.col("id").cast("string")).alias("t"))
    found = v.embed(df, "t", make, batch_size=4).collect()
    assert all((r["t"] is None) == (r["embedding"] is None) for r in found)


def _fitted(spark, family):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 4))
    y = ((x[:, 0] * x[:, 1] > 0) | (x[:, 2] > 1)).astype(float)
    rows = [(i, [float(t) for t in r], float(t)) for i, (r, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "id int, x array<double>, label double").select(
        "id", array_to_vector("x").alias("features"), "label"
    )
    params = {"maxIter": 3, "maxDepth": 3} if family == "boosted" else {"numTrees": 3, "maxDepth": 3}
    return x, df, tr.estimator(family, params).fit(df)


@pytest.mark.parametrize("family", ["boosted", "forest"])
def test_tree_attribution_is_the_shapley_value(spark, family):
    x, df, model = _fitted(spark, family)
    paths, base = leaf_paths(model)
    found = {r["id"]: r for r in a.tree_attribution(df, model).collect()}

    def value(row, known):
        total = 0.0
        for path in paths:
            weight = path.value
            for f, low, high, share in zip(path.features, path.low, path.high, path.share):
                weight *= float(low < row[f] <= high) if f in known else share
            total += weight
        return total

    for i in (0, 17, 399):
        phi = []
        for j in range(4):
            others = [k for k in range(4) if k != j]
            total = 0.0
            for size in range(4):
                for subset in combinations(others, size):
                    gain = value(x[i], {*subset, j}) - value(x[i], set(subset))
                    total += factorial(size) * factorial(3 - size) / factorial(4) * gain
            phi.append(total)
        assert np.allclose(found[i]["phi"], phi, atol=1e-9)
        assert found[i]["base"] == pytest.approx(base)


@pytest.mark.parametrize("family, column", [("boosted", "rawPrediction"), ("forest", "probability")])
@pytest.mark.parametrize("leaves", [5, 50_000])
def test_tree_attribution_adds_up(spark, monkeypatch, family, column, leaves):
    monkeypatch.setattr(a, "LEAVES_PER_PASS", leaves)
    _, df, model = _fitted(spark, family)
    scores = {r["id"]: r[column][1] for r in model.transform(df).collect()}
    for row in a.tree_attribution(df, model).collect():
        assert row["base"] + sum(row["phi"]) == pytest.approx(scores[row["id"]], abs=1e-9)


def test_linear_attribution_adds_up(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, 5.0)], "p double, q double")
    rows = a.linear_attribution(df, {"p": 2.0, "q": -1.0}).collect()
    assert [(r["phi_p"], r["phi_q"]) for r in rows] == [(-2.0, 1.5), (2.0, -1.5)]


def _table(spark, **weights):
    return spark.createDataFrame(list(weights.items()), "feature string, mean_abs double")


def test_grouping_follows_shared_prefixes(spark):
    table = _table(
        spark, is_nsclc=1.0, is_sclc=2.0, has_us_sites=4.0, has_dmc=8.0, phase=16.0, min_age=32.0,
        pca_emb_0=99.0,
    )
    found = {r["feature"]: r["mean_abs"] for r in a.group_features(table).collect()}
    assert found == {"is": 3.0, "has": 12.0, "phase": 16.0, "min_age": 32.0}


def test_importance_table(spark):
    table = _table(spark, a_b=1.0, c_d=3.0, pca_emb_1=9.0, e=2.0)
    rows = a.importance_table(table, 2).collect()
    assert [(r["rank"], r["feature"], r["feature_display"]) for r in rows] == [
        (1, "c_d", "C D"), (2, "e", "E"),
    ]


def test_leakage_audit(spark):
    names = a.name_table(spark, ["primary_completion_date", "status", "arms"])
    found = {r["pattern"]: r["matches"] for r in a.leakage_audit(names).collect()}
    assert found["completion_date"] == 1 and found["primary_completion_date"] == 1
    # a feature that is part of a pattern counts too
    assert found["overall_status"] == 1 and found["last_known_status"] == 1
    assert found["is_historical"] == 0 and len(found) == 9
    with pytest.raises(a.LeakageError, match="status"):
        a.require_no_leakage(names)
    a.require_no_leakage(a.name_table(spark, ["arms"]))


def test_direction(spark):
    rows = [("up", float(i), float(i)) for i in range(5)]
    rows += [("down", float(i), -float(i)) for i in range(5)]
    rows += [("flat", 1.0, float(i)) for i in range(5)]
    points = spark.createDataFrame(pd.DataFrame(rows, columns=["feature", "value", "phi"]))
    found = {r["feature"]: r["direction"] for r in a.direction(points).collect()}
    assert found == {"up": "increases", "down": "decreases", "flat": "decreases"}


def test_feature_resolution():
    assert a.resolve_feature("b", ["ab", "b"]) == "b"
    assert a.resolve_feature("is", ["x", "is_a", "is_b"]) == "is_a"
    assert a.resolve_feature("zz", ["x"]) is None


def test_contributions_equal_the_shapley_formula():
    rng = np.random.default_rng(3)
    rows = rng.random((6, 7))
    paths = []
    for m in (0, 1, 2, 5, 7):
        features = np.sort(rng.choice(7, m, replace=False))
        low = np.where(rng.random(m) < 0.5, -np.inf, rng.random(m) * 0.5)
        paths.append((float(rng.normal()), features, low, low.clip(0) + 0.4, rng.random(m) * 0.9 + 0.05))
    expected = np.zeros((6, 7))
    for value, features, low, high, share in paths:
        m = len(features)
        for r, row in enumerate(rows):
            hit = (row[features] > low) & (row[features] <= high)

            def worth(known):
                return value * np.prod([hit[i] if i in known else share[i] for i in range(m)])

            for j in range(m):
                for size in range(m):
                    for known in combinations([i for i in range(m) if i != j], size):
                        weight = factorial(size) * factorial(m - 1 - size) / factorial(m)
                        expected[r, features[j]] += weight * (worth({*known, j}) - worth(set(known)))
    assert np.allclose(path_contributions(paths, rows, 7), expected)


def test_long_vectors_are_an_error(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],), (None,)], "v array<double>")
    wide = expand_vector(df, "v", 2, "v_").select("v_0", "v_1").collect()
    assert [tuple(r) for r in wide] == [(1.0, 2.0), (1.0, None), (None, None)]
    with pytest.raises(Exception, match="more than 1 elements"):
        expand_vector(df, "v", 1, "v_").collect()
