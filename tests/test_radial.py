"""The radial classifier: its map, planted rings, and saved models."""

import math

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortloom.operators import radial as r
from cohortloom.operators import training as tr
from cohortloom.plans.audit import explained
from cohortloom.plans.experiments import final_config


def vectors(spark, x, labels=None):
    labels = np.zeros(len(x)) if labels is None else labels
    rows = [(i, list(map(float, v)), float(y)) for i, (v, y) in enumerate(zip(x, labels))]
    df = spark.createDataFrame(rows, "i bigint, a array<double>, label double")
    return df.select("i", array_to_vector("a").alias("features"), "label").repartition(3)


def rings(spark, n=900):
    rng = np.random.default_rng(5)
    angle, inner = rng.uniform(0, 2 * math.pi, n), np.arange(n) % 2
    radius = np.where(inner == 1, 1.0, 3.0) + rng.normal(0, 0.3, n)
    return vectors(spark, np.stack([radius * np.cos(angle), 100 * radius * np.sin(angle)], 1), inner)


def area(rows):
    p, y = (np.array([row[k] for row in rows]) for k in ("p", "label"))
    return (np.sign(p[y == 1][:, None] - p[y == 0][None]) + 1).mean() / 2


def scores(model, rows):
    return model.transform(rows).select("i", "label", vector_to_array("probability")[1].alias("p")).orderBy("i").collect()


def test_the_map_keeps_similarities(spark):
    x = np.random.default_rng(1).normal(size=(60, 3))
    model = r.RadialMap(landmarks=20).fit(vectors(spark, x))
    assert model.gamma == pytest.approx(1 / (3 * x.var()))
    found = model.transform(vectors(spark, x)).orderBy("i").select(vector_to_array("radial").alias("v")).collect()
    image = np.array([row["v"] for row in found])
    plain = np.exp(-model.gamma * ((x[:, None] - model.landmarks[None]) ** 2).sum(2))
    assert np.allclose(image @ model.image(model.landmarks).T, plain, atol=1e-6)
    # with every row a landmark the map is exact for all pairs
    whole = r.RadialMap(landmarks=60, gamma=0.7).fit(vectors(spark, x))
    image = whole.image(x)
    assert np.allclose(image @ image.T, np.exp(-0.7 * ((x[:, None] - x[None]) ** 2).sum(2)), atol=1e-6)


def test_landmarks_are_distinct_and_do_not_depend_on_partitions(spark):
    x = np.vstack([np.zeros((200, 2)), np.random.default_rng(2).normal(size=(30, 2))])
    one, two = (r.RadialMap(landmarks=25).fit(vectors(spark, x).repartition(n)) for n in (1, 5))
    assert np.array_equal(one.landmarks, two.landmarks)
    assert len(np.unique(one.landmarks, axis=0)) == 25
    same = r.RadialMap().fit(vectors(spark, np.ones((9, 2))))
    assert same.landmarks.tolist() == [[1, 1]] and same.gamma == 1
    for estimator in (r.RadialMap(), r.RadialSVM()):
        with pytest.raises(ValueError):
            estimator.fit(vectors(spark, x).where("false"))


def test_rings_are_told_apart_and_models_are_saved(spark, scratch):
    rows = rings(spark).cache()
    train, test = rows.where("i % 3 > 0"), rows.where("i % 3 = 0")
    linear = tr.estimator("svm", {"maxIter": 20}).fit(train)
    assert 0.35 < area(scores(linear, test)) < 0.65
    model = tr.estimator("radial_svm", {"landmarks": 60}).fit(train)
    found = scores(model, test)
    assert area(found) > 0.95
    assert np.mean([(row["p"] > 0.5) == row["label"] for row in found]) > 0.9
    model.write().overwrite().save(f"{scratch}/radial")
    again = scores(PipelineModel.load(f"{scratch}/radial"), test)
    assert np.allclose([x["p"] for x in again], [x["p"] for x in found])


def test_a_linear_machine_is_refitted_as_a_balanced_radial_one(spark):
    assert final_config(tr.Config("forest", params={"numTrees": 3})).family == "forest"
    config = final_config(tr.Config("svm", strategy="downsample_balanced", params={"regParam": 0.1}))
    assert (config.family, config.params, config.uses_weights) == ("radial_svm", {}, True)
    rows = rings(spark, 200).select("i", *[vector_to_array("features")[k].alias(n) for k, n in enumerate("uv")], "label")
    model = tr.refit(rows, ["u", "v"], config, "i")
    parts = explained(rows.limit(5).drop("label"), model, ["u", "v"], "i").collect()
    p = {x["i"]: x["p"] for x in scores(model, rows)}
    base = [p[x["i"]] - x["phi_u"] - x["phi_v"] for x in parts]
    assert len(parts) == 5 and max(base) - min(base) < 1e-6


@pytest.mark.parametrize("family, params", [
    ("gain_boosted", {"maxIter": 2, "maxDepth": 3}),
    ("two_towers", {"epochs": 1, "batchSize": 100, "towers": ((3,), (3,)), "combined": 4, "last": 3}),
])
def test_own_families_are_saved(spark, scratch, family, params):
    names = ["u", "pca_emb_0"]
    rows = rings(spark, 200).select("i", *[vector_to_array("features")[k].alias(n) for k, n in enumerate(names)], "label")
    model = tr.refit(rows, names, tr.Config(family, params=params), "i")
    model.write().overwrite().save(f"{scratch}/{family}")
    loaded = PipelineModel.load(f"{scratch}/{family}")
    assert np.allclose([x["p"] for x in scores(model, rows)], [x["p"] for x in scores(loaded, rows)])
    if family == "gain_boosted":
        assert loaded.stages[-1].importances == model.stages[-1].importances
        assert loaded.stages[-1].trees == model.stages[-1].trees
