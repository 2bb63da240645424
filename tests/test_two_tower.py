"""The two-input network: gradients, learning and early stop."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from cohortloom.operators import training as tr
from cohortloom.operators import two_tower as t


@pytest.mark.parametrize("left, right, dropout", [(3, 4, 0.0), (3, 4, 0.4), (5, 0, 0.2), (0, 5, 0.2)])
def test_gradients_agree_with_differences(left, right, dropout):
    rng = np.random.default_rng(1)
    network = t.Network(left, right, ((4, 3), (5, 2)), 6, 4, dropout)
    weights, _ = network.start(2)
    x, y = rng.normal(size=(12, left + right)), rng.integers(0, 2, 12).astype(float)
    masks = network.masks(12, rng)
    _, slopes, stats = network.slopes(weights, x, y, masks)
    assert sorted(slopes) == sorted(weights) and sorted(stats) == sorted(network.start(2)[1])
    for name, values in weights.items():
        for _ in range(3):
            at = tuple(rng.integers(0, s) for s in values.shape)
            before, h = values[at], 1e-6
            values[at] = before + h
            high = network.slopes(weights, x, y, masks)[0]
            values[at] = before - h
            low = network.slopes(weights, x, y, masks)[0]
            values[at] = before
            assert slopes[name][at] == pytest.approx((high - low) / (2 * h), abs=2e-4)


def product_rows(spark, n=3000, seed=3):
    """A label that only the product of one feature of either branch tells."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 5))
    rows = [(i, list(map(float, r)), float(r[0] * r[3] > 0)) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "i bigint, a array<double>, label double")
    return df.select("i", array_to_vector("a").alias("features"), "label").repartition(4).cache()


def area(scores, labels):
    scores, labels = np.array(scores), np.array(labels)
    return (np.sign(scores[labels == 1][:, None] - scores[labels == 0][None]) + 1).mean() / 2


def test_products_across_branches_are_learnt(spark):
    rows = product_rows(spark)
    train, test = rows.where("i % 5 > 0"), rows.where("i % 5 = 0")
    estimator = t.TwoTowers(left=2, towers=((16,), (16,)), combined=32, last=8, dropout=0.1, stepSize=0.02, batchSize=600, epochs=12)
    model = estimator.fit(train)
    scored = model.transform(test).select("label", vector_to_array("probability")[1].alias("p"), "prediction").collect()
    assert area([r["p"] for r in scored], [r["label"] for r in scored]) > 0.9
    assert all(r["prediction"] == (r["p"] >= 0.5) for r in scored)
    assert model.area > 0.9


def test_training_stops_early_and_repeats(spark, monkeypatch):
    rows = product_rows(spark, 400).withColumn("label", (F.col("i") % 2).cast("double"))
    asked = []
    scored = t.TwoTowerModel.scored
    monkeypatch.setattr(t.TwoTowerModel, "scored", lambda self, held: asked.append(1) or scored(self, held))
    options = {"left": 2, "towers": ((4,), (4,)), "combined": 4, "last": 4, "batchSize": 400, "epochs": 30, "patience": 2}
    one = t.TwoTowers(**options).fit(rows)
    assert len(asked) < 30
    two = t.TwoTowers(**options).fit(rows)
    assert one.area == two.area and all(np.allclose(one.weights[n], two.weights[n]) for n in one.weights)


def test_family_and_odd_tables(spark):
    rows = product_rows(spark, 300).select("i", *[vector_to_array("features")[k].alias(n) for k, n in enumerate(["u", "v", "pca_emb_0", "pca_emb_1", "pca_emb_2"])], F.col("label").cast("int").alias("y"))
    params = {"epochs": 2, "batchSize": 100, "towers": ((4,), (4,)), "combined": 4, "last": 4}
    model = tr.refit(rows, rows.columns[1:-1], tr.Config("two_towers", strategy="oversample_1.0", params=params), "i", "y")
    assert model.stages[-1].stages[-1].network.left == 2
    assert model.transform(rows).where("probability IS NULL").count() == 0
    nothing = t.TwoTowers(left=2).fit(product_rows(spark, 10).where("false"))
    assert nothing.area is None
    same = t.TwoTowers(left=2, epochs=1, towers=((2,), (2,)), combined=2, last=2).fit(product_rows(spark, 40).withColumn("label", F.lit(1.0)))
    assert same.transform(product_rows(spark, 5)).count() == 5


def test_a_step_reads_its_own_rows_and_sends_one_line(spark, monkeypatch):
    """All gradients of a step are one line in single precision, however many tasks the rows came from."""
    rows = product_rows(spark, 1500).repartition(16)
    lines = []
    kind = type(rows)
    monkeypatch.setattr(kind, "collect", lambda self, c=kind.collect: [lines.append(r) or r for r in c(self)])
    stored, kept = [], t.stored_steps
    monkeypatch.setattr(t, "stored_steps", lambda *a: stored.append(kept(*a)) or stored[0])
    model = t.TwoTowers(left=2, towers=((8,), (8,)), combined=8, last=4, batchSize=300, epochs=1).fit(rows)
    sent = [r["line"] for r in lines if "line" in r]
    counts = dict(stored[0].groupBy("step").count().collect())
    assert sum(counts.values()) == 1500 and len(sent) == len(counts) - 1 == 4
    numbers = 2 + sum(v.size for v in (*model.weights.values(), *model.running.values()))
    assert {len(x) for x in sent} == {4 * numbers}
    files = stored[0].select("step", F.input_file_name().alias("f")).distinct().groupBy("step").count()
    assert all(r["count"] == 1 for r in files.where("step >= 0").collect())


def test_copies_of_a_row_share_a_step(spark):
    copies = spark.range(0, 6000, 1, 6).select(F.array(F.lit(1.0)).alias("x"), (F.col("id") % 2).cast("double").alias("y"), F.lit(0).alias("step"))
    stored = t.stored_steps(copies, 3 * t.PIECE)
    assert stored.count() == 6000
    assert {r["y"]: r["count"] for r in stored.groupBy("y").count().collect()} == {0.0: 3000, 1.0: 3000}
    assert {r["place"]: r["count"] for r in stored.groupBy("place").count().collect()} == {p: 1000 for p in range(6)}
    sizes = lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in t._by_place(batches))
    assert sum(r["n"] for r in stored.select("x", "place").mapInArrow(sizes, "n bigint").collect()) == 6000
