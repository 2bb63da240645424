"""Ranks, buckets and metrics against brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cohortloom.operators import cohort
from cohortloom.operators import metrics as m
from cohortloom.operators import profile as p
from cohortloom.operators import ranking as r


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(3)
    n = 3000
    score = np.round(rng.random(n), 3)
    score[::3] = 0.5
    return pd.DataFrame(
        {"id": [f"k{i:05d}" for i in rng.permutation(n)], "score": score, "y": rng.integers(0, 2, n)}
    )


def test_rank_is_the_sorted_position(spark, scores):
    ranked = r.rank_desc(spark.createDataFrame(scores).repartition(6), "score", "id").collect()
    found = {row["id"]: row["rank"] for row in ranked}
    order = sorted(zip(scores["score"], scores["id"]), key=lambda x: (-x[0], x[1]))
    assert found == {key: i + 1 for i, (_, key) in enumerate(order)}


def test_a_hot_score_is_spread_over_tasks(spark, scores):
    hot = spark.createDataFrame(scores).filter("score = 0.5").repartition(4)
    order = [F.col("score").desc(), F.col("id").asc()]
    sizes = hot.repartitionByRange(4, *order).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 4 and max(row["count"] for row in sizes) < 0.5 * hot.count()


def test_buckets(spark, scores):
    df = spark.createDataFrame(scores)
    cuts = r.bucket_thresholds(df, "score")
    high, low = np.percentile(scores["score"], [70, 30])
    assert cuts == pytest.approx((high, low))
    info = r.bucket_info(r.risk_buckets(df, "score", cuts), cuts).first()
    assert info["low_count"] == int((scores["score"] >= high).sum())
    assert info["high_count"] == int(((scores["score"] <= low) & (scores["score"] < high)).sum())
    assert info["low_count"] + info["medium_count"] + info["high_count"] == len(scores)


def test_low_wins_when_thresholds_meet(spark):
    df = spark.createDataFrame([("a", 1.0), ("b", 1.0)], "id string, score double")
    assert {x["risk_bucket"] for x in r.risk_buckets(df, "score").collect()} == {"LOW"}


def test_auc_counts_ties_half(spark, scores):
    found = m.roc_auc(spark.createDataFrame(scores), "y", "score").first()[0]
    pos = scores.loc[scores["y"] == 1, "score"].to_numpy()
    neg = scores.loc[scores["y"] == 0, "score"].to_numpy()
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert found == pytest.approx(wins / (len(pos) * len(neg)), abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "y int, score double")
    assert m.roc_auc(df, "y", "score").first()[0] is None


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.0)], "y int, p double")
    row = m.binary_metrics(df, "y", "p").first()
    assert row.asDict() == {"accuracy": 1.0, "precision": 0.0, "recall": 0.0, "f1": 0.0}


def test_best_threshold(spark, scores):
    found = m.best_threshold(spark.createDataFrame(scores), "score", "y").first()
    best, best_f1 = 0.5, 0.0
    for t in [0.1 + 0.05 * i for i in range(18)]:
        hit = scores["score"] >= t
        tp = int((hit & (scores["y"] == 1)).sum())
        f1 = 2 * tp / (hit.sum() + (scores["y"] == 1).sum())
        if f1 > best_f1:
            best, best_f1 = t, f1
    assert found["threshold"] == pytest.approx(best) and found["f1"] == pytest.approx(best_f1)


def test_run_summary_uses_the_sample_deviation(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 4.0)], "k string, f1 double")
    row = m.summarise_runs(df, ["k"], ["f1"]).first()
    assert row["f1_std"] == pytest.approx(np.std([1, 2, 4], ddof=1))


def test_best_row_takes_the_first_on_ties(spark):
    rows = [(0, "a", "f1", 0.5), (1, "b", "f1", 0.7), (2, "c", "f1", 0.7)]
    df = spark.createDataFrame(rows, "seq int, model string, metric_name string, mean double")
    assert m.best_config(df, "f1").first()["model"] == "b"


def test_histogram_like_numpy(spark, scores):
    found = p.histogram(spark.createDataFrame(scores), "score", 20).orderBy("bin").collect()
    expected, edges = np.histogram(scores["score"], 20)
    assert [x["n"] for x in found] == expected.tolist()
    assert np.allclose([x["from_value"] for x in found], edges[:-1])


def test_histogram_of_one_value(spark):
    df = spark.createDataFrame([(2.0,), (2.0,)], "x double")
    found = p.histogram(df, "x", 4).collect()
    assert sum(x["n"] for x in found) == 2 and len(found) == 4


def test_summary_uses_the_population_deviation(spark, scores):
    row = p.summary(spark.createDataFrame(scores), "score").first()
    assert row["std"] == pytest.approx(scores["score"].std(ddof=0))
    assert row["median"] == pytest.approx(scores["score"].median())


def test_ongoing_check_fails_on_a_label(spark):
    rows = [("RECRUITING", 1), ("RECRUITING", None), ("COMPLETED", 1)]
    df = spark.createDataFrame(rows, "overall_status string, label_feasible int")
    assert p.check_no_ongoing(df).first().asDict() == {
        "ongoing": 2, "ongoing_labelled": 1, "passed": False,
    }


def test_thresholds_from_ranks(spark, scores):
    df = spark.createDataFrame(scores)
    ranked = r.rank_desc(df, "score", "id", costly=True)
    assert r.ranked_thresholds(ranked, "score", "rank") == pytest.approx(r.bucket_thresholds(df, "score"))
    one = r.rank_desc(df.limit(1), "score", "id")
    assert len(set(r.ranked_thresholds(one, "score", "rank"))) == 1


def test_scores_that_are_no_number_are_left_out(spark):
    rows = [(0.1, 0), (0.9, 1), (0.4, 0), (float("nan"), 1), (None, 0)]
    df = spark.createDataFrame(rows, "s double, y int")
    assert m.roc_auc(df, "y", "s").first()[0] == 1.0


def test_empty_cohort(spark):
    empty = spark.createDataFrame([], "nct_id string, p_completion double")
    assert cohort.scored_table(empty, []).count() == 0
