"""Splits, folds and resampling: exact sizes, disjoint parts, stable under repartitioning."""

import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortloom.operators import sampling as s


@pytest.fixture(scope="module")
def rows(spark):
    # 700 of one class, 290 of the other, 10 without a label; string ids
    label = F.when(F.col("id") < 700, 1).when(F.col("id") < 990, 0)
    return spark.range(1000).select(
        F.concat(F.lit("N"), F.col("id")).alias("key"), label.alias("y"), (F.col("id") * 2).alias("x")
    )


def number(key, seed=42):
    return int(hashlib.md5(f"{key}:{seed}".encode()).hexdigest()[:13], 16)


def test_draw_is_the_md5_prefix(rows):
    found = rows.select("key", s.draw(F.col("key"), 42).alias("d")).limit(5).collect()
    assert all(r["d"] == number(r["key"]) for r in found)


def test_split_sizes_are_exact(rows):
    found = s.assign_split(rows, "key", "y").groupBy("y", "split").count().collect()
    counts = {(r["y"], r["split"]): r["count"] for r in found}
    assert counts[(None, None)] == 10
    assert sum(n for (y, part), n in counts.items() if part == "test") == 198
    # ceil(0.15 * 792)
    assert sum(n for (y, part), n in counts.items() if part == "validation") == 119
    assert counts[(1, "test")] == 140 and counts[(0, "test")] == 58


def test_split_takes_the_smallest_draws_and_is_stable(rows):
    first = {r["key"]: r["split"] for r in s.assign_split(rows, "key", "y").collect()}
    again = s.assign_split(rows.repartition(7), "key", "y").collect()
    assert first == {r["key"]: r["split"] for r in again}
    ones = sorted((f"N{i}" for i in range(700)), key=lambda k: (number(k), k))
    assert all(first[k] == "test" for k in ones[:140]) and first[ones[140]] != "test"


def test_plain_split(rows):
    found = s.assign_split(rows, "key", "y", stratify=False).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in found} == {
        "test": 198, "validation": 119, "train": 673, None: 10,
    }


def test_equal_draws_fall_back_to_ids(rows, monkeypatch):
    monkeypatch.setattr(s, "draw", lambda col, seed: F.length(col).cast("bigint"))
    parts = s.assign_parts(rows, "key", {1: [155, 545], 0: [3, 287]}, 1, "y")
    found = parts.filter("part = 0").collect()
    by_class = {y: {r["key"] for r in found if r["y"] == y} for y in (0, 1)}
    order = sorted((f"N{i}" for i in range(700)), key=lambda k: (len(k), k))
    assert by_class[1] == set(order[:155])
    order = sorted((f"N{i}" for i in range(700, 990)), key=lambda k: (len(k), k))
    assert by_class[0] == set(order[:3])


def test_folds_are_even_within_classes(rows):
    found = s.assign_folds(rows, "key", "y", 5).filter("y is not null").groupBy("y", "fold").count()
    counts = {(r["y"], r["fold"]): r["count"] for r in found.collect()}
    assert {counts[(1, f)] for f in range(5)} == {140} and {counts[(0, f)] for f in range(5)} == {58}


@pytest.mark.parametrize(
    "strategy, majority",
    [("class_weight", 700), ("downsample_balanced", 290), ("downsample_1_5", 435), ("partial_downsample", 580)],
)
def test_downsampling_counts(rows, strategy, majority):
    kept = s.rebalance(rows.filter("y is not null"), "y", "key", strategy)
    counts = {r["y"]: r["count"] for r in kept.groupBy("y").count().collect()}
    assert counts == {1: majority, 0: 290}
    assert kept.select("key").distinct().count() == majority + 290


def test_downsampling_is_capped(rows):
    labelled = rows.filter("y is not null")
    assert s.downsample(labelled, "y", "key", 5.0).count() == 990


def test_unknown_strategy(rows):
    with pytest.raises(ValueError):
        s.rebalance(rows, "y", "key", "none")


@pytest.mark.parametrize("ratio, minority", [(1.0, 700), (0.6, 420), (0.1, 290)])
def test_oversampling_counts(rows, ratio, minority):
    grown = s.oversample(rows.filter("y is not null"), "y", "key", ratio).collect()
    assert Counter(r["y"] for r in grown) == {1: 700, 0: minority}
    zeros = Counter(r["key"] for r in grown if r["y"] == 0)
    assert len(zeros) == 290
    assert all(r["x"] == 2 * int(r["key"][1:]) for r in grown)


def test_weights(rows):
    found = s.class_weights(rows.filter("y is not null"), "y").select("y", "weight").distinct()
    weights = {r["y"]: r["weight"] for r in found.collect()}
    assert weights[1] == pytest.approx(990 / 1400) and weights[0] == pytest.approx(990 / 580)


def test_sample(rows):
    found = {r["key"] for r in s.sample_n(rows, "key", 50).collect()}
    order = sorted((f"N{i}" for i in range(1000)), key=lambda k: (number(k), k))
    assert found == set(order[:50])


def test_thousands_of_classes(spark):
    rows = spark.range(9000).select("id", (F.col("id") % 3000).alias("y"))
    folds = s.assign_folds(rows, "id", "y", 3).groupBy("y").agg(F.array_sort(F.collect_list("fold")).alias("f"))
    assert {tuple(r["f"]) for r in folds.collect()} == {(0, 1, 2)}
    weights = s.class_weights(rows, "y").select("weight").distinct().collect()
    assert [r["weight"] for r in weights] == [1.0]
    parts = s.assign_split(rows, "id", "y").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in parts} == {"test": 1800, "validation": 1080, "train": 6120}


def test_more_classes_than_are_broadcast(spark, monkeypatch, rows):
    whole = {r["key"]: r["split"] for r in s.assign_split(rows, "key", "y").collect()}
    monkeypatch.setattr(s, "BROADCAST_CLASSES", 0)
    assert whole == {r["key"]: r["split"] for r in s.assign_split(rows, "key", "y").collect()}
