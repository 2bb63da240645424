"""Exact order statistics: small and large paths, ties, hot values."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from cohortloom.operators.quantiles import modes, order_statistics, quantiles


def frame(spark, values, name="x"):
    return spark.createDataFrame(pd.DataFrame({name: np.asarray(values, dtype=float)}))


def data(kind, n=4000):
    rng = np.random.default_rng(7)
    return {
        "uniform": rng.random(n),
        "hot_third": np.where(np.arange(n) % 3 == 0, 5.0, rng.normal(5, 2, n)),
        "two_values": np.where(np.arange(n) % 2 == 0, 1.0, 9.0),
        "constant": np.full(n, 3.0),
        "tails": np.concatenate([rng.normal(0, 1e-6, n - 2), [-1e9, 1e9]]),
        "integers": rng.integers(0, 40, n).astype(float),
    }[kind]


@pytest.mark.parametrize("listed", [10, 200_000])
@pytest.mark.parametrize(
    "kind", ["uniform", "hot_third", "two_values", "constant", "tails", "integers"]
)
def test_same_as_linear_interpolation(spark, kind, listed):
    values = data(kind)
    fractions = [0.0, 0.3, 0.5, 0.7, 1.0]
    found = quantiles(frame(spark, values), ["x"], fractions, listed=listed)["x"]
    expected = np.percentile(values, [f * 100 for f in fractions])
    assert np.allclose([found[f] for f in fractions], expected, rtol=1e-12, atol=1e-12)


def test_counts_around_a_value(spark):
    values = data("hot_third")
    long = frame(spark, values, "value").selectExpr("0 AS key", "value")
    rank = int((values < 5).sum()) + 10
    found = order_statistics(long, {0: [rank]}, {0: len(values)}, listed=10)[(0, rank)]
    assert (found.value, found.below) == (5.0, int((values < 5).sum()))
    assert found.equal == int((values == 5).sum())


def test_nulls_nan_and_empty_columns(spark):
    rows = [(1.0, None), (None, None), (float("nan"), None), (4.0, None)]
    df = spark.createDataFrame(rows, "a double, b double")
    found = quantiles(df, ["a", "b"], [0.5])
    assert found == {"a": {0.5: 2.5}, "b": {0.5: None}}


def test_rank_out_of_range(spark):
    long = frame(spark, [1.0], "value").selectExpr("0 AS key", "value")
    with pytest.raises(ValueError):
        order_statistics(long, {0: [1]}, {0: 1})


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=60), st.floats(0, 1))
def test_any_list(spark, values, fraction):
    found = quantiles(frame(spark, values), ["x"], [fraction], listed=3)["x"][fraction]
    assert found == pytest.approx(np.percentile(values, fraction * 100), abs=1e-9)


def test_modes(spark):
    rows = [("b", 1, None), ("b", 2, None), ("a", 2, None), ("a", 1, None), (None, 3, None)]
    df = spark.createDataFrame(rows, "s string, i int, n string")
    assert modes(df, ["s", "i", "n"]) == {"s": "a", "i": "1"}


@pytest.mark.parametrize("kind", ["even", "skewed", "few"])
def test_even_spread_is_only_a_guess(spark, kind):
    rng = np.random.default_rng(2)
    values = {
        "even": rng.integers(0, 1 << 52, 5000),
        "skewed": (rng.random(5000) ** 9 * (1 << 52)).astype("int64"),
        "few": rng.integers(0, 4, 5000),
    }[kind].astype(float)
    long = frame(spark, values, "value").selectExpr("0 AS key", "value")
    ranks = [0, 999, 2500, 4999]
    found = order_statistics(long, {0: ranks}, {0: 5000}, listed=50, bounds={0: (0, 1 << 52)}, even=True)
    ordered = np.sort(values)
    for rank in ranks:
        stat = found[(0, rank)]
        assert stat.value == ordered[rank]
        assert stat.below == (values < stat.value).sum() and stat.equal == (values == stat.value).sum()


@pytest.mark.parametrize(
    "values", [[-np.inf, 1, 2, 3, np.inf], [-np.inf, -np.inf, 1, 2, 3], [np.inf] * 3, [-np.inf] * 100 + [5.0] * 101]
)
@pytest.mark.parametrize("listed", [1, 64])
def test_infinities_count(spark, values, listed):
    found = quantiles(frame(spark, values), ["x"], [0.5], listed=listed)["x"][0.5]
    assert found == sorted(values)[len(values) // 2]


def test_many_keys_at_once(spark):
    rng = np.random.default_rng(8)
    keys, numbers = rng.integers(0, 300, 9000), rng.normal(size=9000)
    long = spark.createDataFrame(pd.DataFrame({"key": keys, "value": numbers}))
    counts = {k: int((keys == k).sum()) for k in set(keys.tolist())}
    found = order_statistics(long, {k: [n // 2] for k, n in counts.items()}, counts, listed=4)
    for k, n in counts.items():
        assert found[(k, n // 2)].value == np.sort(numbers[keys == k])[n // 2]


def test_passes_over_values_of_any_spread(spark, monkeypatch):
    """Values of all magnitudes, of one magnitude and constant: four histograms at most."""
    from cohortloom.operators import quantiles as module

    passes = []
    narrowed = module._narrowed
    monkeypatch.setattr(module, "_narrowed", lambda *args: passes.append(1) or narrowed(*args))
    rng = np.random.default_rng(3)
    kinds = {
        "all": np.ldexp(rng.choice([-1.0, 1.0], 6000) * rng.uniform(1, 2, 6000), rng.integers(-1070, 1023, 6000)),
        "close": 1000 + rng.random(6000) * 1e-9,
        "constant": np.full(6000, 2.5),
        "ends": np.r_[np.full(3001, -np.inf), np.full(2000, np.inf), rng.normal(size=1000)],
        "zeros": np.r_[np.zeros(3000), -np.zeros(1000), rng.normal(size=2000) * 5e-324],
    }
    for name, values in kinds.items():
        passes.clear()
        found = quantiles(frame(spark, values), ["x"], [0.25, 0.5], listed=1)["x"]
        ordered = np.sort(values)
        for q, value in found.items():
            at = (len(values) - 1) * q
            low, high = ordered[int(np.floor(at))], ordered[int(np.ceil(at))]
            assert value == (low if low == high else low + (high - low) * (at - np.floor(at))), name
        assert len(passes) <= (0 if name == "constant" else 4), name


def test_many_searches_are_stored_and_joined(spark, monkeypatch):
    from cohortloom.operators import quantiles as module

    monkeypatch.setattr(module, "BROADCAST_SEARCHES", 3)
    rng = np.random.default_rng(4)
    values = rng.normal(size=3000)
    found = order_statistics(frame(spark, values, "value").selectExpr("0 AS key", "value"), {0: range(0, 3000, 250)}, {0: 3000}, listed=5)
    ordered = np.sort(values)
    assert all(found[(0, r)].value == ordered[r] for r in range(0, 3000, 250))
