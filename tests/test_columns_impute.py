"""Column rules, imputation, coercion and scaling on small frames."""

import numpy as np
import pytest

from cohortloom import fixed_values as fv
from cohortloom.operators import columns as c
from cohortloom.operators import impute as i


@pytest.fixture(scope="module")
def wide(spark):
    names = [
        "nct_id", "label_feasible", "brief_title", "arm_groups", "sex", "why_stopped",
        "first_submit_date_raw", "number_of_arms", "is_nsclc", "pca_emb_0", "pca_emb_1", "phase",
    ]
    row = ("N", 1, "t", "[]", "ALL", None, "2020", 2, 1, 0.5, 0.1, "PHASE2")
    return spark.createDataFrame([row], ", ".join(
        f"{n} {'double' if n.startswith('pca') else 'int' if isinstance(v, int) else 'string'}"
        for n, v in zip(names, row)
    ))


def test_tabular_columns(wide):
    assert c.tabular_columns(wide) == ["number_of_arms", "is_nsclc", "phase"]
    kept = c.tabular_columns(wide, leakage=None)
    assert "why_stopped" in kept and "first_submit_date_raw" in kept


def test_group_sizes():
    sizes = [len(x) for x in (fv.TEXT_COLUMNS, fv.NESTED_COLUMNS, fv.LEAKAGE_COLUMNS, fv.EXCLUDED_COLUMNS)]
    assert sizes == [8, 26, 20, 28]
    assert len(fv.DISEASE_KEYWORDS) == 25 and len(fv.INTERVENTION_KEYWORDS) == 9


def test_modes(wide):
    assert c.feature_view(wide, "tabular").columns[2:] == ["number_of_arms", "is_nsclc", "phase"]
    with_vectors = c.feature_view(wide, "tabular_plus_embeddings").columns
    assert with_vectors[-2:] == ["pca_emb_0", "pca_emb_1"]
    with pytest.raises(ValueError):
        c.feature_view(wide, "text")
    with pytest.raises(ValueError):
        c.feature_view(wide.drop("label_feasible"), "tabular")


def test_constants_ignore_nulls(spark):
    df = spark.createDataFrame([(1, None, 1), (1, None, None), (1, None, 2)], "a int, b int, c int")
    assert c.constant_columns(df) == ["a", "b"]


def test_alignment_adds_zeros_in_order(spark):
    df = spark.createDataFrame([("k", 5, 6)], "id string, a int, b int")
    row = c.align_features(df, ["b", "missing", "a"], keep=["id"]).first()
    assert row.asDict() == {"id": "k", "b": 6, "missing": 0, "a": 5}


def test_feature_mask_and_common_columns(spark, wide):
    masked = c.apply_feature_mask(wide, [True, False], ["phase", "is_nsclc"])
    assert masked.columns == ["phase"]
    assert c.common_columns(wide, masked) == ["phase"]
    assert c.apply_feature_mask(masked, [True, True], ["phase", "gone"]).columns == ["phase"]


def test_types_and_prefixes(spark, wide):
    df = spark.createDataFrame([(1, 1.0, True, "x")], "i int, d double, b boolean, s string")
    assert c.numeric_columns(df) == ["i", "d", "b"]
    assert c.numeric_columns(df, with_booleans=False) == ["i", "d"]
    assert c.categorical_columns(df) == ["b", "s"]
    assert c.columns_with_prefix(wide, "pca_emb_") == ["pca_emb_0", "pca_emb_1"]
    assert "pca_emb_0" not in c.drop_prefix(wide, "pca_emb_").columns


def test_output_columns_use_stand_ins():
    available = ["nct_id", "lead_sponsor_name", "overall_status", "phase", "pca_emb_0", "masking"]
    found = c.output_columns(available, ["pca_emb_0", "phase"])
    assert found == ["nct_id", "phase", "overall_status", "lead_sponsor_name", "masking"]


def test_group_counts(wide):
    assert c.group_counts(wide) == {
        "pca": 2, "disease": 1, "intervention": 0, "complexity": 0, "other": 7,
    }


def test_check_columns(wide):
    found = {r["column"]: r["present"] for r in c.check_columns(wide, ["nct_id", "rank"]).collect()}
    assert found == {"nct_id": True, "rank": False}


def test_impute_is_fitted_once_and_applied_elsewhere(spark):
    schema = "x double, n int, s string, b boolean"
    train = spark.createDataFrame(
        [(1.0, 1, "b", True), (2.0, 4, "a", None), (float("nan"), None, "a", True), (9.0, 4, "b", False)],
        schema,
    )
    fitted = i.fit_impute(train)
    assert fitted == {"x": 2.0, "n": 4.0, "s": "a", "b": "true"}
    other = spark.createDataFrame([(None, None, None, None), (float("nan"), 3, "z", False)], schema)
    assert [tuple(r) for r in i.apply_impute(other, fitted).collect()] == [
        (2.0, 4.0, "a", True), (2.0, 3.0, "z", False),
    ]


@pytest.mark.parametrize(
    "text, number",
    [
        ("5", 5.0), (" -1.5 ", -1.5), ("1e3", 1000.0), (".5", 0.5), ("5.", 5.0), ("1d", 0.0),
        ("PHASE2", 0.0), ("", 0.0), (None, 0.0), ("1,000", 0.0), ("0x10", 0.0),
    ],
)
def test_numbers_in_text(spark, text, number):
    df = spark.createDataFrame([(text,)], "s string")
    assert df.select(i.number_or_zero(df["s"])).first()[0] == number


def test_coercion(spark):
    df = spark.createDataFrame(
        [("k", "b", True, float("nan"), None), ("l", "a", None, 2.0, 3)],
        "id string, s string, b boolean, d double, n int",
    )
    zero = i.coerce_numeric(df, ["s", "b", "d", "n"])
    assert [tuple(r) for r in zero.collect()] == [("k", 0.0, 1.0, 0.0, 0.0), ("l", 0.0, 0.0, 2.0, 3.0)]
    index = i.coerce_numeric(df, ["s"], categoricals="index")
    assert {r["id"]: r["s"] for r in index.collect()} == {"k": 1.0, "l": 0.0}
    other = spark.createDataFrame([("m", "b"), ("n", None), ("o", "zz")], "id string, s string")
    coded = i.coerce_numeric(other, ["s"], categoricals="index", codes=i.fit_codes(df, ["s"]))
    assert {r["id"]: r["s"] for r in coded.collect()} == {"m": 1.0, "n": 2.0, "o": 2.0}


@pytest.mark.parametrize("how", ["standard", "minmax"])
def test_scaling(spark, how):
    values = [1.0, 2.0, 4.0]
    df = spark.createDataFrame([(v, 7.0) for v in values], "x double, same double")
    scaled = i.apply_scale(df, i.fit_scale(df, ["x", "same"], how)).collect()
    x = np.array(values)
    expected = (x - x.mean()) / x.std() if how == "standard" else (x - 1) / 3
    assert np.allclose([r["x"] for r in scaled], expected)
    assert [r["same"] for r in scaled] == [0.0] * 3


def test_missing_profile(spark):
    df = spark.createDataFrame([(float("nan"), None), (1.0, "x")], "d double, s string")
    found = {r["column"]: (r["missing"], r["share"]) for r in i.missing_profile(df).collect()}
    assert found == {"d": (1, 0.5), "s": (1, 0.5)}
