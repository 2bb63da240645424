"""Text expressions on awkward strings, against plain Python."""

import json
import re

import pytest
from pyspark.sql import functions as F

from cohortloom.functions import text as t
from cohortloom.operators import flags

CRITERIA = [
    None,
    "",
    "No markers - at all *",
    "Inclusion Criteria:\r\n- one\r\n- two\r\nExclusion Criteria:\r\n* three • four",
    "exclusion first - a\ninclusion then * b\ninclusion again - c",
    "INCLUSION only • x\n",
    "inclusion",
    "inclusion\r\n",
    "İnclusion ınclusion inclusıon",
    "inclusionexclusion--",
]


def expected(text):
    text = text or ""

    def section(name):
        found = re.search(rf"{name}.*?(?=(?:exclusion|inclusion|$))", text, re.S | re.I)
        return found.group(0) if found else ""

    def bullets(part):
        return len(re.findall(r"[•\-\*]", part))

    parts = [section("inclusion"), section("exclusion")]
    counts = [len(re.findall(w, text, re.I)) for w in ("inclusion", "exclusion")]
    return [len(text), *counts, *map(len, parts), *map(bullets, parts)]


def test_criteria_metrics(spark):
    rows = [(i, x) for i, x in enumerate(CRITERIA)]
    df = spark.createDataFrame(rows, "i int, eligibility_criteria_text string")
    found = flags.add_text_metrics(df).orderBy("i").drop("i", "eligibility_criteria_text")
    assert found.columns == [
        "eligibility_text_len", "num_inclusion_criteria", "num_exclusion_criteria",
        "inclusion_text_len", "exclusion_text_len", "num_inclusion_items", "num_exclusion_items",
    ]
    for text, row in zip(CRITERIA, found.collect()):
        assert list(row) == expected(text), repr(text)


def flagged(spark, conditions, **columns):
    extra = "".join(f", {name} {kind}" for name, (kind, _) in columns.items())
    values = tuple(value for _, value in columns.values())
    df = spark.createDataFrame(
        [(c, *values) for c in conditions], "condition_text string" + extra
    )
    return flags.add_disease_flags(df).collect()


def test_disease_flags_match_substrings(spark):
    small, nsclc, none, other, null = flagged(
        spark, ["Small Cell Lung Cancer", "NSCLC", "Fracture", "Malignant disease", None]
    )
    assert (small["is_sclc"], small["is_all"], small["is_nsclc"]) == (1, 1, 0)
    assert (nsclc["is_nsclc"], nsclc["is_sclc"]) == (1, 1)
    assert (none["is_other_cancer"], none["is_other"]) == (0, 1)
    assert (other["is_other_cancer"], other["is_other"]) == (1, 0)
    assert (null["is_other_cancer"], null["is_other"]) == (0, 1)


def test_earlier_flag_columns_count(spark):
    row = flagged(spark, ["Malignant disease"], is_us_export=("boolean", True))[0]
    assert (row["is_other_cancer"], row["is_other"]) == (0, 0)
    row = flagged(spark, ["Malignant disease"], is_multicountry=("int", 1))[0]
    assert (row["is_other_cancer"], row["is_other"]) == (0, 1)


def test_flags_with_a_named_scope(spark):
    df = spark.createDataFrame([("Malignant", True)], "condition_text string, is_us_export boolean")
    row = flags.add_disease_flags(df, scope=list(flags.fv.DISEASE_KEYWORDS)).first()
    assert (row["is_other_cancer"], row["is_other"]) == (1, 0)


def test_table_without_the_text_column(spark):
    row = flags.add_disease_flags(spark.range(1)).first()
    assert row["is_other"] == 1 and row["is_all"] == 0


def test_intervention_haystack_holds_json_escapes(spark):
    schema = "intervention_text string, interventions array<struct<name:string,type:string,description:string>>"
    rows = [
        ("Drug", [("Drug", "DRUG", "a\tki trial")]),
        ("Pembrolizumab", None),
        (None, None),
        # a soft hyphen before c is written as an escape that ends in "ad"
        ("Drug", [("Drug", "DRUG", "pharma\u00adceutical")]),
    ]
    found = flags.add_intervention_flags(spark.createDataFrame(rows, schema)).collect()
    assert [r["is_tki"] for r in found] == [1, 0, 0, 0]
    assert [r["is_immunotherapy"] for r in found] == [0, 1, 0, 0]
    assert [r["is_adc"] for r in found] == [0, 0, 0, 1]


def test_escapes_decide_like_ascii_json(spark):
    parts = ["\u00ad", "ê", "ü", "Ê", "\uadc5", "\u1adc", "漢", "\U0001f0ad", "a", "c", "dc", "adc", "rt", "hemo"]
    texts = [x + y + z for x in parts for y in parts for z in ("", "c", "rt", "hemotherapy")]
    words = flags.fv.INTERVENTION_KEYWORDS
    schema = "intervention_text string, interventions array<struct<name:string,type:string,description:string>>"
    df = spark.createDataFrame([("", [(x, None, None)]) for x in texts], schema)
    found = flags.add_intervention_flags(df).select("interventions", *words).collect()
    for row in found:
        haystack = json.dumps([{"name": row["interventions"][0]["name"]}]).lower()
        for name, keywords in words.items():
            assert row[name] == int(any(k in haystack for k in keywords)), (haystack, name)


@pytest.mark.parametrize("text", ["plain", "é ê\u00adc 漢", "a\U0001f600b", "", "\u007f\u0080"])
def test_ascii_escapes(spark, text):
    found = spark.createDataFrame([(text,)], "s string").select(t.ascii_escaped(F.col("s"))).first()[0]
    assert found == json.dumps(text)[1:-1]


@pytest.mark.parametrize("name", ["has_us_sites", "pd1_therapy", "a1b_X", "é_ß", "x__y_", ""])
def test_display_names(spark, name):
    found = spark.range(1).select(t.display_name(F.lit(name))).first()[0]
    assert found == name.replace("_", " ").title()


def test_joins(spark):
    df = spark.createDataFrame([("a", None, "", "b")], "p string, q string, r string, s string")
    cols = [F.col(c) for c in df.columns]
    row = df.select(t.joined_non_empty(*cols), t.joined_all(*cols)).first()
    assert tuple(row) == ("a b", "a   b")


def test_shorten(spark):
    df = spark.createDataFrame([("x" * 30,), ("x" * 31,), (None,)], "s string")
    found = [r[0] for r in df.select(t.shorten(F.col("s"), 30, "...")).collect()]
    assert found == ["x" * 30, "x" * 30 + "...", None]


def test_keywords_by_shared_parts(spark):
    # side matches, nesting, parts that alone are no hit, repeated and one-letter keywords
    words = {
        "small": ["small cell lung cancer", "sclc"], "not_small": ["non-small cell lung cancer", "nsclc"],
        "any": ["cancer", "Carcinoma"], "colon": ["colon cancer", "colon carcinoma", "colon cancer"], "one": ["é", "ab"],
    }
    groups = t.shared_parts([k for x in words.values() for k in x])
    assert sorted(k for x in groups.values() for k in x) == sorted({k.lower() for x in words.values() for k in x})
    assert all(part in k for part, members in groups.items() for k in members)
    texts = [None, "", "NSCLC", "sclc", "Non-Small Cell Lung Cancer", "colon", "colon carcinom", "COLON CARCINOMA", "lung cance", "É", "cabin"]
    texts += [f"{a} {b}" for a in ("small cell", "colon", "xcolon") for b in ("lung cancer", "cancer", "carcinoma é", "")]
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    for row in flags.add_keyword_flags(df, F.col("x"), words).collect():
        for name, keywords in words.items():
            assert row[name] == int(any(k.lower() in (row["x"] or "").lower() for k in keywords)), (row["x"], name)


def test_fewer_searches_than_keywords():
    disease = [k for x in flags.fv.DISEASE_KEYWORDS.values() for k in x]
    assert 2 * len(t.shared_parts(disease)) < len(set(disease))
    # more keywords of the same kind need no more searches in texts without them
    assert len(t.shared_parts(disease + [f"kind {i} cancer" for i in range(50)])) <= len(t.shared_parts(disease))
    assert t.shared_parts([]) == {}
