"""All plans end to end on generated registry lines."""

import json
import random

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from test_records import study

from cohortloom import fixed_values as fv
from cohortloom.operators import cohort as h
from cohortloom.operators import training as tr
from cohortloom.plans import audit, dataset, experiments, scoring
from cohortloom.sources.models import load_model
from cohortloom.sources.tables import read_stage, write_results

STATUSES = ["COMPLETED", "COMPLETED", "TERMINATED", "WITHDRAWN", "RECRUITING", "ACTIVE_NOT_RECRUITING"]
WORDS = "dose arm drug placebo survival response tumor progression inclusion exclusion -".split()


def lines(n=240):
    rng = random.Random(4)
    for i in range(n):
        status = rng.choice(STATUSES)
        arms = rng.randint(1, 3) + (2 if status == "COMPLETED" else 0)
        text = " ".join(rng.choice(WORDS) for _ in range(40))
        record = study(
            identificationModule__nctId=f"N{i:04d}",
            statusModule__overallStatus=status,
            conditionsModule__conditions=[rng.choice(["NSCLC", "Lymphoma", "Breast cancer"])],
            armsInterventionsModule__armGroups=[{"label": str(k)} for k in range(arms)],
            armsInterventionsModule__interventions=[{"name": rng.choice(["Cisplatin", "Surgery"])}],
            designModule__enrollmentInfo={"count": rng.randint(10, 500), "type": "ESTIMATED"},
            eligibilityModule__eligibilityCriteria=text,
            contactsLocationsModule__locations=[
                {"country": rng.choice(["Spain", "China", "United States"])}
                for _ in range(rng.randint(0, 3))
            ],
        )
        yield json.dumps({"nct_id": f"N{i:04d}", "record": record})
    yield "broken line"


@pytest.fixture(scope="module")
def built(spark, scratch):
    path = f"{scratch}/full.jsonl"
    with open(path, "w", encoding="utf-8") as out:
        out.write("\n".join(lines()) + "\n")
    return dataset.build_dataset(spark, path, f"{scratch}/search.jsonl", f"{scratch}/stages", size=16)


def test_stages(spark, built):
    parsed, final = read_stage(spark, built["parsed"]), read_stage(spark, built["final"])
    assert parsed.count() == 240 and len(parsed.drop("rejected_line", "reject_reason").columns) == 108
    rejects = read_stage(spark, built["rejects"]).select("reject_reason", "rejected_line").collect()
    assert [tuple(r) for r in rejects] == [("undecodable", "broken line")]
    finals = parsed.filter(F.col("overall_status").isin(*STATUSES[:4])).count()
    assert final.count() == finals
    assert not final.filter(F.col(fv.LABEL_COLUMN).isNull()).count()
    assert "embedding" not in final.columns and "pca_emb_0" in final.columns
    assert {"is_other", "is_surgery", "num_exclusion_items"} <= set(final.columns)


def test_the_reduction_can_be_fitted_on_a_part(spark, built):
    embedded = read_stage(spark, built["embedded"])
    part = embedded.filter("label_feasible is not null")
    reduced, reduction = dataset.reduction_stage(embedded, fit_on=part)
    assert reduced.filter("pca is null").count() == 0 and reduction.kept <= 16


@pytest.fixture(scope="module")
def trained(spark, built, scratch):
    final = read_stage(spark, built["final"])
    configs = [
        tr.Config("forest", mode, "class_weight", {"numTrees": 5, "maxDepth": 3})
        for mode in fv.INPUT_MODES
    ] + [tr.Config("boosted", "tabular", "downsample_balanced", {"maxIter": 3, "maxDepth": 2})]
    results = experiments.run_experiments(
        final, configs, f"{scratch}/best", runs=2, grids={}, selection_params={"maxIter": 3, "maxDepth": 3}
    )
    return results, f"{scratch}/best"


def test_results(trained):
    rows = trained[0].collect()
    assert len(rows) == 3 * len(fv.METRICS)
    assert {r["metric_name"] for r in rows} == set(fv.METRICS)
    assert all(0 <= r["mean"] <= 1 and r["std"] >= 0 for r in rows)


def test_best_model_is_saved_with_its_features(spark, trained):
    model, metadata = load_model(spark, trained[1])
    best = max((r for r in trained[0].collect() if r["metric_name"] == "roc_auc"), key=lambda r: r["mean"])
    assert metadata["model_name"] == best["model_name"] and metadata["roc_auc"] == best["mean"]
    assert model.stages[0].getInputCols() == metadata["feature_names"]


def test_cohort_scoring(spark, built, trained, scratch):
    model, metadata = load_model(spark, trained[1])
    reduced = read_stage(spark, built["reduced"])
    kept = [c for c in read_stage(spark, built["final"]).columns if c.startswith("pca_emb_")]
    source = dataset.columns.expand_vector(reduced, "pca", len(kept), fv.PCA_PREFIX)
    scored = scoring.score_cohort([source], read_stage(spark, built["final"]), model, metadata)
    rows = scored.collect()
    wanted = source.filter("is_nsclc = 1").filter(h.is_ongoing()).count()
    assert len(rows) == wanted > 0
    ordered = sorted(rows, key=lambda r: r["rank_nsclc"])
    assert [r["rank_nsclc"] for r in ordered] == list(range(1, wanted + 1))
    assert all(x["p_completion"] >= y["p_completion"] for x, y in zip(ordered, ordered[1:]))
    write_results(scored, f"{scratch}/scored", "csv")
    assert spark.read.option("header", True).csv(f"{scratch}/scored").count() == wanted
    with pytest.raises(ValueError):
        write_results(scored, f"{scratch}/scored", "xlsx")


def test_audit(spark, built, trained):
    data, cols = experiments.model_view(read_stage(spark, built["final"]), "tabular")
    config = tr.Config("boosted", params={"maxIter": 3, "maxDepth": 2})
    model = tr.refit(data, cols, config, "nct_id", "label_feasible")
    tables = audit.audit_model(data, model, cols)
    assert tables["raw"].count() <= 20 and tables["leakage"].filter("found").count() == 0
    assert {r["direction"] for r in tables["direction"].collect()} <= {"increases", "decreases"}


def test_nothing_to_score(spark, trained):
    model, metadata = load_model(spark, trained[1])
    names = metadata["feature_names"]
    empty = spark.createDataFrame([], ", ".join(["nct_id string"] + [f"`{n}` double" for n in names]))
    with pytest.raises(ValueError):
        h.score(empty, model)


def test_source_choice(spark):
    done = spark.createDataFrame([("COMPLETED",)], "overall_status string")
    live = spark.createDataFrame([("RECRUITING",)], "overall_status string")
    other = spark.range(1)
    assert h.pick_source([other, done, live], h.is_ongoing(), done).first()[0] == "RECRUITING"
    assert h.pick_source([other], h.is_ongoing(), done).first()[0] == "COMPLETED"


def test_cohort_without_columns(spark):
    df = spark.range(3)
    assert h.filter_cohort(df).count() == 3
    text = spark.createDataFrame([("A NSCLC x",), ("other",), (None,)], "condition_text string")
    assert h.filter_cohort(text).count() == 1


def test_config_list():
    configs = experiments.all_configs()
    assert len(configs) == 20
    assert [c.uses_weights for c in configs if c.strategy == "class_weight"] == [True] * 3 + [False] * 2


def test_selection_keeps_at_least_the_minimum(spark):
    rows = spark.range(200).select(
        F.col("id"), (F.col("id") % 2).alias("y"),
        *[(F.hash("id", F.lit(k)) % 97).cast("double").alias(f"f{k}") for k in range(12)],
        (F.col("id") % 2).cast("double").alias("signal"),
    )
    cols = [f"f{k}" for k in range(12)] + ["signal"]
    kept, table = tr.select_features(rows, cols, "y", params={"maxIter": 2, "maxDepth": 2})
    assert len(kept) == 10 and "signal" in kept and table.count() == 13


def test_unknown_family():
    with pytest.raises(ValueError):
        tr.estimator("other")


def test_empty_sides_of_a_parse_can_be_read(spark, scratch):
    path = f"{scratch}/only_bad"
    spark.createDataFrame([("{",), ("",)], "value string").coalesce(1).write.text(path)
    parsed, rejects, counts = dataset.parse_stage(spark, path, f"{path}-none", f"{scratch}/only_bad_out")
    lost = read_stage(spark, rejects).count()
    assert read_stage(spark, parsed).count() == 0 and lost > 0
    assert (counts["kept"], counts["rejected"], counts["missing_nct_id"]) == (0, lost, 0)


def test_equal_ids_stay_apart_in_a_scored_cohort(spark):
    class Half:
        def transform(self, df):
            half = F.array(1 - F.col("x") / 10, F.col("x") / 10)
            return df.withColumn("probability", array_to_vector(half))

    rows = [("a", 1.0, "RECRUITING"), ("a", 2.0, "RECRUITING"), ("b", 3.0, "RECRUITING"), ("c", 4.0, "COMPLETED")]
    df = spark.createDataFrame(rows, "nct_id string, x double, overall_status string")
    found = scoring.score_cohort([df], df, Half(), {"feature_names": ["x", "absent"]}).collect()
    assert sorted((r["nct_id"], r["p_completion"]) for r in found) == [("a", 0.1), ("a", 0.2), ("b", 0.3)]


def test_audits_and_importances_cover_all_rows(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 2).alias("y"), (F.col("id") % 2).alias("x"), (F.col("id") % 7).alias("z"))
    for family, params in (("svm", {"maxIter": 5}), ("boosted", {"maxIter": 2, "maxDepth": 2})):
        model = tr.refit(rows, ["x", "z"], tr.Config(family, params=params, weighted=False), "id", "y")
        found = audit.audit_model(rows, model, ["x", "z"], "id")
        assert found["dependence"].filter("feature = 'x'").count() == 3000
        best = scoring.cohort_importance(rows, model, ["x", "z"], 1, "id").first()
        assert best["feature"] == "x"
        assert found["raw"].orderBy("rank").first()["feature"] == "x"


def test_search_averages_all_folds(spark):
    rows = spark.range(60).select("id", (F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 2).alias("x"))
    frame = tr.assemble(rows, ["x"])
    chosen, area = tr.search(frame, "boosted", {"maxDepth": [1, 2], "maxIter": [2]}, "id", "y", folds=3)
    assert area == 1.0 and chosen == {"maxDepth": 1, "maxIter": 2}


def test_network_scales_its_inputs(spark):
    rows = spark.range(400).select(
        "id", (F.col("id") % 2).cast("double").alias("y"), (F.col("id") % 2).alias("x"),
        (F.col("id") * 7919 % 1000003).alias("big"), (F.col("id") * 31 % 1009).alias("pca_emb_0"),
    )
    config = tr.Config("network", params={"hidden": [4], "maxIter": 60}, weighted=False)
    model = tr.refit(rows, ["x", "big", "pca_emb_0"], config, "id", "y")
    assert model.transform(rows).filter("prediction <> y").count() == 0
