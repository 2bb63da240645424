"""Record parsing on hand-made lines: filters, polymorphic fields and projection rules."""

import copy
import json
import os

import pytest
from pyspark.sql import DataFrameWriter, Row

from cohortloom.catalog.records import record_files, record_lines
from cohortloom.operators.records import encode_nested, filter_records, parse_all, parse_records
from cohortloom.session import settings
from cohortloom.sources.records import first_existing, read_lines
from cohortloom.sources.tables import write_stage


def study(**changes):
    """A study that passes all filters; ``a__b=value`` sets nested protocol fields, None deletes."""
    protocol = {
        "identificationModule": {"nctId": "N1", "briefTitle": "Brief", "officialTitle": ""},
        "statusModule": {"overallStatus": "COMPLETED", "startDateStruct": {"date": "2020-01"}},
        "designModule": {"studyType": "INTERVENTIONAL", "phases": ["PHASE2"]},
        "sponsorCollaboratorsModule": {"leadSponsor": {"name": "S", "class": "INDUSTRY"}},
        "conditionsModule": {"conditions": ["NSCLC", "Other"]},
    }
    for path, value in changes.items():
        at = protocol
        *parents, last = path.split("__")
        for parent in parents:
            at = at.setdefault(parent, {})
        if value is None:
            at.pop(last, None)
        else:
            at[last] = value
    return {"protocolSection": protocol}


def parse(spark, *records, wrapped=True):
    lines = [r if isinstance(r, str) else json.dumps(r) for r in records]
    frame = spark.createDataFrame([Row(value=x) for x in lines])
    kept, rejects = parse_records(frame, wrapped=wrapped)
    return kept.collect(), {r["value"]: r["reject_reason"] for r in rejects.collect()}


def one(spark, record, **options):
    kept, _ = parse(spark, record, **options)
    assert len(kept) == 1
    return kept[0]


def reason(spark, record):
    kept, rejects = parse(spark, record)
    assert not kept
    return next(iter(rejects.values()))


def test_wrapper_forms(spark):
    wrapped = {"nct_id": "W1", "record": study()}
    empty = {"nct_id": "W2", "record": {}, **study()}
    no_id = {"nct_id": "", "record": study()}
    kept, rejects = parse(spark, wrapped, study(), empty, no_id)
    assert sorted(r["nct_id"] for r in kept) == ["N1", "N1", "W1", "W2"]
    assert not rejects


def test_search_file_ignores_the_wrapper(spark):
    assert one(spark, {"nct_id": "W1", **study()}, wrapped=False)["nct_id"] == "N1"


@pytest.mark.parametrize(
    "record, expected",
    [
        (json.dumps(study())[:-6], "undecodable"),
        ("", "undecodable"),
        ("[1, 2]", "undecodable"),
        (study(identificationModule__nctId=None), "no_id"),
        ({"nct_id": "W"}, "no_protocol"),
        (study(designModule__phases=["PHASE1"]), "phase"),
        (study(designModule__phases=[]), "phase"),
        (study(designModule__phases="PHASE1|PHASE2"), "phase"),
        (study(designModule__phases=None), "phase"),
        (study(designModule__studyType="OBSERVATIONAL"), "study_type"),
        (study(designModule__studyType=None), "study_type"),
        (study(sponsorCollaboratorsModule__leadSponsor__class="NIH"), "sponsor"),
        (study(conditionsModule__conditions=["a", 5]), "condition_item"),
        (study(conditionsModule__conditions=["a", None]), "condition_item"),
        (study(statusModule__overallStatus=None), "status"),
    ],
)
def test_rejects_with_reason(spark, record, expected):
    assert reason(spark, record) == expected


def test_phase_forms(spark):
    mixed = one(spark, study(designModule__phases=["PHASE1", "PHASE2"]))
    assert (mixed["phase"], mixed["phases_list"]) == ("PHASE1", ["PHASE1", "PHASE2"])
    text = one(spark, study(designModule__phases="PHASE2|PHASE3"))
    assert (text["phase"], text["phases_list"]) == ("PHASE2|PHASE3", None)


def test_case_insensitive_filters(spark):
    low = study(
        designModule__studyType="interventional",
        sponsorCollaboratorsModule__leadSponsor__class="industry",
    )
    assert one(spark, low)["lead_sponsor_type"] == "Industry"


@pytest.mark.parametrize(
    "status, label",
    [
        ("COMPLETED", 1),
        ("completed", 1),
        ("TERMINATED", 0),
        ("WITHDRAWN", 0),
        ("SUSPENDED", 0),
        ("RECRUITING", None),
        ("UNKNOWN", None),
    ],
)
def test_labels(spark, status, label):
    assert one(spark, study(statusModule__overallStatus=status))["label_feasible"] == label


def test_dates_are_read_from_structs_only(spark):
    row = one(
        spark,
        study(
            statusModule__studyFirstSubmitDate="2020-02-01",
            statusModule__lastUpdateSubmitDate={"date": "2021-03"},
        ),
    )
    assert row["start_date"] == "2020-01"
    assert row["study_first_submit_date"] is None
    assert row["last_update_submit_date"] == "2021-03"
    assert row["overall_status"] == "COMPLETED"


def test_lists_empty_and_absent(spark):
    row = one(
        spark,
        study(
            armsInterventionsModule__armGroups=[],
            armsInterventionsModule__interventions=[{"name": "", "type": "DRUG"}, {"name": "A"}],
            conditionsModule__conditions=[],
        ),
    )
    assert row["number_of_arms"] == 0 and row["arm_groups"] is None
    assert row["intervention_names"] == ["A"] and row["intervention_types"] == ["DRUG"]
    assert row["intervention_text"] == "A"
    assert row["condition_list"] is None and row["condition_text"] is None
    assert row["ipd_sharing_info_types"] == [] and row["see_also_links"] == []
    assert row["avail_ipds"] == [] and row["references"] is None
    assert row["number_of_facilities"] == 0 and row["has_us_sites"] == 0
    assert row["has_results"] is False and row["has_ipd_sharing_plan"] == 0


def test_arm_groups_keep_a_field_subset(spark):
    row = one(spark, study(armsInterventionsModule__armGroups=[{"label": "L", "extra": 1}]))
    arm = row["arm_groups"][0]
    assert arm.asDict() == {"label": "L", "type": None, "description": None, "interventionNames": []}


def test_first_truthy_values(spark):
    ids = [{"id": "A"}, {"id": "", "value": "B"}, {"id": ""}, {}]
    row = one(
        spark,
        study(
            identificationModule__secondaryIdInfos=ids,
            outcomesModule__otherOutcomes=[{"measure": "", "description": "D"}, {"measure": "M"}],
            sponsorCollaboratorsModule__responsibleParty={"name": "", "oldNameTitle": "Dr"},
        ),
    )
    assert row["secondary_ids"] == ["A", "B"]
    assert row["other_outcome_measures"] == ["D", "M"]
    assert row["responsible_party_name"] == "Dr" and row["responsible_party_title"] == "Dr"


@pytest.mark.parametrize(
    "modules, expected",
    [
        ({"oversightModule__dataMonitoringCommittee": False}, None),
        ({"oversightModule__dataMonitoringCommittee": True}, True),
        ({"oversightModule": {"dataMonitoringCommittee": False, "oversightHasDmc": False}}, False),
        ({"oversightModule": {}, "studyOversightModule": {"oversightHasDmc": True}}, True),
    ],
)
def test_oversight(spark, modules, expected):
    assert one(spark, study(**modules))["has_dmc"] is expected


def test_locations(spark):
    places = [
        {"country": "Spain", "city": "B"},
        {"country": "United States", "city": "A", "state": "S"},
        {"country": "Spain", "city": ""},
        {"country": "", "city": "B"},
    ]
    row = one(spark, study(contactsLocationsModule__locations=places))
    assert row["facility_countries"] == ["Spain", "United States"]
    assert row["facility_cities"] == ["B", "A"] and row["facility_states"] == ["S"]
    assert row["number_of_facilities"] == 4
    flags = [row[f"has_{x}_sites"] for x in ("us", "china", "eu")]
    assert flags == [1, 0, 1] and row["is_multicountry"] == 1


@pytest.mark.parametrize(
    "design, eligibility, expected",
    [
        ({"count": 5, "type": "ESTIMATED"}, {"count": 9, "type": "ACTUAL"}, (5, "ESTIMATED")),
        ({"count": 5, "type": "actual"}, None, (None, "actual")),
        ({"type": "ESTIMATED"}, {"count": 9, "type": "ACTUAL"}, (None, "ACTUAL")),
        ({"type": "ESTIMATED"}, {"count": 9}, (9, None)),
        (None, {"count": 9, "type": "ESTIMATED"}, (9, "ESTIMATED")),
    ],
)
def test_planned_enrollment(spark, design, eligibility, expected):
    row = one(
        spark,
        study(designModule__enrollmentInfo=design, eligibilityModule__enrollmentInfo=eligibility),
    )
    assert (row["enrollment_planned"], row["enrollment_planned_type"]) == expected


def test_ontology_leaves(spark):
    record = study()
    leaves = ["text", {"meshTerm": "", "term": "T"}, {"name": 5, "title": "no"}, {"title": "Z"}, 7]
    record["derivedSection"] = {
        "conditionBrowseModule": {"browseLeaves": leaves},
        "interventionBrowseModule": {"browseLeaves": []},
    }
    row = one(spark, record)
    assert row["condition_mesh_terms"] == ["text", "T", "Z"]
    assert row["intervention_mesh_terms"] is None


def test_description_joins_only_filled_parts(spark):
    row = one(
        spark,
        study(
            descriptionModule={"briefSummary": "Sum"},
            eligibilityModule__eligibilityCriteria="Crit",
        ),
    )
    assert row["description_text"] == "Brief Sum Crit"


def test_column_count_and_flat_encoding(spark):
    lines = spark.createDataFrame([Row(value=json.dumps(study()))])
    table, _ = parse_records(lines)
    assert len(table.columns) == 108
    flat = encode_nested(table)
    assert not [kind for _, kind in flat.dtypes if kind.startswith(("array", "struct"))]
    assert flat.first()["condition_list"] == '["NSCLC","Other"]'


def test_files_in_order_of_preference(spark, tmp_path):
    path = f"{tmp_path}/search.jsonl"
    with open(path, "w", encoding="utf-8") as out:
        out.write(json.dumps(study()) + "\n" + json.dumps(copy.deepcopy(study()))[:20] + "\n")
    assert first_existing(spark, [f"{tmp_path}/full.jsonl", path]) == path
    with pytest.raises(FileNotFoundError):
        first_existing(spark, [f"{tmp_path}/none"])
    kept, rejects = filter_records(read_lines(spark, path))
    assert kept.count() == 1 and rejects.count() == 1


def document_tables(spark, folder, n=400):
    """Documents with ids that are null or repeat, and labels of some of them, twice for one."""
    text = " ".join(f"word{i}" for i in range(300))
    docs = [(None if i == 7 else i % (n - 5), f"{i} {text}\nend", "en", f"src{i % 4}", 9) for i in range(n)]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{folder}/documents.parquet")
    labels = [(i, i % 2, 0) for i in range(0, n, 3)] + [(3, 0, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality bigint, toxic bigint").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_lines_are_joined_without_a_sort_and_stored_packed(spark, tmp_path):
    folder = document_tables(spark, tmp_path)
    with settings(spark, {"spark.sql.autoBroadcastJoinThreshold": -1}):
        lines = record_lines(spark, folder)
        plan = lines._jdf.queryExecution().executedPlan().toString()
        assert "ShuffledHashJoin" in plan and "Sort" not in plan
        want = sorted(r["value"] or "" for r in lines.collect())
    assert len(want) == 401 + 1  # labels name one id twice, and two documents share it
    path = record_files(spark, folder)
    raw = sum(len(x.encode()) + 1 for x in want)
    at = path.removeprefix("file:").replace("///", "/")
    stored = sum(os.path.getsize(f"{at}/{f}") for f in os.listdir(at) if f.startswith("part-"))
    assert 0 < stored * 3 < raw
    assert sorted(r["value"] for r in read_lines(spark, path).collect()) == want


def test_folders_are_written_without_a_sort(spark, tmp_path, monkeypatch):
    lines = spark.createDataFrame([Row(value=json.dumps(study())), Row(value="{"), Row(value=json.dumps(study(designModule__studyType="X")))] * 5)
    name, seen, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    before = spark.conf.get(name)
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path: seen.append(spark.conf.get(name)) or write(self, path))
    write_stage(parse_all(lines).coalesce(1), f"{tmp_path}/out", ["kept"])
    assert int(seen[0]) > 1 and spark.conf.get(name) == before
    stored = spark.read.parquet(f"{tmp_path}/out")
    assert {(r["kept"], r["count"]) for r in stored.groupBy("kept").count().collect()} == {("true", 5), ("false", 10)}


def test_more_folders_than_are_held_open(spark, tmp_path):
    write_stage(spark.range(0, 300, 1, 2).selectExpr("id", "id % 37 AS k"), f"{tmp_path}/out", ["k"])
    assert {(r["k"], r["count"]) for r in spark.read.parquet(f"{tmp_path}/out").groupBy("k").count().collect()} == {(k, len(range(k, 300, 37))) for k in range(37)}
