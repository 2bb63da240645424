"""Record filters and the flat projection of a study record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.functions import nested as n
from cohortloom.functions.text import joined_non_empty
from cohortloom.sources.records import CORRUPT, STUDY_PARTS, has_any_field, line_gate, unwrap


def phase_values(phases: Column) -> Column:
    """Phases as an array: a list as it is, a bare string as its only element."""
    listed = F.from_json(phases, "array<string>")
    return F.when(F.ltrim(phases).startswith("["), listed).otherwise(F.array(phases))


def _reason(
    gate: Column,
    phases: Sequence[str],
    study_type: str,
    sponsor_class: str,
    wrapped: bool,
) -> Column:
    """Why a line is rejected, tested in the order of the filters; null when it is kept."""
    bare = gate["protocolSection"]
    if wrapped:
        filled = has_any_field(gate["record"], STUDY_PARTS)
        protocol = F.when(filled, gate["record"]["protocolSection"]).otherwise(bare)
        given_id = gate["nct_id"]
    else:
        protocol, given_id = bare, F.lit(None).cast("string")
    record_id = n.first_truthy(given_id, protocol["identificationModule"]["nctId"])
    design = protocol["designModule"]
    accepted = F.array(*[F.lit(p) for p in phases])
    items = protocol["conditionsModule"]["conditions"]
    nothing_read = gate["nct_id"].isNull() & gate["record"].isNull() & bare.isNull()
    undecodable = gate.isNull() | (gate[CORRUPT].isNotNull() & nothing_read)

    def fails(condition: Column) -> Column:
        return ~F.coalesce(condition, F.lit(False))

    return (
        F.when(undecodable, "undecodable")
        .when(record_id.isNull(), "no_id")
        .when(protocol.isNull(), "no_protocol")
        .when(fails(F.arrays_overlap(phase_values(design["phases"]), accepted)), "phase")
        .when(fails(F.upper(design["studyType"]) == study_type), "study_type")
        .when(
            fails(
                F.upper(protocol["sponsorCollaboratorsModule"]["leadSponsor"]["class"])
                == sponsor_class
            ),
            "sponsor",
        )
        .when(F.exists(items, lambda x: F.schema_of_variant(x) != "STRING"), "condition_item")
        .when(protocol["statusModule"]["overallStatus"].isNull(), "status")
    )


def reject_reason(
    line: Column,
    phases: Sequence[str] = tuple(fv.ACCEPTED_PHASES),
    study_type: str = fv.ACCEPTED_STUDY_TYPE,
    sponsor_class: str = fv.ACCEPTED_SPONSOR_CLASS,
    wrapped: bool = True,
) -> Column:
    """Reject reason of a raw line, null for a line that is kept.

    The gate fields are bound once by the one-element ``transform``, so that a
    filter on the reason parses each line once.
    """
    gate = F.array(line_gate(line))
    reasons = F.transform(gate, lambda g: _reason(g, phases, study_type, sponsor_class, wrapped))
    return F.get(reasons, F.lit(0))


def filter_records(
    lines: DataFrame, line: str = "value", wrapped: bool = True, **limits
) -> tuple[DataFrame, DataFrame]:
    """Split raw lines into kept lines and rejects (with ``reject_reason``)."""
    reason = reject_reason(F.col(line), wrapped=wrapped, **limits)
    kept = lines.filter(reason.isNull())
    rejects = lines.select("*", reason.alias("reject_reason")).filter(
        F.col("reject_reason").isNotNull()
    )
    return kept, rejects


# --- fixed values: flat column -> field below the named record section -------
SCALAR_FIELDS = {
    "identificationModule": {
        "brief_title": "briefTitle",
        "official_title": "officialTitle",
        "acronym": "acronym",
    },
    "statusModule": {
        "overall_status": "overallStatus",
        "last_known_status": "lastKnownStatus",
        "why_stopped": "whyStopped",
        "status_verified_date": "statusVerifiedDate",
        "start_date": "startDateStruct.date",
        "primary_completion_date": "primaryCompletionDateStruct.date",
        "completion_date": "completionDateStruct.date",
        "study_first_submit_date": "studyFirstSubmitDate.date",
        "study_first_submit_qc_date": "studyFirstSubmitQcDate.date",
        "first_posted_date": "studyFirstPostDateStruct.date",
        "results_first_submit_date": "resultsFirstSubmitDate.date",
        "results_first_submit_qc_date": "resultsFirstSubmitQcDate.date",
        "results_first_posted_date": "resultsFirstPostDateStruct.date",
        "last_update_submit_date": "lastUpdateSubmitDate.date",
        "last_update_posted_date": "lastUpdatePostDateStruct.date",
        "has_expanded_access": "expandedAccessInfo.hasExpandedAccess",
        "enrollment_actual": "enrollmentInfo.actualCount",
        "enrollment_actual_type": "enrollmentInfo.type",
    },
    "designModule": {
        "study_type": "studyType",
        "allocation": "designInfo.allocation",
        "intervention_model": "designInfo.interventionModel",
        "intervention_model_description": "designInfo.interventionModelDescription",
        "primary_purpose": "designInfo.primaryPurpose",
        "observational_model": "designInfo.observationalModel",
        "time_perspective": "designInfo.timePerspective",
        "patient_registry": "designInfo.patientRegistry",
        "masking": "designInfo.maskingInfo.masking",
        "masking_description": "designInfo.maskingInfo.maskingDescription",
        "target_duration": "targetDuration",
        "biospec_retention": "bioSpec.retention",
        "biospec_description": "bioSpec.description",
    },
    "eligibilityModule": {
        "eligibility_criteria_text": "eligibilityCriteria",
        "study_population": "studyPopulation",
        "sampling_method": "samplingMethod",
        "healthy_volunteers": "healthyVolunteers",
        "sex": "sex",
        "gender": "sex",
        "gender_based": "genderBased",
        "gender_description": "genderDescription",
        "min_age": "minimumAge",
        "max_age": "maximumAge",
    },
    "sponsorCollaboratorsModule": {
        "lead_sponsor_name": "leadSponsor.name",
        "responsible_party_type": "responsibleParty.type",
        "responsible_party_title": "responsibleParty.oldNameTitle",
        "responsible_party_organization": "responsibleParty.oldOrganization",
        "responsible_party_investigator_full_name": "responsibleParty.investigatorFullName",
        "responsible_party_investigator_title": "responsibleParty.investigatorTitle",
        "responsible_party_investigator_affiliation": "responsibleParty.investigatorAffiliation",
    },
    "descriptionModule": {
        "brief_summary": "briefSummary",
        "detailed_description": "detailedDescription",
    },
    "ipdSharingStatementModule": {
        "ipd_sharing_description": "description",
        "ipd_sharing_time_frame": "timeFrame",
        "ipd_sharing_access_criteria": "accessCriteria",
        "ipd_sharing_url": "url",
    },
}


def _path(root: Column, dotted: str) -> Column:
    for part in dotted.split("."):
        root = root[part]
    return root


def _scalars(protocol: Column) -> dict[str, Column]:
    return {
        name: _path(protocol[section], field)
        for section, fields in SCALAR_FIELDS.items()
        for name, field in fields.items()
    }


def _lists(protocol: Column) -> dict[str, Column]:
    """List-valued columns: struct lists, plucked values and plain string lists."""
    arms = protocol["armsInterventionsModule"]
    outcomes = protocol["outcomesModule"]
    contacts = protocol["contactsLocationsModule"]
    links = protocol["referencesModule"]
    words = F.transform(
        protocol["conditionsModule"]["conditions"], lambda v: F.try_variant_get(v, "$", "string")
    )
    arm_groups = F.transform(
        arms["armGroups"],
        lambda a: a.withField(
            "interventionNames", F.coalesce(a["interventionNames"], F.array().cast("array<string>"))
        ),
    )
    no_text = F.array().cast("array<string>")
    return {
        "secondary_ids": n.pluck(
            protocol["identificationModule"]["secondaryIdInfos"], "id", "value"
        ),
        "who_masked": n.null_if_empty(
            protocol["designModule"]["designInfo"]["maskingInfo"]["whoMasked"]
        ),
        "arm_groups": n.kept_structs(arm_groups),
        "interventions": n.kept_structs(arms["interventions"]),
        "intervention_names": n.pluck(arms["interventions"], "name"),
        "intervention_types": n.pluck(arms["interventions"], "type"),
        "condition_list": n.null_if_empty(words),
        "keywords": n.null_if_empty(protocol["conditionsModule"]["keywords"]),
        "primary_outcome_measures": n.pluck(outcomes["primaryOutcomes"], "measure"),
        "primary_outcomes": n.kept_structs(outcomes["primaryOutcomes"]),
        "secondary_outcome_measures": n.pluck(outcomes["secondaryOutcomes"], "measure"),
        "secondary_outcomes": n.kept_structs(outcomes["secondaryOutcomes"]),
        "other_outcome_measures": n.pluck(outcomes["otherOutcomes"], "measure", "description"),
        "std_ages": n.null_if_empty(protocol["eligibilityModule"]["stdAges"]),
        "collaborators": n.kept_structs(protocol["sponsorCollaboratorsModule"]["collaborators"]),
        "overall_officials": n.kept_structs(contacts["overallOfficials"]),
        "central_contacts": n.kept_structs(contacts["centralContacts"]),
        "references": n.kept_structs(links["references"]),
        # these three keep an empty list instead of null
        "ipd_sharing_info_types": F.coalesce(
            protocol["ipdSharingStatementModule"]["infoTypes"], no_text
        ),
        "see_also_links": F.coalesce(links["seeAlsoLinks"], no_text),
        "avail_ipds": F.coalesce(links["availIpds"], no_text),
    }


def _derived(protocol: Column, derived: Column) -> dict[str, Column]:
    """Columns that need a rule rather than a path."""
    design = protocol["designModule"]
    locations = protocol["contactsLocationsModule"]["locations"]
    countries = n.distinct_values(locations, "country")
    sponsor = protocol["sponsorCollaboratorsModule"]["leadSponsor"]
    party = protocol["sponsorCollaboratorsModule"]["responsibleParty"]
    main, other = protocol["oversightModule"], protocol["studyOversightModule"]
    oversight_fields = [
        "dataMonitoringCommittee",
        "oversightHasDmc",
        "isFdaRegulatedDrug",
        "isFdaRegulatedDevice",
        "isUnapprovedDevice",
        "isPpsd",
        "isUsExport",
    ]
    use_main = has_any_field(main, oversight_fields)

    def oversight(field: str) -> Column:
        return F.when(use_main, main[field]).otherwise(other[field])

    planned = design["enrollmentInfo"]
    fallback = protocol["eligibilityModule"]["enrollmentInfo"]
    count_given = planned["count"].isNotNull()
    planned_type = F.when(count_given, planned["type"]).otherwise(fallback["type"])
    phases = phase_values(design["phases"])
    is_list = F.ltrim(design["phases"]).startswith("[")
    fields = {
        "phase": n.first_element(phases),
        "phases_list": F.when(is_list, n.null_if_empty(phases)),
        "enrollment_planned": n.mask_when(
            F.coalesce(planned["count"], fallback["count"]), F.upper(planned_type) == "ACTUAL"
        ),
        "enrollment_planned_type": planned_type,
        "number_of_arms": n.cardinality(protocol["armsInterventionsModule"]["armGroups"]),
        "lead_sponsor_type": F.when(
            F.upper(sponsor["class"]) == fv.ACCEPTED_SPONSOR_CLASS, "Industry"
        ).otherwise("Other"),
        "responsible_party_name": n.first_truthy(party["name"], party["oldNameTitle"]),
        "number_of_facilities": n.cardinality(locations),
        "facility_countries": countries,
        "facility_cities": n.distinct_values(locations, "city"),
        "facility_states": n.distinct_values(locations, "state"),
        "has_us_sites": n.contains_any(countries, [fv.US_COUNTRY]),
        "has_china_sites": n.contains_any(countries, [fv.CHINA_COUNTRY]),
        "has_eu_sites": n.contains_any(countries, fv.EU_COUNTRIES),
        "is_multicountry": n.flag(F.size(countries) > 1),
        "has_dmc": n.first_true(oversight("dataMonitoringCommittee"), oversight("oversightHasDmc")),
        "is_fda_regulated_drug": oversight("isFdaRegulatedDrug"),
        "is_fda_regulated_device": oversight("isFdaRegulatedDevice"),
        "is_unapproved_device": oversight("isUnapprovedDevice"),
        "is_ppsd": oversight("isPpsd"),
        "is_us_export": oversight("isUsExport"),
        "has_ipd_sharing_plan": n.yes_flag(protocol["ipdSharingStatementModule"]["ipdSharing"]),
        "condition_mesh_terms": n.ontology_terms(derived["conditionBrowseModule"]["browseLeaves"]),
        "intervention_mesh_terms": n.ontology_terms(
            derived["interventionBrowseModule"]["browseLeaves"]
        ),
        "label_feasible": n.label_from_status(protocol["statusModule"]["overallStatus"]),
    }
    return fields


def project_record(studies: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    """Flat table of unwrapped studies: one typed column per field, lists kept native.

    ``extra`` columns are passed through.
    """
    protocol, derived = F.col("protocol"), F.col("derived")
    columns = {**_scalars(protocol), **_lists(protocol), **_derived(protocol, derived)}
    flat = studies.select(
        *extra, "nct_id", "has_results", *[column.alias(name) for name, column in columns.items()]
    )
    return flat.select(
        "*",
        n.join_words(F.col("condition_list")).alias("condition_text"),
        n.join_words(F.col("intervention_names")).alias("intervention_text"),
        joined_non_empty(*[F.col(c) for c in fv.DESCRIPTION_FIELDS]).alias("description_text"),
    )


def parse_records(
    lines: DataFrame, line: str = "value", wrapped: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Raw lines to (flat table, rejects); only kept lines pay for the full parse."""
    kept, rejects = filter_records(lines.select(line), line, wrapped)
    return project_record(unwrap(kept, line, wrapped)), rejects


def parse_all(lines: DataFrame, line: str = "value", wrapped: bool = True) -> DataFrame:
    """Every line in one pass: the flat table with ``kept``, and for rejects reason and line.

    Written partitioned by ``kept``, this stores table and rejects with a single read
    of the lines; a rejected line is not parsed any further.
    """
    reason = reject_reason(F.col(line), wrapped=wrapped)
    gated = lines.select(F.col(line).alias("_line_text"), reason.alias("reject_reason"))
    kept = F.col("reject_reason").isNull()
    split = gated.select(
        F.when(kept, F.col("_line_text")).alias("_kept_line"),
        F.when(~kept, F.col("_line_text")).alias("rejected_line"),
        "reject_reason",
    )
    extra = ["rejected_line", "reject_reason"]
    flat = project_record(unwrap(split, "_kept_line", wrapped), extra)
    return flat.withColumn("kept", kept)


def drop_unlabelled(df: DataFrame, label: str = fv.LABEL_COLUMN) -> DataFrame:
    return df.filter(F.col(label).isNotNull())


def encode_nested(df: DataFrame) -> DataFrame:
    """Arrays and structs as JSON text, for sinks that hold only flat columns."""

    def flat(name: str, kind: str) -> Column:
        if kind.startswith(("array", "struct", "map")):
            return F.to_json(F.col(name), {"ignoreNullFields": "false"}).alias(name)
        return F.col(name)

    return df.select(*[flat(name, kind) for name, kind in df.dtypes])
