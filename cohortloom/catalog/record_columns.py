"""Every column of a parsed record, on lines in which every field of the schema is filled."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortloom.catalog.registry import query, table
from cohortloom.operators.records import SCALAR_FIELDS, parse_records
from cohortloom.sources.records import SECTIONS

# values that the record filters ask for
_FIXED = {
    "designModule.studyType": "Interventional",
    "designModule.phases": "@phases@",
    "sponsorCollaboratorsModule.leadSponsor.class": "INDUSTRY",
    "statusModule.overallStatus": "COMPLETED",
}
_FLAGS = ("hasExpandedAccess", "patientRegistry", "healthyVolunteers", "genderBased")
_NUMBERS = ("actualCount",)
_OVERSIGHT = ["dataMonitoringCommittee", "isFdaRegulatedDrug", "isFdaRegulatedDevice", "isUnapprovedDevice", "isPpsd", "isUsExport"]


def _filled(kind: T.DataType, path: str) -> Column:
    """A value made of the field's path and the document's id."""
    if path in _FIXED:
        return F.lit(_FIXED[path])
    if isinstance(kind, T.StructType):
        return F.struct(*[_filled(f.dataType, f"{path}.{f.name}").alias(f.name) for f in kind])
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType if isinstance(kind.elementType, T.StructType) else T.StringType()
        return F.array(*[_filled(inner, f"{path}/{i}") for i in (0, 1)])
    if isinstance(kind, T.BooleanType):
        return F.col("doc_id") % 2 == 0
    if isinstance(kind, T.LongType):
        return F.col("doc_id")
    return F.concat(F.lit(f"{path}-"), F.col("doc_id").cast("string"))


def _text(name: str, kind: T.DataType) -> Column:
    column = F.col(name)
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        fields = kind.elementType.fields

        def joined(x: Column) -> Column:
            return F.concat_ws(
                "|", *[F.array_join(x[f.name], "+") if isinstance(f.dataType, T.ArrayType) else x[f.name] for f in fields]
            )

        column = F.array_join(F.transform(column, joined), ";")
    elif isinstance(kind, T.ArrayType):
        column = F.array_join(column, ",")
    return column.cast("string").alias(name)


def _leaf(path: str) -> str:
    """SQL for the value at a path of the schema."""
    if path in _FIXED:
        return f"'{_FIXED[path]}'"
    if path.endswith(_FLAGS):
        return "CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END"
    return "CAST(doc_id AS VARCHAR)" if path.endswith(_NUMBERS) else f"'{path}-' || doc_id"


def _two(path: str, *fields: str, inner: str = "|", outer: str = ";") -> str:
    """SQL for two list elements, each with its ``fields`` (or the element itself)."""

    def one(i: int) -> str:
        parts = [f"{path}/{i}" + (f".{f}" if f else "") for f in fields or ("",)]
        texts = [
            f"'{p}/0-' || doc_id || '+{p}/1-' || doc_id" if p.endswith("Names") else f"'{p}-' || doc_id" for p in parts
        ]
        return f" || '{inner}' || ".join(texts)

    return f"{one(0)} || '{outer}' || {one(1)}"


def _expected() -> dict[str, str]:
    flag = "CASE WHEN doc_id % 2 = 0 THEN 'true' ELSE 'false' END"
    found = {n: _leaf(f"{s}.{path}") for s, fields in SCALAR_FIELDS.items() for n, path in fields.items()}
    arms, outcomes, places = "armsInterventionsModule", "outcomesModule", "contactsLocationsModule"
    outcome = ("measure", "description", "timeFrame")
    found |= {
        "secondary_ids": _two("identificationModule.secondaryIdInfos", "id", outer=","),
        "who_masked": _two("designModule.designInfo.maskingInfo.whoMasked", outer=","),
        "arm_groups": _two(f"{arms}.armGroups", "label", "type", "description", "interventionNames"),
        "interventions": _two(f"{arms}.interventions", "name", "type", "description"),
        "intervention_names": _two(f"{arms}.interventions", "name", outer=","),
        "intervention_types": _two(f"{arms}.interventions", "type", outer=","),
        "intervention_text": _two(f"{arms}.interventions", "name", outer=" "),
        "condition_list": _two("conditionsModule.conditions", outer=","),
        "condition_text": _two("conditionsModule.conditions", outer=" "),
        "keywords": _two("conditionsModule.keywords", outer=","),
        "primary_outcomes": _two(f"{outcomes}.primaryOutcomes", *outcome),
        "secondary_outcomes": _two(f"{outcomes}.secondaryOutcomes", *outcome),
        "primary_outcome_measures": _two(f"{outcomes}.primaryOutcomes", "measure", outer=","),
        "secondary_outcome_measures": _two(f"{outcomes}.secondaryOutcomes", "measure", outer=","),
        "other_outcome_measures": _two(f"{outcomes}.otherOutcomes", "measure", outer=","),
        "std_ages": _two("eligibilityModule.stdAges", outer=","),
        "collaborators": _two("sponsorCollaboratorsModule.collaborators", "name", "class"),
        "overall_officials": _two(f"{places}.overallOfficials", "name", "role", "affiliation"),
        "central_contacts": _two(f"{places}.centralContacts", "name", "role", "phone", "email"),
        "references": _two("referencesModule.references", "citation", "type", "pmid", "url"),
        "ipd_sharing_info_types": _two("ipdSharingStatementModule.infoTypes", outer=","),
        "see_also_links": _two("referencesModule.seeAlsoLinks", outer=","),
        "avail_ipds": _two("referencesModule.availIpds", outer=","),
        "facility_countries": _two(f"{places}.locations", "country", outer=","),
        "facility_cities": _two(f"{places}.locations", "city", outer=","),
        "facility_states": _two(f"{places}.locations", "state", outer=","),
        "condition_mesh_terms": _two("derivedSection.conditionBrowseModule.browseLeaves", outer=","),
        "intervention_mesh_terms": _two("derivedSection.interventionBrowseModule.browseLeaves", outer=","),
        "responsible_party_name": _leaf("sponsorCollaboratorsModule.responsibleParty.name"),
        "enrollment_planned": "CAST(doc_id AS VARCHAR)",
        "enrollment_planned_type": _leaf("designModule.enrollmentInfo.type"),
        "nct_id": "'identificationModule.nctId-' || doc_id",
        "has_results": flag, "has_dmc": "CASE WHEN doc_id % 2 = 0 THEN 'true' END", "is_fda_regulated_drug": flag, "is_fda_regulated_device": flag,
        "is_unapproved_device": flag, "is_ppsd": flag, "is_us_export": flag,
        "phase": "'PHASE1'", "phases_list": "'PHASE1,PHASE2'", "number_of_arms": "'2'", "number_of_facilities": "'2'",
        "lead_sponsor_type": "'Industry'", "has_us_sites": "'0'", "has_china_sites": "'0'", "has_eu_sites": "'0'",
        "is_multicountry": "'1'", "has_ipd_sharing_plan": "'0'", "label_feasible": "'1'",
    }
    return found


#: The description joins several texts under a rule of its own, tested by ``described_text`` queries.
_APART = {"description_text"}


@query(
    "every_record_column",
    "SELECT " + ", ".join(f'{sql} AS "{name}"' for name, sql in sorted(_expected().items())) + " FROM documents",
)
def every_record_column(spark, sf):
    """All scalars, dates, rules and struct lists of the flat table, as text."""
    protocol = [
        _filled(T.StructType.fromDDL(fields), name).alias(name) for name, fields in SECTIONS.items()
    ]
    oversight = F.struct(*[(F.col("doc_id") % 2 == 0).alias(f) for f in _OVERSIGHT]).alias("oversightModule")
    leaves = T.ArrayType(T.StringType())
    derived = F.struct(*[
        F.struct(_filled(leaves, f"derivedSection.{b}.browseLeaves").alias("browseLeaves")).alias(b)
        for b in ("conditionBrowseModule", "interventionBrowseModule")
    ])
    study = F.struct(
        F.struct(*protocol, oversight).alias("protocolSection"), derived.alias("derivedSection"),
        (F.col("doc_id") % 2 == 0).alias("hasResults"),
    )
    line = F.replace(F.to_json(study), F.lit('"@phases@"'), F.lit('["PHASE1","PHASE2"]'))
    lines = table(spark, sf, "documents").select(line.alias("value"))
    parsed, _ = parse_records(lines)
    missing = set(parsed.columns) ^ set(_expected()) ^ _APART
    if missing:
        raise AssertionError(f"columns on one side only: {sorted(missing)}")
    return parsed.select(*[_text(f.name, f.dataType) for f in parsed.schema if f.name not in _APART])
