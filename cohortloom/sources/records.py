"""Registry records: one JSON object per line, wrapped or bare."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_DATE = "struct<date:string>"
_OUTCOMES = "array<struct<measure:string,description:string,timeFrame:string>>"
_ENROLLMENT = "struct<count:bigint,type:string>"
_OVERSIGHT = (
    "struct<dataMonitoringCommittee:boolean,oversightHasDmc:boolean,isFdaRegulatedDrug:boolean,"
    "isFdaRegulatedDevice:boolean,isUnapprovedDevice:boolean,isPpsd:boolean,isUsExport:boolean>"
)
_BROWSE = "struct<browseLeaves:array<variant>>"

# --- fixed values: field names and types of a registry record ----------------
# phases is a list or a string, so it stays text; condition items and ontology
# leaves may be of any kind, so they stay variants.
SECTIONS = {
    "identificationModule": (
        "nctId:string,briefTitle:string,officialTitle:string,acronym:string,"
        "secondaryIdInfos:array<struct<id:string,value:string>>"
    ),
    "statusModule": (
        "overallStatus:string,lastKnownStatus:string,whyStopped:string,statusVerifiedDate:string,"
        f"startDateStruct:{_DATE},primaryCompletionDateStruct:{_DATE},completionDateStruct:{_DATE},"
        f"studyFirstPostDateStruct:{_DATE},resultsFirstPostDateStruct:{_DATE},"
        f"lastUpdatePostDateStruct:{_DATE},studyFirstSubmitDate:{_DATE},"
        f"studyFirstSubmitQcDate:{_DATE},resultsFirstSubmitDate:{_DATE},"
        f"resultsFirstSubmitQcDate:{_DATE},lastUpdateSubmitDate:{_DATE},"
        "expandedAccessInfo:struct<hasExpandedAccess:boolean>,"
        "enrollmentInfo:struct<actualCount:bigint,type:string>"
    ),
    "designModule": (
        "studyType:string,phases:string,"
        "designInfo:struct<allocation:string,interventionModel:string,"
        "interventionModelDescription:string,primaryPurpose:string,observationalModel:string,"
        "timePerspective:string,patientRegistry:boolean,"
        "maskingInfo:struct<masking:string,maskingDescription:string,whoMasked:array<string>>>,"
        f"enrollmentInfo:{_ENROLLMENT},targetDuration:string,"
        "bioSpec:struct<retention:string,description:string>"
    ),
    "armsInterventionsModule": (
        "armGroups:array<struct<label:string,type:string,description:string,"
        "interventionNames:array<string>>>,"
        "interventions:array<struct<name:string,type:string,description:string>>"
    ),
    "conditionsModule": "conditions:array<variant>,keywords:array<string>",
    "outcomesModule": (
        f"primaryOutcomes:{_OUTCOMES},secondaryOutcomes:{_OUTCOMES},otherOutcomes:{_OUTCOMES}"
    ),
    "eligibilityModule": (
        "eligibilityCriteria:string,studyPopulation:string,samplingMethod:string,"
        "healthyVolunteers:boolean,sex:string,genderBased:boolean,genderDescription:string,"
        f"minimumAge:string,maximumAge:string,stdAges:array<string>,enrollmentInfo:{_ENROLLMENT}"
    ),
    "sponsorCollaboratorsModule": (
        "leadSponsor:struct<name:string,class:string>,"
        "collaborators:array<struct<name:string,class:string>>,"
        "responsibleParty:struct<type:string,name:string,oldNameTitle:string,"
        "oldOrganization:string,investigatorFullName:string,investigatorTitle:string,"
        "investigatorAffiliation:string>"
    ),
    "contactsLocationsModule": (
        "locations:array<struct<country:string,city:string,state:string>>,"
        "overallOfficials:array<struct<name:string,role:string,affiliation:string>>,"
        "centralContacts:array<struct<name:string,role:string,phone:string,email:string>>"
    ),
    "descriptionModule": "briefSummary:string,detailedDescription:string",
    "ipdSharingStatementModule": (
        "ipdSharing:string,description:string,timeFrame:string,accessCriteria:string,"
        "url:string,infoTypes:array<string>"
    ),
    "referencesModule": (
        "references:array<struct<citation:string,type:string,pmid:string,url:string>>,"
        "seeAlsoLinks:array<string>,availIpds:array<string>"
    ),
}

_PROTOCOL = ",".join(
    [f"{name}:struct<{fields}>" for name, fields in SECTIONS.items()]
    + [f"oversightModule:{_OVERSIGHT}", f"studyOversightModule:{_OVERSIGHT}"]
)
_STUDY = (
    f"protocolSection:struct<{_PROTOCOL}>,"
    f"derivedSection:struct<conditionBrowseModule:{_BROWSE},interventionBrowseModule:{_BROWSE}>,"
    "hasResults:boolean"
)
CORRUPT = "corrupt_line"
LINE_SCHEMA = f"struct<nct_id:string,record:struct<{_STUDY}>,{_STUDY},{CORRUPT}:string>"

# The few fields the record filters look at.
STUDY_PARTS = ["protocolSection", "derivedSection", "hasResults"]
_GATE_PROTOCOL = (
    "protocolSection:struct<identificationModule:struct<nctId:string>,"
    "designModule:struct<studyType:string,phases:string>,"
    "sponsorCollaboratorsModule:struct<leadSponsor:struct<class:string>>,"
    "conditionsModule:struct<conditions:array<variant>>,"
    "statusModule:struct<overallStatus:string>>,"
    "derivedSection:string,hasResults:boolean"
)
GATE_SCHEMA = f"struct<nct_id:string,record:struct<{_GATE_PROTOCOL}>,{_GATE_PROTOCOL},{CORRUPT}:string>"

_CORRUPT_OPTION = {"columnNameOfCorruptRecord": CORRUPT, "mode": "PERMISSIVE"}


def first_existing(spark: SparkSession, paths: Sequence[str]) -> str:
    """First path that exists, in order of preference; an error when none does."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        target = jvm.org.apache.hadoop.fs.Path(path)
        if target.getFileSystem(conf).exists(target):
            return path
    raise FileNotFoundError(f"none of these exists: {list(paths)}")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The raw lines of a JSON-lines file or folder, column ``value``."""
    return spark.read.text(path)


def line_gate(line: Column) -> Column:
    """The filter fields of a line; a small parse that skips everything else."""
    return F.from_json(line, GATE_SCHEMA, _CORRUPT_OPTION)


def parsed_line(line: Column) -> Column:
    """The whole line as a typed struct."""
    return F.from_json(line, LINE_SCHEMA, _CORRUPT_OPTION)


def has_any_field(struct: Column, fields: Sequence[str]) -> Column:
    """True when the struct holds at least one of ``fields``."""
    present = [F.when(struct[f].isNotNull(), F.lit(True)) for f in fields]
    return F.coalesce(*present, F.lit(False))


def unwrap(lines: DataFrame, line: str = "value", wrapped: bool = True) -> DataFrame:
    """Typed study columns of every line: id, protocol, derived, has_results, corrupt text.

    ``wrapped`` accepts the ``{"nct_id", "record"}`` form next to the bare study;
    a wrapper whose record is empty falls back to the line itself.
    """
    parsed = lines.select("*", parsed_line(F.col(line)).alias("_line"))
    wrapper = F.col("_line.record")
    filled = has_any_field(wrapper, STUDY_PARTS)

    def part(name: str) -> Column:
        bare = F.col(f"_line.{name}")
        return F.when(filled, wrapper[name]).otherwise(bare) if wrapped else bare

    given_id = F.col("_line.nct_id") if wrapped else F.lit(None).cast("string")
    own_id = part("protocolSection")["identificationModule"]["nctId"]
    return parsed.select(
        *lines.columns,
        F.coalesce(F.nullif(given_id, F.lit("")), F.nullif(own_id, F.lit(""))).alias("nct_id"),
        part("protocolSection").alias("protocol"),
        part("derivedSection").alias("derived"),
        F.coalesce(part("hasResults"), F.lit(False)).alias("has_results"),
        F.col(f"_line.{CORRUPT}").alias(CORRUPT),
    )
