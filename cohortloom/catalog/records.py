"""Record parsing, on registry-like JSON lines that Spark derives from documents and labels.

Every document becomes one line holding its whole text. Lines differ by document:
wrapped, bare, wrapped with an empty record, or cut off; phases as a list or as a
string; ontology leaves as strings and objects; some fail one of the filters.
"""

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortloom.catalog.registry import as_long, query, table
from cohortloom.operators.records import (
    drop_unlabelled,
    filter_records,
    parse_all,
    parse_records,
)
from cohortloom.session import ensure_checkpoint_dir
from cohortloom.plans.dataset import parse_stage
from cohortloom.sources.records import first_existing, read_lines
from cohortloom.sources.tables import read_stage, write_results, write_stage

_JSON = {"ignoreNullFields": "true"}
LINES_PER_FILE = 10_000


def _sentences():
    return F.split("text", "\n")


def record_lines(spark, sf) -> DataFrame:
    """One JSON line per document: doc_id, value. The join hashes the narrow labels, so that no text is sorted."""
    labels = table(spark, sf, "labels").hint("shuffle_hash")
    docs = table(spark, sf, "documents").join(labels, "doc_id", "left")
    kind = F.pmod("doc_id", F.lit(10))
    lines = _sentences()
    toxic, quality = F.col("toxic") == 1, F.col("quality") == 1
    text = F.lit(None).cast("string")
    country = (
        F.when(F.pmod(F.length("text"), F.lit(3)) == 0, "United States")
        .when(F.pmod(F.length("text"), F.lit(3)) == 1, "Italy")
        .otherwise("")
    )
    protocol = F.struct(
        F.struct(
            F.concat(F.lit("N"), "doc_id").alias("nctId"),
            F.concat_ws(" ", "lang", "source").alias("briefTitle"),
            F.lit("").alias("officialTitle"),
            F.array(
                F.struct(F.col("source").alias("id"), text.alias("value")),
                F.struct(F.lit("").alias("id"), F.col("lang").alias("value")),
                F.struct(F.lit("").alias("id"), text.alias("value")),
            ).alias("secondaryIdInfos"),
        ).alias("identificationModule"),
        F.struct(
            F.when(F.col("source") == "src7", None)
            .when(F.col("lang") == "en", "completed")
            .when(F.col("lang") == "fr", "TERMINATED")
            .otherwise("RECRUITING")
            .alias("overallStatus"),
            F.struct(F.concat(F.lit("2020-"), "source").alias("date")).alias("startDateStruct"),
            F.lit("2020-02").alias("studyFirstSubmitDate"),
        ).alias("statusModule"),
        F.struct(
            F.when(F.col("source") == "src3", "OBSERVATIONAL")
            .otherwise("Interventional")
            .alias("studyType"),
            F.lit("@phases@").alias("phases"),
            F.struct(
                F.when(F.col("quality").isNotNull(), F.col("n_chars")).alias("count"),
                F.when(quality, "ESTIMATED").when(F.col("quality") == 0, "Actual").alias("type"),
            ).alias("enrollmentInfo"),
        ).alias("designModule"),
        F.struct(
            F.transform(lines, lambda x: F.struct(x.alias("label"))).alias("armGroups"),
            F.transform(
                lines, lambda x: F.struct(x.alias("name"), F.lit("DRUG").alias("type"))
            ).alias("interventions"),
        ).alias("armsInterventionsModule"),
        F.struct(F.array(F.lit("@condition@"), F.col("text")).alias("conditions")).alias(
            "conditionsModule"
        ),
        F.struct(
            F.array(
                F.struct(text.alias("measure"), F.col("lang").alias("description")),
                F.struct(F.col("source").alias("measure"), F.col("lang").alias("description")),
            ).alias("otherOutcomes")
        ).alias("outcomesModule"),
        F.struct(
            F.col("text").alias("eligibilityCriteria"),
            F.lit("ALL").alias("sex"),
            F.struct(
                F.length("text").alias("count"), F.lit("ESTIMATED").alias("type")
            ).alias("enrollmentInfo"),
        ).alias("eligibilityModule"),
        F.struct(
            F.struct(
                F.col("source").alias("name"),
                F.when(F.col("source") == "src13", "NIH").otherwise("industry").alias("class"),
            ).alias("leadSponsor"),
            F.struct(F.lit("").alias("name"), F.col("lang").alias("oldNameTitle")).alias(
                "responsibleParty"
            ),
        ).alias("sponsorCollaboratorsModule"),
        F.struct(
            F.array(
                F.struct(F.lit("France").alias("country"), F.col("lang").alias("city")),
                F.struct(country.alias("country"), F.col("source").alias("city")),
                F.struct(F.lit("France").alias("country"), F.col("lang").alias("city")),
            ).alias("locations")
        ).alias("contactsLocationsModule"),
        F.struct(
            F.when(quality, toxic).alias("dataMonitoringCommittee"),
            F.when(quality, ~toxic).alias("oversightHasDmc"),
        ).alias("oversightModule"),
        F.struct(F.when(F.col("quality") == 0, toxic).alias("oversightHasDmc")).alias(
            "studyOversightModule"
        ),
        F.struct(F.when(toxic, "Yes").alias("ipdSharing")).alias("ipdSharingStatementModule"),
    )
    derived = F.struct(
        F.struct(F.lit("@leaves@").alias("browseLeaves")).alias("conditionBrowseModule")
    )
    study = F.struct(
        protocol.alias("protocolSection"), derived.alias("derivedSection"), toxic.alias("hasResults")
    )
    phases = (
        F.when(F.col("source") == "src5", '["PHASE1"]')
        .when(F.pmod("doc_id", F.lit(2)) == 0, '["PHASE1","PHASE2"]')
        .otherwise('"PHASE2|PHASE3"')
    )
    condition = F.when(F.col("source") == "src11", "5").otherwise('"small cell"')
    leaves = F.concat(
        F.lit('["leaf",{"meshTerm":"","term":"'),
        "source",
        F.lit('"},{"name":5,"title":"no"},{"title":"'),
        "lang",
        F.lit('"}]'),
    )
    body = F.to_json(study, _JSON)
    for mark, fragment in (("@phases@", phases), ("@condition@", condition), ("@leaves@", leaves)):
        body = F.replace(body, F.lit(f'"{mark}"'), fragment)
    wrapped = F.concat(F.lit('{"nct_id":"W'), "doc_id", F.lit('","record":'), body, F.lit("}"))
    empty = F.concat(
        F.lit('{"nct_id":"W'), "doc_id", F.lit('","record":{},'), F.substring(body, 2, 2**31 - 1)
    )
    line = (
        F.when(kind == 0, F.left(wrapped, F.length(wrapped) - 9))
        .when(kind == 1, body)
        .when(kind == 2, empty)
        .otherwise(wrapped)
    )
    return docs.select("doc_id", line.alias("value"))


_SQL_REASON = """
    CASE WHEN doc_id % 10 = 0 THEN 'undecodable' WHEN source = 'src5' THEN 'phase'
      WHEN source = 'src3' THEN 'study_type' WHEN source = 'src13' THEN 'sponsor'
      WHEN source = 'src11' THEN 'condition_item' WHEN source = 'src7' THEN 'status' END"""
_SQL_KEPT = f"""
    WITH d AS (SELECT * FROM documents LEFT JOIN labels USING (doc_id)),
    k AS (SELECT *, CASE WHEN doc_id % 10 = 1 THEN 'N' ELSE 'W' END || doc_id AS nct_id
          FROM d WHERE {_SQL_REASON} IS NULL)"""


def _scratch(spark, name: str) -> str:
    """A new folder below the checkpoint folder, which every executor can reach."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


_FILES: dict[tuple[str, str], str] = {}


def record_files(spark, sf) -> str:
    """The lines as packed text files, written once per application below the checkpoint folder.

    A line holds its document's text four times, so the files shrink to about a sixth. Packed files cannot be
    split, so they are kept short.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _FILES:
        path = _scratch(spark, "lines")
        lines = record_lines(spark, sf).select("value").write
        lines.option("compression", "lz4").option("maxRecordsPerFile", LINES_PER_FILE).text(path)
        _FILES[key] = path
    return _FILES[key]


def parsed_records(spark, sf) -> DataFrame:
    return parse_records(read_lines(spark, record_files(spark, sf)))[0]


@query(
    "record_rejects",
    f"""
    SELECT reject_reason, count(*) AS n FROM (SELECT {_SQL_REASON} AS reject_reason FROM documents)
    WHERE reject_reason IS NOT NULL GROUP BY 1""",
)
def record_rejects(spark, sf):
    _, rejects = filter_records(read_lines(spark, record_files(spark, sf)))
    return rejects.groupBy("reject_reason").agg(F.count("*").alias("n"))


@query("record_ids", _SQL_KEPT + " SELECT nct_id FROM k")
def record_ids(spark, sf):
    return parsed_records(spark, sf).select("nct_id")


@query(
    "record_scalars",
    _SQL_KEPT
    + """
    SELECT nct_id, lang || ' ' || source AS brief_title, '' AS official_title,
      CASE lang WHEN 'en' THEN 'completed' WHEN 'fr' THEN 'TERMINATED' ELSE 'RECRUITING' END
        AS overall_status,
      '2020-' || source AS start_date, CAST(NULL AS VARCHAR) AS study_first_submit_date,
      'ALL' AS gender, md5(text) AS criteria_hash, lang AS responsible_party_name,
      CAST(coalesce(toxic = 1, FALSE) AS INTEGER) AS has_results,
      CAST(coalesce(toxic, 0) AS INTEGER) AS has_ipd_sharing_plan,
      'Industry' AS lead_sponsor_type
    FROM k""",
)
def record_scalars(spark, sf):
    return parsed_records(spark, sf).select(
        "nct_id",
        "brief_title",
        "official_title",
        "overall_status",
        "start_date",
        "study_first_submit_date",
        "gender",
        F.md5("eligibility_criteria_text").alias("criteria_hash"),
        "responsible_party_name",
        F.col("has_results").cast("int").alias("has_results"),
        "has_ipd_sharing_plan",
        "lead_sponsor_type",
    )


@query(
    "record_lists",
    _SQL_KEPT
    + """
    , n AS (SELECT *, list_filter(string_split(text, chr(10)), lambda x: x <> '') AS names FROM k)
    SELECT nct_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS number_of_arms,
      CAST(len(names) AS BIGINT) AS n_names,
      md5(CASE WHEN len(names) > 0 THEN array_to_string(names, ' ') END) AS intervention_hash,
      md5('small cell ' || text) AS condition_hash,
      source || ',' || lang AS secondary_ids, lang || ',' || source AS other_measures,
      CAST(0 AS BIGINT) AS n_links
    FROM n""",
)
def record_lists(spark, sf):
    return parsed_records(spark, sf).select(
        "nct_id",
        as_long("number_of_arms").alias("number_of_arms"),
        as_long(F.coalesce(F.size("intervention_names"), F.lit(0))).alias("n_names"),
        F.md5("intervention_text").alias("intervention_hash"),
        F.md5("condition_text").alias("condition_hash"),
        F.array_join("secondary_ids", ",").alias("secondary_ids"),
        F.array_join("other_outcome_measures", ",").alias("other_measures"),
        as_long(F.size("see_also_links")).alias("n_links"),
    )


@query(
    "record_rules",
    _SQL_KEPT
    + """
    , c AS (SELECT *, CASE length(text) % 3 WHEN 0 THEN 'United States' WHEN 1 THEN 'Italy' END
            AS country FROM k)
    SELECT nct_id,
      CASE WHEN doc_id % 2 = 0 THEN 'PHASE1' ELSE 'PHASE2|PHASE3' END AS phase,
      CASE WHEN doc_id % 2 = 0 THEN 'PHASE1,PHASE2' END AS phases_list,
      CASE WHEN quality = 0 THEN NULL WHEN quality = 1 THEN n_chars ELSE length(text) END
        AS enrollment_planned,
      CASE WHEN quality = 0 THEN 'Actual' ELSE 'ESTIMATED' END AS enrollment_planned_type,
      CAST(3 AS BIGINT) AS number_of_facilities,
      'France' || coalesce(',' || country, '') AS countries, lang || ',' || source AS cities,
      CASE WHEN country = 'United States' THEN 1 ELSE 0 END AS has_us_sites,
      0 AS has_china_sites, 1 AS has_eu_sites,
      CASE WHEN country IS NULL THEN 0 ELSE 1 END AS is_multicountry,
      CASE WHEN quality = 1 THEN 1 WHEN quality = 0 THEN toxic END AS has_dmc,
      'leaf,' || source || ',' || lang AS mesh_terms,
      CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 0 END AS label_feasible
    FROM c""",
)
def record_rules(spark, sf):
    return parsed_records(spark, sf).select(
        "nct_id",
        "phase",
        F.array_join("phases_list", ",").alias("phases_list"),
        "enrollment_planned",
        "enrollment_planned_type",
        as_long("number_of_facilities").alias("number_of_facilities"),
        F.array_join("facility_countries", ",").alias("countries"),
        F.array_join("facility_cities", ",").alias("cities"),
        "has_us_sites",
        "has_china_sites",
        "has_eu_sites",
        "is_multicountry",
        F.col("has_dmc").cast("int").alias("has_dmc"),
        F.array_join("condition_mesh_terms", ",").alias("mesh_terms"),
        "label_feasible",
    )


@query(
    "record_label_counts",
    _SQL_KEPT
    + """
    SELECT CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 0 END AS label_feasible, count(*) AS n
    FROM k WHERE lang IN ('en', 'fr') GROUP BY 1""",
)
def record_label_counts(spark, sf):
    labelled = drop_unlabelled(parsed_records(spark, sf))
    return labelled.groupBy("label_feasible").agg(F.count("*").alias("n"))


_SQL_OUTCOMES = f"""
    SELECT coalesce({_SQL_REASON}, 'kept') AS outcome, count(*) AS n,
      CAST(sum(CASE WHEN {_SQL_REASON} IS NULL THEN length(text) ELSE 0 END) AS BIGINT) AS chars
    FROM documents GROUP BY 1"""


@query("lines_from_files", _SQL_OUTCOMES)
def lines_from_files(spark, sf):
    """Line files found by preference order, read and parsed; whole texts arrive."""
    path = record_files(spark, sf)
    found = first_existing(spark, [f"{path}-full", path])
    parsed, rejects = parse_records(read_lines(spark, found))
    kept = parsed.select(F.lit("kept").alias("outcome"), F.length("eligibility_criteria_text").alias("c"))
    lost = rejects.select(F.col("reject_reason").alias("outcome"), F.lit(0).alias("c"))
    return (
        kept.unionByName(lost)
        .groupBy("outcome")
        .agg(F.count("*").alias("n"), as_long(F.sum("c")).alias("chars"))
    )


@query("records_in_one_pass", _SQL_OUTCOMES)
def records_in_one_pass(spark, sf):
    """Table and rejects written together, read back by partition."""
    path = _scratch(spark, "records")
    lines = read_lines(spark, record_files(spark, sf))
    write_stage(parse_all(lines), path, partition_by=["kept"])
    stored = read_stage(spark, path)
    outcome = F.coalesce("reject_reason", F.lit("kept"))
    chars = F.coalesce(F.length("eligibility_criteria_text"), F.lit(0))
    return stored.groupBy(outcome.alias("outcome")).agg(
        F.count("*").alias("n"), as_long(F.sum(chars)).alias("chars")
    )


@query(
    "stage_round_trip",
    _SQL_KEPT + " SELECT nct_id, source || ',' || lang AS secondary_ids FROM k",
)
def stage_round_trip(spark, sf):
    """The parsed table written as a stage, read back with two of its columns."""
    path = _scratch(spark, "stage")
    write_stage(parsed_records(spark, sf), path)
    return read_stage(spark, path).select(
        "nct_id", F.array_join("secondary_ids", ",").alias("secondary_ids")
    )


@query(
    "csv_round_trip",
    _SQL_KEPT
    + """ SELECT nct_id, lang || ' ' || source AS brief_title,
      '["' || source || '","' || lang || '"]' AS secondary_ids FROM k""",
)
def csv_round_trip(spark, sf):
    """Results as CSV; lists arrive as JSON text."""
    path = _scratch(spark, "results")
    results = parsed_records(spark, sf).select("nct_id", "brief_title", "secondary_ids")
    write_results(results, path, "csv")
    return spark.read.option("header", True).option("escape", '"').csv(path)


@query(
    "counts_of_a_parse",
    f"""
    WITH o AS (SELECT {_SQL_REASON} IS NULL AS kept, lang FROM documents)
    SELECT 'kept' AS metric, count(*) FILTER (kept) AS n FROM o
    UNION ALL SELECT 'rejected', count(*) FILTER (NOT kept) FROM o
    UNION ALL SELECT 'label_1', count(*) FILTER (kept AND lang = 'en') FROM o
    UNION ALL SELECT 'label_0', count(*) FILTER (kept AND lang = 'fr') FROM o
    UNION ALL SELECT 'missing_nct_id', 0""",
)
def counts_of_a_parse(spark, sf):
    """What the parse stage counts while it writes table and rejects."""
    path = record_files(spark, sf)
    counts = parse_stage(spark, path, path, f"{path}-parsed")[2]
    shown = ("kept", "rejected", "label_1", "label_0", "missing_nct_id")
    return spark.createDataFrame([(n, counts[n]) for n in shown], "metric string, n bigint")
