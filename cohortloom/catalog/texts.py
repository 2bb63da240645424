"""Text flags, metrics, joins and display helpers on documents, parts and customers."""

from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.catalog.registry import as_long, query, table
from cohortloom.functions import text as t
from cohortloom.functions.nested import join_words
from cohortloom.operators import flags, vectors
from cohortloom.operators.columns import group_counts

WORD_MAP = {
    "is_licensed": ["MIT License", "copyright", "all rights"],
    "is_english": [" the ", " and ", " that "],
    "is_french": [" les ", " que ", " des "],
    "is_all": ["all"],
}
GENERAL_WORDS = ["tion", "with"]
MARKERS = ("that", "with")


def sql_match(haystack: str, words) -> str:
    tests = " OR ".join("contains({}, '{}')".format(haystack, w.lower().replace("'", "''")) for w in words)
    return f"({tests})"


def sql_flag(haystack: str, words) -> str:
    return f"CAST(CASE WHEN {sql_match(haystack, words)} THEN 1 ELSE 0 END AS BIGINT)"


def sql_flag_query(keyword_map, general_terms, general: str, catch_all: str) -> str:
    low = "lower(coalesce(text, ''))"
    parts = ", ".join(f"{sql_flag(low, words)} AS {name}" for name, words in keyword_map.items())
    total = " + ".join(keyword_map)
    return f"""
    WITH f AS (SELECT doc_id, {parts}, {sql_flag(low, general_terms)} AS g FROM documents),
    o AS (SELECT *, CAST(CASE WHEN g = 1 AND {total} = 0 THEN 1 ELSE 0 END AS BIGINT) AS {general} FROM f)
    SELECT * EXCLUDE (g), CAST(CASE WHEN {total} + {general} = 0 THEN 1 ELSE 0 END AS BIGINT) AS {catch_all}
    FROM o"""


def longs(df, *keep):
    return df.select(*keep, *[as_long(c).alias(c) for c in df.columns if c not in keep])


@query(
    "keyword_flags",
    "SELECT doc_id, "
    + ", ".join(
        f"{sql_flag('lower(text)', words)} AS {name}" for name, words in WORD_MAP.items()
    )
    + " FROM documents",
)
def keyword_flags(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return longs(flags.add_keyword_flags(docs, F.col("text"), WORD_MAP).drop("text"), "doc_id")


@query(
    "single_keyword_flag",
    f"SELECT page_id, {sql_flag('lower(html)', ['<SCRIPT', 'noscript'])} AS scripted FROM pages",
)
def single_keyword_flag(spark, sf):
    pages = table(spark, sf, "pages")
    return pages.select(
        "page_id", as_long(t.keyword_flag(F.col("html"), ["<SCRIPT", "noscript"])).alias("scripted")
    )


@query(
    "general_and_catch_all_flags",
    sql_flag_query(WORD_MAP, GENERAL_WORDS, "is_other_text", "is_other"),
)
def general_and_catch_all_flags(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    flagged = flags.add_disease_flags(
        docs, "text", WORD_MAP, GENERAL_WORDS, general="is_other_text"
    )
    return longs(flagged.drop("text"), "doc_id")


@query(
    "disease_flags",
    sql_flag_query(fv.DISEASE_KEYWORDS, fv.GENERAL_CANCER_TERMS, "is_other_cancer", "is_other"),
)
def disease_flags(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("condition_text"))
    return longs(flags.add_disease_flags(docs).drop("condition_text"), "doc_id")


_TREATMENT_WORDS = {**fv.INTERVENTION_KEYWORDS, "is_named": ["src1", "the", "license"]}
_TREATMENT_TEXT = "lower(lang || ' ' || source || ' ' || text || ' ' || source)"


@query(
    "intervention_flags",
    "SELECT doc_id, "
    + ", ".join(
        f"{sql_flag(_TREATMENT_TEXT, words)} AS {name}" for name, words in _TREATMENT_WORDS.items()
    )
    + " FROM documents",
)
def intervention_flags(spark, sf):
    listed = F.array(
        F.struct(
            F.col("text").alias("name"),
            F.col("source").alias("type"),
            F.lit(None).cast("string").alias("description"),
        )
    )
    docs = table(spark, sf, "documents").select(
        "doc_id",
        F.concat_ws(" ", "lang", "source").alias("intervention_text"),
        listed.alias("interventions"),
    )
    flagged = flags.add_intervention_flags(docs, _TREATMENT_WORDS)
    return longs(flagged.drop("intervention_text", "interventions"), "doc_id")


def _sql_section(marker: str) -> str:
    """Section of a marker: position by strpos, end at the nearest later marker."""
    start = f"strpos(low, '{marker}')"
    rest = f"substr(low, {start} + {len(marker)})"
    nexts = ", ".join(
        f"CASE WHEN strpos({rest}, '{m}') > 0 THEN strpos({rest}, '{m}') END" for m in MARKERS
    )
    tail = f"length({rest}) - CASE WHEN ends_with({rest}, chr(10)) THEN 1 ELSE 0 END"
    size = f"{len(marker)} + coalesce(least({nexts}) - 1, {tail})"
    return f"CASE WHEN {start} = 0 THEN '' ELSE substr(text, {start}, {size}) END"


_SQL_METRICS = ", ".join(
    ["CAST(length(text) AS BIGINT) AS doc_text_len"]
    + [
        f"CAST((length(low) - length(replace(low, '{m}', ''))) / {len(m)} AS BIGINT) AS num_{m}_criteria, "
        f"CAST(length(s_{m}) AS BIGINT) AS {m}_text_len, "
        f"CAST(length(s_{m}) - length(translate(s_{m}, '•-*', '')) AS BIGINT) AS num_{m}_items"
        for m in MARKERS
    ]
)


@query(
    "text_metrics",
    f"""
    WITH l AS (SELECT doc_id, text, lower(text) AS low FROM documents),
    s AS (SELECT *, {", ".join(f"{_sql_section(m)} AS s_{m}" for m in MARKERS)} FROM l)
    SELECT doc_id, {_SQL_METRICS} FROM s""",
)
def text_metrics(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    measured = flags.add_text_metrics(docs, "text", MARKERS, prefix="doc")
    return longs(measured.drop("text"), "doc_id")


@query(
    "section_text",
    f"""
    WITH l AS (SELECT doc_id, text, lower(text) AS low FROM documents)
    SELECT doc_id, md5({_sql_section("that")}) AS section_hash FROM l""",
)
def section_text(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id", F.md5(t.section(F.col("text"), "that", MARKERS)).alias("section_hash")
    )


@query(
    "joined_descriptions",
    """
    WITH p AS (
      SELECT doc_id, lang AS a, CASE WHEN n_chars > 1000 THEN text END AS b,
             CASE WHEN lang = 'en' THEN '' ELSE source END AS c FROM documents)
    SELECT doc_id,
      md5(concat_ws(' ', nullif(a, ''), nullif(b, ''), nullif(c, ''))) AS non_empty_hash,
      md5(coalesce(a, '') || ' ' || coalesce(b, '') || ' ' || coalesce(c, '')) AS all_hash
    FROM p""",
)
def joined_descriptions(spark, sf):
    parts = table(spark, sf, "documents").select(
        "doc_id",
        F.col("lang").alias("a"),
        F.when(F.col("n_chars") > 1000, F.col("text")).alias("b"),
        F.when(F.col("lang") == "en", "").otherwise(F.col("source")).alias("c"),
    )
    cols = [F.col(c) for c in "abc"]
    return parts.select(
        "doc_id",
        F.md5(t.joined_non_empty(*cols)).alias("non_empty_hash"),
        F.md5(t.joined_all(*cols)).alias("all_hash"),
    )


@query(
    "joined_lists",
    """
    SELECT doc_id, md5(array_to_string(string_split(text, chr(10)), ' ')) AS words_hash
    FROM documents""",
)
def joined_lists(spark, sf):
    lines = F.split("text", "\n")
    return table(spark, sf, "documents").select("doc_id", F.md5(join_words(lines)).alias("words_hash"))


@query(
    "display_names",
    """
    SELECT p_partkey,
      array_to_string(list_transform(string_split(p_type || '_' || replace(p_name, ' ', '_'), '_'),
        lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS shown
    FROM part""",
)
def display_names(spark, sf):
    name = F.concat("p_type", F.lit("_"), F.replace("p_name", F.lit(" "), F.lit("_")))
    return table(spark, sf, "part").select("p_partkey", t.display_name(name).alias("shown"))


@query(
    "shortened_names",
    """
    SELECT c_custkey,
      CASE WHEN length(n) > 20 THEN left(n, 20) || '...' ELSE n END AS shown
    FROM (SELECT c_custkey, c_name || ' ' || c_mktsegment AS n FROM customer)""",
)
def shortened_names(spark, sf):
    name = F.concat_ws(" ", "c_name", "c_mktsegment")
    return table(spark, sf, "customer").select("c_custkey", t.shorten(name, 20, "...").alias("shown"))


def _make_counter():
    """Encoder for the batch inference query: characters, words and vowels of a text."""
    import numpy as np

    def encode(texts):
        return np.array(
            [[len(x), len(x.split(" ")), sum(x.count(v) for v in "aeiou")] for x in texts]
        )

    return encode


@query(
    "batched_embedding",
    """
    SELECT doc_id, CAST(length(t) AS BIGINT) AS chars,
      CAST(length(t) - length(replace(t, ' ', '')) + 1 AS BIGINT) AS words,
      CAST(length(t) - length(translate(t, 'aeiou', '')) AS BIGINT) AS vowels
    FROM (SELECT doc_id, CASE WHEN lang <> 'es' THEN text END AS t FROM documents)""",
)
def batched_embedding(spark, sf):
    docs = table(spark, sf, "documents").select(
        "doc_id", F.when(F.col("lang") != "es", F.col("text")).alias("text")
    )
    vector = vectors.embed(docs, "text", _make_counter)
    names = ["chars", "words", "vowels"]
    return vector.select(
        "doc_id", *[as_long(F.get("embedding", F.lit(i))).alias(n) for i, n in enumerate(names)]
    )


@query("hashed_term_vectors")
def hashed_term_vectors(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = vectors.fit_text_vectors(docs, "text", 64)
    norm = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)
    return vectors.text_vectors(docs, "text", model).select(
        "doc_id", F.size("embedding").alias("size"), F.round(F.sqrt(norm), 3).alias("norm")
    )


@query(
    "feature_group_totals",
    f"""
    WITH f AS ({sql_flag_query(fv.DISEASE_KEYWORDS, fv.GENERAL_CANCER_TERMS, "is_other_cancer", "is_other")})
    SELECT 'disease' AS feature_group, CAST(9 AS BIGINT) AS columns,
      CAST(sum(is_nsclc + is_sclc + is_breast_cancer + is_prostate_cancer + is_colorectal_cancer
        + is_gastric_cancer + is_pancreatic_cancer + is_other_cancer + is_other) AS BIGINT) AS flagged
    FROM f""",
)
def feature_group_totals(spark, sf):
    from cohortloom.operators.columns import feature_groups

    flagged = disease_flags(spark, sf)
    groups = {"disease": (fv.FLAG_PREFIX, fv.DISEASE_GROUP)}
    names = feature_groups(flagged.columns, groups)["disease"]
    columns = group_counts(flagged, "doc_id", groups=groups)["disease"]
    total = sum((F.col(n) for n in names), F.lit(0))
    return flagged.agg(as_long(F.sum(total)).alias("flagged")).select(
        F.lit("disease").alias("feature_group"), F.lit(columns).cast("bigint").alias("columns"), "flagged"
    )
