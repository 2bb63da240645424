"""Keyword flags and text metrics as feature columns of a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.functions import text as t
from cohortloom.functions.nested import flag


def add_keyword_flags(
    df: DataFrame, haystack: Column, keyword_map: Mapping[str, Sequence[str]]
) -> DataFrame:
    """One 0/1 column per entry of the map; the text is lower-cased once per row.

    Parts that several keywords share are looked up first; keywords are only looked for in
    texts that hold their part, so most texts cost one search per part.
    """
    lowered = df.withColumn("_lowered", F.lower(haystack))
    groups = t.shared_parts([k for words in keyword_map.values() for k in words])
    parts = {part: f"_part{i}" for i, part in enumerate(groups)}
    held = lowered.select("*", *[t.keyword_match(F.col("_lowered"), [p]).alias(n) for p, n in parts.items()])
    part_of = {keyword: part for part, members in groups.items() for keyword in members}

    def matched(words: Sequence[str]) -> Column:
        found = F.lit(False)
        for keyword in dict.fromkeys(k.lower() for k in words):
            part = part_of[keyword]
            hit = F.col(parts[part])
            if keyword != part:
                hit = hit & t.keyword_match(F.col("_lowered"), [keyword])
            found = found | hit
        return found

    flags = [flag(matched(words)).alias(name) for name, words in keyword_map.items()]
    return held.select(*df.columns, *flags)


def _flag_sum(cols: Sequence[str]) -> Column:
    total = F.lit(0)
    for c in cols:
        total = total + F.coalesce(F.col(c).cast("int"), F.lit(0))
    return total


def add_disease_flags(
    df: DataFrame,
    text_col: str = "condition_text",
    keyword_map: Mapping[str, Sequence[str]] = fv.DISEASE_KEYWORDS,
    general_terms: Sequence[str] = tuple(fv.GENERAL_CANCER_TERMS),
    scope: Sequence[str] | None = None,
    general: str = "is_other_cancer",
    catch_all: str = "is_other",
) -> DataFrame:
    """Specific flags, then the general flag, then the catch-all.

    The general flag needs a general term and no flag set; the catch-all needs no
    flag at all. By default every ``is_*`` column of the result counts as a flag,
    also those that were there before; ``scope`` limits the sums to named columns.
    """
    text = F.col(text_col) if text_col in df.columns else F.lit("")
    # the general term is matched in the same pass as the specific flags
    marked = add_keyword_flags(df, text, {**keyword_map, "_general": general_terms})
    if scope is None:
        specific = [c for c in marked.columns if c.startswith(fv.FLAG_PREFIX)]
    else:
        specific = list(scope)
    with_general = marked.withColumn(
        general, flag((F.col("_general") == 1) & (_flag_sum(specific) == 0))
    ).drop("_general")
    counted = [c for c in specific + [general] if c not in fv.CATCH_ALL_IGNORED]
    return with_general.withColumn(catch_all, flag(_flag_sum(counted) == 0))


def intervention_haystack(
    keywords: Sequence[str], text_col: str = "intervention_text", nested: str = "interventions"
) -> Column:
    """Intervention names followed by the interventions as JSON text.

    In the JSON, characters beyond ASCII count as escapes; they are only written out
    in the rare texts where that can decide about a keyword.
    """
    as_json = F.to_json(F.col(nested), {"ignoreNullFields": "false"})
    matters = as_json.rlike(t.escape_pattern(keywords))
    return t.joined_all(F.col(text_col), F.when(matters, t.ascii_escaped(as_json)).otherwise(as_json))


def add_intervention_flags(
    df: DataFrame, keyword_map: Mapping[str, Sequence[str]] = fv.INTERVENTION_KEYWORDS
) -> DataFrame:
    keywords = [k for words in keyword_map.values() for k in words]
    return add_keyword_flags(df, intervention_haystack(keywords), keyword_map)


def add_text_metrics(
    df: DataFrame,
    text_col: str = "eligibility_criteria_text",
    markers: Sequence[str] = (fv.INCLUSION_MARKER, fv.EXCLUSION_MARKER),
    bullets: str = fv.BULLET_CHARACTERS,
    prefix: str = "eligibility",
) -> DataFrame:
    """Length, marker counts, section lengths and bullets per section.

    A section runs from its first marker to the next marker of any kind.
    """
    text = F.col(text_col)
    sectioned = df.select(
        "*", *[t.section(text, m, sorted(markers)).alias(f"_section_{m}") for m in markers]
    )
    metrics = [t.text_length(text).alias(f"{prefix}_text_len")]
    metrics += [t.occurrences(text, m).alias(f"num_{m}_criteria") for m in markers]
    metrics += [F.length(f"_section_{m}").alias(f"{m}_text_len") for m in markers]
    metrics += [t.bullet_count(F.col(f"_section_{m}"), bullets).alias(f"num_{m}_items") for m in markers]
    return sectioned.select(*df.columns, *metrics)
