"""Column builders over nested record fields."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv


def non_empty(text: Column) -> Column:
    """Text, or null when it is the empty string."""
    return F.nullif(text, F.lit(""))


def first_truthy(*texts: Column) -> Column:
    """First text that is neither null nor empty."""
    return F.coalesce(*[non_empty(t) for t in texts])


def first_true(first: Column, second: Column) -> Column:
    """``first`` when it is true, else ``second`` as it is (a false ``first`` is skipped)."""
    return F.when(first, F.lit(True)).otherwise(second)


def kept_structs(array: Column) -> Column:
    """Struct elements that are present; null when none is left."""
    return null_if_empty(F.filter(array, lambda x: x.isNotNull()))


def null_if_empty(array: Column) -> Column:
    return F.when(F.size(array) > 0, array)


def pluck(array: Column, *fields: str) -> Column:
    """Non-empty values of ``fields`` (first truthy wins) over an array of structs."""
    values = F.transform(array, lambda x: first_truthy(*[x[f] for f in fields]))
    return null_if_empty(F.filter(values, lambda v: v.isNotNull()))


def cardinality(array: Column) -> Column:
    """Array length, 0 when the array is absent."""
    return F.coalesce(F.size(array), F.lit(0)).cast("int")


def distinct_values(array: Column, field: str) -> Column:
    """Distinct non-empty values of one field in first-seen order; null when none."""
    values = F.filter(F.transform(array, lambda x: non_empty(x[field])), lambda v: v.isNotNull())
    return null_if_empty(F.array_distinct(values))


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (null counts as not holding)."""
    return F.when(condition, 1).otherwise(0).cast("int")


def contains_any(array: Column, values: Sequence[str]) -> Column:
    return flag(F.arrays_overlap(array, F.array(*[F.lit(v) for v in values])))


def join_words(array: Column) -> Column:
    """Elements joined by one space; null for an empty or absent array."""
    return F.when(F.size(array) > 0, F.array_join(array, " "))


def first_element(array: Column) -> Column:
    return F.get(array, F.lit(0))


def yes_flag(text: Column) -> Column:
    return flag(F.upper(text) == "YES")


def mask_when(value: Column, condition: Column) -> Column:
    """``value``, hidden where ``condition`` holds (a null condition does not hide)."""
    return F.when(~F.coalesce(condition, F.lit(False)), value)


def label_from_status(
    status: Column,
    positive: Sequence[str] = tuple(fv.POSITIVE_STATUSES),
    negative: Sequence[str] = tuple(fv.NEGATIVE_STATUSES),
) -> Column:
    """1 for a positive status, 0 for a negative one, null otherwise; case-insensitive."""
    upper = F.upper(status)
    return F.when(upper.isin(*positive), 1).when(upper.isin(*negative), 0).cast("int")


def ontology_terms(leaves: Column, keys: Sequence[str] = tuple(fv.ONTOLOGY_KEYS)) -> Column:
    """Terms of an array of variants whose leaves are strings or objects.

    A string leaf is its own term. For an object the first key holding something
    other than null, "", 0, false or an empty collection decides; it counts only
    when it is a string.
    """

    def string_or_null(value: Column) -> Column:
        is_text = F.schema_of_variant(value) == "STRING"
        return F.when(is_text, F.try_variant_get(value, "$", "string"))

    def truthy(value: Column) -> Column:
        text = F.try_variant_get(value, "$", "string")
        return text.isNotNull() & ~text.isin("", "0", "0.0", "false", "[]", "{}")

    def term(leaf: Column) -> Column:
        found = [F.try_variant_get(leaf, f"$.{k}", "variant") for k in keys]
        chosen = F.when(truthy(found[0]), string_or_null(found[0]))
        for value in found[1:]:
            chosen = chosen.when(truthy(value), string_or_null(value))
        kind = F.schema_of_variant(leaf)
        return F.when(kind == "STRING", F.try_variant_get(leaf, "$", "string")).when(
            kind.startswith("OBJECT"), chosen
        )

    return null_if_empty(F.filter(F.transform(leaves, term), lambda t: t.isNotNull()))
