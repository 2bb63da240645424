"""Text expressions: keyword flags, sections, counts and display helpers."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from cohortloom import fixed_values as fv
from cohortloom.functions.nested import flag, non_empty


def keyword_match(lowered: Column, keywords: Sequence[str]) -> Column:
    """True where the already lower-cased text contains any keyword."""
    matched = F.lit(False)
    for keyword in keywords:
        matched = matched | F.contains(lowered, F.lit(keyword.lower()))
    return matched


def shared_parts(keywords: Sequence[str], least: int = 5) -> dict[str, list[str]]:
    """Keywords by a part that all of a group hold; a keyword without such company stands for itself.

    A text without the part has none of the group. Greedy: the part of at least ``least`` characters that
    most keywords left hold, the longest of equals.
    """
    left, groups = sorted({k.lower() for k in keywords}), {}
    while left:
        holders: dict[str, list[str]] = {}
        for keyword in left:
            ends = range(len(keyword) + 1)
            for part in {keyword[a:b] for a in ends for b in ends if b - a >= least}:
                holders.setdefault(part, []).append(keyword)
        best = max(holders, key=lambda part: (len(holders[part]), len(part), part), default=None)
        if best is None or len(holders[best]) < 2:
            break
        groups[best] = holders[best]
        left = [k for k in left if k not in groups[best]]
    return {**groups, **{k: [k] for k in left}}


def keyword_flag(text: Column, keywords: Sequence[str]) -> Column:
    """1 when any keyword occurs in the text, ignoring case; null text gives 0."""
    return flag(keyword_match(F.lower(text), keywords))


def text_length(text: Column) -> Column:
    return F.length(F.coalesce(text, F.lit(""))).cast("int")


def occurrences(text: Column, word: str) -> Column:
    """Number of non-overlapping, case-insensitive occurrences of a literal word."""
    pattern = "(?iu)" + re.escape(word)
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(pattern)).cast("int")


def section(text: Column, marker: str, stops: Sequence[str]) -> Column:
    """Text from the first ``marker`` up to the next stop word or the end; '' if none.

    Flags: case-insensitive with Unicode folding, dot matches newlines, and Unix
    line ends, so that the end anchor only tolerates one final newline.
    """
    ends = "|".join([re.escape(s) for s in stops] + ["$"])
    pattern = f"(?iusd){re.escape(marker)}.*?(?={ends})"
    return F.regexp_extract(F.coalesce(text, F.lit("")), pattern, 0)


def bullet_count(text: Column, bullets: str = fv.BULLET_CHARACTERS) -> Column:
    """Number of bullet characters: what the text loses when they are removed."""
    kept = F.translate(text, bullets, "")
    return (F.length(text) - F.length(kept)).cast("int")


def joined_non_empty(*parts: Column) -> Column:
    """Non-empty parts joined by one space; '' when there is none."""
    return F.concat_ws(" ", *[non_empty(p) for p in parts])


def joined_all(*parts: Column) -> Column:
    """All parts joined by one space, a missing part being ''; never null."""
    return F.array_join(F.array(*parts), " ", "")


def escape_pattern(keywords: Sequence[str]) -> str:
    r"""Pattern of the rare texts in which a ``\uXXXX`` escape can complete a keyword.

    A keyword may begin with the last hex digits of an escape ("pharma\u00adceutical"
    holds "adc") or, if it is all hex digits, lie inside one. The pattern looks at the
    raw text: a character with such a code, followed by the rest of the keyword.
    """

    plane = [n for n in range(0x7F, 0x10000) if not 0xD800 <= n < 0xE000]

    def one_of(test) -> str:
        codes = "".join(f"\\u{n:04x}" for n in plane if test(f"{n:04x}"))
        return f"[{codes}]"

    # the cheap literal comes first; the character before it is only checked after a hit
    endings, after_pairs = set(), set()
    for keyword in (k.lower() for k in keywords):
        digits = len(re.match("[0-9a-f]*", keyword).group(0))
        for n in range(1, min(digits, 4) + 1):
            head, rest = keyword[:n], re.escape(keyword[n:])
            after_pairs.add(rest)
            if n == 1:
                endings.add(rest)
            elif rest:
                before = one_of(lambda code, head=head: code.endswith(head))
                endings.add(f"{rest}(?<={before}{rest})")
            else:
                endings.add(f"(?<={one_of(lambda code, head=head: head in code)})")
    if not endings:
        return "(?!)"
    single, paired = ("|".join(sorted(x, key=len)) for x in (endings, after_pairs))
    return rf"[^\x00-\x7E](?i:{single})|[\x{{10000}}-\x{{10FFFF}}](?i:{paired})"


def ascii_escaped(text: Column) -> Column:
    r"""Characters beyond ASCII as ``\uXXXX`` in lower-case hex, pairs beyond the basic plane."""

    def unit(number: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(number)), 4, "0"))

    def escaped(character: Column) -> Column:
        number = F.ascii(character)
        above = number - 0x10000
        pair = F.concat(
            unit(F.shiftright(above, 10) + 0xD800), unit(above.bitwiseAND(F.lit(0x3FF)) + 0xDC00)
        )
        return F.when(number < 127, character).when(number < 0x10000, unit(number)).otherwise(pair)

    return F.array_join(F.transform(F.split(text, ""), escaped), "")


def display_name(name: Column) -> Column:
    """Underscores to spaces, then every run of letters in title case."""
    spaced = F.replace(name, F.lit("_"), F.lit(" "))
    runs = F.regexp_extract_all(spaced, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(runs, F.initcap), "")


def shorten(text: Column, width: int = 30, suffix: str = "") -> Column:
    """The first ``width`` characters, with ``suffix`` where something was cut off."""
    cut = F.concat(F.left(text, F.lit(width)), F.lit(suffix))
    return F.when(F.length(text) > width, cut).otherwise(text)
