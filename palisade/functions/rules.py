"""Anchored regular-expression rules: an ordered list, each rule tried only where its category has an anchor word."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import ALWAYS_TRIED, ANCHORS, FIELD_RULES, RULES
from .text import LOG_CHARS, regex_prefix

NO_MATCH = {"matched": False, "pattern_name": "", "matched_text": "", "category": ""}
MATCH_TYPE = "struct<matched:boolean,pattern_name:string,matched_text:string,category:string>"


def java(pattern: str, flags: str = "") -> str:
    """A pattern of Python's re for Java: \\s has U+001C to U+001F too, classes are Unicode, the dot stops at \\n only."""
    return f"(?dU{flags}{'u' if 'i' in flags else ''})" + pattern.replace(r"\s", r"[\s\x1c-\x1f]")


def re2(pattern: str, flags: str = "") -> str:
    """The same for RE2, as far as it goes: word characters by general category."""
    out = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", pattern).replace(r"(\w\s)", r"([\p{L}\p{N}_]\s)").replace(r"\/", "/")
    return f"(?{flags})" * bool(flags) + out


def gates(prefix: Column) -> Column:
    """struct<category: boolean>: which categories have an anchor in the text, any case."""
    low = F.lower(prefix)

    def gate(words: list[str]) -> Column:
        return low.rlike("|".join(re.sub(r"([^\w ])", r"\\\1", w) for w in words))

    return F.struct(*((F.lit(True) if c == ALWAYS_TRIED else gate(words)).alias(c) for c, words in ANCHORS.items()))


def _match(prefix: Column, name: str, category: str, pattern: str) -> Column:
    text = F.substring(F.regexp_extract(prefix, pattern, 0), 1, LOG_CHARS)
    return F.struct(F.lit(True).alias("matched"), F.lit(name).alias("pattern_name"), text.alias("matched_text"), F.lit(category).alias("category"))


def no_match() -> Column:
    return F.struct(*(F.lit(v).alias(k) for k, v in NO_MATCH.items()))


def first_match(prefix: Column, gate: Column) -> Column:
    """The first rule that matches. prefix and gate should be columns already (regex_prefix(), gates())."""
    found = [F.when(gate[c] & prefix.rlike(java(p, f)), _match(prefix, n, c, java(p, f))) for n, c, f, p in RULES]
    return F.coalesce(*found, no_match())


def first_name(prefix: Column, gate: Column) -> Column:
    """Name of the first rule that matches, or null; no text is extracted."""
    return F.coalesce(*(F.when(gate[c] & prefix.rlike(java(p, f)), F.lit(n)) for n, c, f, p in RULES))


def all_matches(prefix: Column, gate: Column) -> Column:
    """array of the matches of all rules, in order."""
    found = [F.when(gate[c] & prefix.rlike(java(p, f)), _match(prefix, n, c, java(p, f))) for n, c, f, p in RULES]
    return F.filter(F.array(*found), lambda m: m.isNotNull())


def categories(prefix: Column) -> Column:
    """Sorted names of the categories that would be tried."""
    g = gates(prefix)
    return F.array_sort(F.array_compact(F.array(*(F.when(g[c], F.lit(c)) for c in ANCHORS))))


def category_of(name: Column) -> Column:
    """Category of a rule name."""
    return F.element_at(F.create_map(*(F.lit(x) for n, c, _, _ in RULES for x in (n, c))), name)


def field_match(text: Column) -> Column:
    """Name of the first field rule that matches, or null; no anchors, no prefix."""
    return F.coalesce(*(F.when(text.rlike(java(p, "i")), F.lit(n)) for n, _, p in FIELD_RULES))


def field_category(name: Column) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for n, c, _ in FIELD_RULES for x in (n, c))), name)


def check(c: Column) -> Column:
    """first_match() of a text column. Used more than once on a row, prefer the two-step form over columns."""
    return first_match(regex_prefix(c), gates(regex_prefix(c)))
