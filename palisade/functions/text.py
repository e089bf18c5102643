"""Text normalisation, tokens and token windows as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that are removed; white space as Python's str.split() and \s know it.
INVISIBLE = "[\\u200B-\\u200D\\u00AD\\uFEFF]"
WHITE = "\\t-\\r\\x1c-\\x1f \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
REGEX_PREFIX, LOG_CHARS, PREVIEW_CHARS = 512, 100, 80
WINDOW_MIN, WINDOW_MAX = 2, 4


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends: the tokens of c joined by spaces."""
    return F.trim(F.regexp_replace(c, f"[{WHITE}]+", " "))


def normalize(c: Column) -> Column:
    """c without invisible characters, its white space squeezed. Null of null."""
    return squeeze(F.regexp_replace(c, INVISIBLE, ""))


def tokens(c: Column) -> Column:
    """The white-space tokens of c, none empty."""
    return F.filter(F.split(squeeze(c), " "), lambda t: t != "")


def bind(value: Column, body) -> Column:
    """body(value), with value evaluated once a row however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _windows_of(t: Column, low: int, high: int) -> Column:
    def of_length(k: int) -> Column:
        starts = F.when(F.size(t) >= k, F.sequence(F.lit(1), F.size(t) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(t, i, k), " "))

    return F.concat(*(of_length(k) for k in range(low, high + 1)))


def windows(c: Column, low: int = WINDOW_MIN, high: int = WINDOW_MAX) -> Column:
    """All runs of low to high tokens of c, joined by spaces."""
    return bind(tokens(c), lambda t: _windows_of(t, low, high))


def regex_prefix(c: Column) -> Column:
    """The part of a text that anchored rules look at."""
    return F.substring(c, 1, REGEX_PREFIX)


def preview(c: Column) -> Column:
    return F.when(F.length(c) > PREVIEW_CHARS, F.concat(F.substring(c, 1, PREVIEW_CHARS), F.lit("..."))).otherwise(c)


def python_bool(c: Column) -> Column:
    return F.initcap(c.cast("string"))
