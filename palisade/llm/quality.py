"""Quality rules as a short-circuit cascade.

Every rule is a test of one text with a cost and a rejection rate. Both are estimated on a bounded sample of the texts that
the cascade is for: the rule that rejects most per cost comes first, the next is chosen by its rejections among the texts
that those before it let through, at its cost with the counts at hand that those have made, and so on. A document's cascade
ends with the first rule that rejects it. The order changes the work, never the verdict: a document is kept if no rule
rejects it.

Nulls: a null text is an empty one (no words, so the base rule on word count rejects it). Repeated rows are rows of their own
and share their verdict; an empty table gives no rows; of extra columns, filter_quality() returns all as they are and
quality_report() none. Rules of equal worth run in order of their names.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from functools import cached_property

from pyspark.sql import DataFrame

from .common import filter_texts, map_texts

#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Documents in the sample that orders the rules.
SAMPLE_ROWS = 400


class Features:
    """Counts of one text; each is made when first asked for, and kept."""

    def __init__(self, text: str | None):
        self.text = text or ""

    @cached_property
    def words(self) -> list[bytes]:
        """Words [^\\x20\\x09-\\x0D]+ in UTF-8 (splitting bytes is splitting at ASCII white space)."""
        return self.text.encode().split()

    @cached_property
    def word_chars(self) -> int:
        return len(self.text) - sum(map(self.text.count, " \t\n\v\f\r"))

    @cached_property
    def n_symbols(self) -> int:
        return sum(map(self.text.count, SYMBOLS))

    @cached_property
    def n_lines(self) -> int:
        return self.text.count("\n") + 1

    @cached_property
    def n_dup_lines(self) -> int:
        lines = [x for x in self.text.split("\n") if x.strip(" \t\v\f\r")]
        return len(lines) - len(set(lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words in 3-word windows that are found twice or more."""
        w = self.words
        windows = list(zip(w, w[1:], w[2:], strict=False))
        seen: set = set()
        again = {x for x in windows if x in seen or seen.add(x)}
        if not again:
            return 0
        total, until = 0, 0
        for i, x in enumerate(windows):
            if x in again:
                total += i + 3 - max(i, until)
                until = i + 3
        return total


#: A rule rejects the text for which it is true.
Rule = Callable[[Features], bool]
BASE_RULES: dict[str, Rule] = {
    "few_words": lambda f: len(f.words) < MIN_WORDS,
    "repeats": lambda f: 100 * f.n_repeat_words > MAX_REPEAT_PERCENT * len(f.words),
}
MORE_RULES: dict[str, Rule] = {
    "symbols": lambda f: 10 * f.n_symbols > 4 * len(f.words),
    "duplicate_lines": lambda f: 2 * f.n_dup_lines > f.n_lines,
    "word_length": lambda f: not 2 * len(f.words) <= f.word_chars <= 15 * len(f.words),
}


def order_rules(sample: Iterable[Features], rules: dict[str, Rule], clock: Callable[[], float] = time.perf_counter) -> list[str]:
    """Rule names in the order in which they reject most per cost, each measured on what the rules before it let through."""
    left, order, rest = list(sample), [], dict(rules)
    while rest:
        worth = {}
        for name, rule in rest.items():
            fresh = [_copy(f) for f in left]
            began = clock()
            rejected = sum(bool(rule(f)) for f in fresh)
            cost = (clock() - began) / max(1, len(left))
            worth[name] = rejected / max(1, len(left)) / max(cost, 1e-9), -cost
        best = min(rest, key=lambda n: (-worth[n][0], -worth[n][1], n))
        order.append(best)
        rule = rest.pop(best)
        left = [f for f in left if not rule(f)]  # keeps the counts that the rule has made
    return order


def _copy(f: Features) -> Features:
    """f with the counts that it has already, so that what a rule adds to them leaves f alone."""
    other = Features(f.text)
    other.__dict__.update(f.__dict__)
    return other


def sample_texts(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str | None]:
    """At most rows texts, every tenth or so from the head of the table; only costs and rejection rates are estimated on them."""
    return [r[0] for r in docs.select("text").sample(0.1, seed=11).limit(rows).collect()]


def passes(order: list[str], rules: dict[str, Rule]) -> Callable[[Features], bool]:
    """The cascade: whether no rule rejects a text; no rule runs after one that rejects."""
    tests = [rules[n] for n in order]

    def cascade(f: Features) -> bool:
        for test in tests:
            if test(f):
                return False
        return True

    return cascade


def filter_quality(docs: DataFrame, rules: dict[str, Rule] | None = None) -> DataFrame:
    """The documents that no rule rejects, with all their columns."""
    rules = rules or {**BASE_RULES, **MORE_RULES}
    keep = passes(order_rules(map(Features, sample_texts(docs)), rules), rules)
    return filter_texts(docs, "text", lambda text: keep(Features(text)))


def counted(text: str | None) -> Features:
    """Features with the base counts made, as the report has them made for every text."""
    f = Features(text)
    f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words  # noqa: B018
    return f


def base_failed(f: Features) -> bool:
    return any(rule(f) for rule in BASE_RULES.values())


def quality_report(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of every document; the further rules run only on those that pass the base, and are ordered on such."""
    sample = [f for f in map(counted, sample_texts(docs)) if not base_failed(f)]
    keep = passes(order_rules(sample, MORE_RULES), MORE_RULES)

    def row(text: str | None) -> tuple:
        f = counted(text)
        failed = base_failed(f)
        return len(f.words), f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, failed, not failed and keep(f)

    return map_texts(docs, "text", row, ["doc_id"], "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")


ORACLE_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, unnest(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS word, generate_subscripts(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), 1) AS i FROM d),
g AS (SELECT r, i, word, lead(word) OVER o AS b, lead(word, 2) OVER o AS c FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
f AS (SELECT r, i, word, c IS NOT NULL AND count(*) OVER (PARTITION BY r, word, b, c) > 1 AS again FROM g),
k AS (SELECT r, word, again OR coalesce(lag(again) OVER o, false) OR coalesce(lag(again, 2) OVER o, false) AS covered FROM f WINDOW o AS (PARTITION BY r ORDER BY i)),
a AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (WHERE covered) AS n_repeat_words FROM k GROUP BY r),
l AS (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d),
u AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
m AS (SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, (length(t) - length(replace(t, chr(10), '')) + 1) AS n_lines FROM d LEFT JOIN a USING (r) LEFT JOIN u USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (10 * n_symbols > 4 * n_words OR 2 * n_dup_lines > n_lines OR NOT (2 * n_words <= word_chars AND word_chars <= 15 * n_words)) AS kept FROM m
"""
