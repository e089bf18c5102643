"""Signature sets: known phrases and all their windows of two to four tokens.

Membership is exact. A text hits if it equals a phrase, or, having two tokens or more, if one of its tokens or of its
windows is in the set. The set is closed under windows, so a longer window that is in it has a two-token window that is
in it too: testing single tokens and pairs tests all.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .fixed import SIGNATURES
from .text import WINDOW_MAX, WINDOW_MIN, _windows_of, bind, squeeze, tokens, windows

#: Sets of up to so many pairs and single tokens become literals of the expression; larger ones are joined.
LITERAL_GRAMS = 256


def phrase_windows(phrase: str) -> list[str]:
    words = phrase.split()
    return [" ".join(words[i : i + k]) for k in range(WINDOW_MIN, WINDOW_MAX + 1) for i in range(len(words) - k + 1)]


def phrase_pattern(grams: list[str]) -> str:
    """A pattern that finds any of the grams (one or two words) between spaces; grams of one first word share a branch."""
    quote = lambda w: re.sub(r"([^\w])", r"\\\1", w)
    by: dict[str, list[str]] = {}
    for g in grams:
        first, _, rest = g.partition(" ")
        by.setdefault(first, []).append(quote(rest))
    branches = []
    for first, rest in by.items():
        tails = "|".join(sorted(r for r in rest if r))
        branches.append(quote(first) + (f" (?:{tails})" if "" not in rest else f"(?: (?:{tails}))?" if tails else ""))
    return f" (?:{'|'.join(branches)})(?= )"


class SignatureSet:
    """A small set, held on the driver. load() returns the number of phrases added; count has every insertion."""

    def __init__(self, phrases: Iterable[str] = ()):
        self.phrases: list[str] = []
        self.grams: set[str] = set()
        self.count = 0
        self.load(phrases)

    @classmethod
    def with_defaults(cls) -> SignatureSet:
        return cls(SIGNATURES)

    def load(self, phrases: Iterable[str]) -> int:
        added = 0
        for phrase in phrases:
            more = phrase_windows(phrase)
            self.phrases.append(phrase)
            self.grams |= {phrase, *more}
            self.count += 1 + len(more)
            added += 1
        return added

    @property
    def signature_count(self) -> int:
        return len(self.phrases)

    def __repr__(self) -> str:
        return f"SignatureSet(signatures={self.signature_count}, grams={len(self.grams)})"

    def short(self) -> list[str]:
        """The pairs and single tokens of the set."""
        return sorted(g for g in self.grams if len(g.split()) in (1, 2) and g == " ".join(g.split()))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(g,) for g in sorted(self.grams)], "gram string")

    def hit(self, text: Column, squeezed: Column | None = None) -> Column:
        """Whether text hits the set. squeezed: squeeze(text), where that is a column already. Null hits nothing."""
        joined = squeeze(text) if squeezed is None else squeezed
        short = self.short()
        if len(short) <= LITERAL_GRAMS:
            found = F.concat(F.lit(" "), joined, F.lit(" ")).rlike(phrase_pattern(short)) if short else F.lit(False)
        else:
            literal = F.array(*map(F.lit, short))
            found = bind(tokens(joined), lambda t: F.arrays_overlap(F.concat(t, _windows_of(t, 2, 2)), literal))
        whole = text.isin(self.phrases) if self.phrases else F.lit(False)
        return F.coalesce(whole | (F.contains(joined, F.lit(" ")) & found), F.lit(False))


def corpus_grams(phrases: DataFrame, column: str = "phrase") -> DataFrame:
    """gram, each once: the phrases of a corpus and their windows."""
    both = F.concat(F.array(F.col(column)), windows(F.col(column)))
    return phrases.where(F.col(column).isNotNull()).select(F.explode(both).alias("gram")).distinct()


def hits_by_join(texts: DataFrame, key: str, column: str, grams: DataFrame) -> DataFrame:
    """The keys of texts that hit a set of any size: windows are exploded and semi-joined, then each key counts once.

    Of the set only single tokens, pairs and phrases matter (see above), so only those are made of the texts. The text as
    a whole matters only if it has fewer than two tokens: a phrase of more has a pair that is in the set.
    """
    own = bind(tokens(F.col(column)), lambda t: F.when(F.size(t) >= 2, F.array_distinct(F.concat(t, _windows_of(t, 2, 2)))).otherwise(F.array(F.col(column))))
    found = texts.where(F.col(column).isNotNull()).select(key, F.explode(own).alias("gram")).join(grams, "gram", "left_semi")
    return found.select(key).distinct()


def signature_rows(phrases: DataFrame, column: str = "phrase") -> DataFrame:
    """n_signatures, n_insertions, n_grams of a corpus."""
    known = phrases.where(F.col(column).isNotNull())
    made = known.select(F.lit(1).alias("phrases"), F.size(windows(F.col(column))).alias("made"), F.lit(0).alias("grams"))
    distinct = corpus_grams(phrases, column).select(F.lit(0).alias("phrases"), F.lit(0).alias("made"), F.lit(1).alias("grams"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return made.unionByName(distinct).agg(total("phrases").alias("n_signatures"), (total("phrases") + total("made")).alias("n_insertions"), total("grams").alias("n_grams"))
