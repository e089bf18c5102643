"""The input cascade: normalise, signatures, anchored rules, and for what is left a classifier with a Bayes-risk decision.

The scorer is a parameter: a function from a DataFrame with a text column `text` to the same rows with `probs`, the array
of probabilities by LABELS. The text is null in rows that the cheap stages have stopped and in blank ones; a scorer need
not score those. distinct_scorer() has each distinct text scored once. Without a scorer, what is left passes.

A null text is not blocked; its result is that of a text without anything to find.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import risk, rules
from ..functions.signatures import SignatureSet
from ..functions.text import normalize, regex_prefix
from .scan import scan_list, scan_rows

Scorer = Callable[[DataFrame], DataFrame]
COST_FP, COST_FN = 1.0, 10.0
RESULT_TYPE = "struct<blocked:boolean,reason:string,detail:string,confidence:double>"


def result(blocked: Column | bool, reason: Column | str = "", detail: Column | str = "", confidence: Column | float = 0.0) -> Column:
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(lit(blocked).alias("blocked"), lit(reason).alias("reason"), lit(detail).alias("detail"), lit(confidence).cast("double").alias("confidence"))


class Detector:
    """check() text columns, scan() results; signatures, scorer and normalizer are parts that can be replaced."""

    def __init__(self, signatures: SignatureSet | None = None, scorer: Scorer | None = None, normalizer: Callable[[Column], Column] = normalize, cost_fp: float = COST_FP, cost_fn: float = COST_FN, uncertain_ratio: float = 0.2):
        self.signatures = signatures or SignatureSet.with_defaults()
        self.scorer, self.normalizer = scorer, normalizer
        self.costs = (cost_fp, cost_fn, uncertain_ratio)

    def cheap_stages(self, df: DataFrame, column: str) -> DataFrame:
        """df with __hit (signature) and __rule (name of the first rule, where no signature was found)."""
        names = [F.col(f"`{c}`") for c in df.columns]
        out = df.withColumn("__norm", self.normalizer(F.col(f"`{column}`"))).withColumn("__pre", regex_prefix(F.col("__norm"))).withColumn("__gate", rules.gates(F.col("__pre")))
        out = out.withColumn("__hit", self.signatures.hit(F.col("__norm"), F.col("__norm")))
        out = out.withColumn("__rule", F.when(~F.col("__hit"), rules.first_name(F.col("__pre"), F.col("__gate"))))
        return out.select(*names, "__hit", "__rule")

    def scan(self, df: DataFrame, columns: list[str] | None = None) -> DataFrame:
        """A query result with the injected instructions in its string columns (or those named) replaced, by this detector's signatures."""
        return scan_rows(df, self.signatures, columns)

    def scan_list(self, df: DataFrame, column: str, key: str) -> DataFrame:
        """The same for the texts of an array column."""
        return scan_list(df, column, key, self.signatures)

    def check(self, df: DataFrame, column: str, name: str = "verdict") -> DataFrame:
        """df with name: struct<blocked, reason, detail, confidence>."""
        staged = self.cheap_stages(df, column).select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("__row"), "__hit", "__rule")
        found = F.col("__hit") | F.col("__rule").isNotNull()
        own = F.col("__row").getField(column)
        blank = own.isNull() | (F.trim(own) == "")
        late = result(False)
        if self.scorer is not None:
            # One pass: the scorer sees the texts that still need it, and null for the others.
            staged = self.scorer(staged.withColumn("text", F.when(~found & ~blank, own)))
            staged = staged.withColumn("__c", risk.decide(F.element_at("probs", 1), *self.costs, override=risk.safe_override(F.col("text")))["decision"])
            label, conf = risk.label(F.col("probs")), risk.confidence(F.col("probs"))
            late = F.when(F.col("text").isNull(), result(False)).when(F.col("__c") == "BLOCK", result(True, "distilbert_brm", label, conf)).when(F.col("__c") == "UNCERTAIN", result(False, "uncertain", label, conf)).otherwise(result(False))
        verdict = (
            F.when(F.col("__hit"), result(True, "bloom_filter", "known injection signature matched"))
            .when(F.col("__rule").isNotNull(), result(True, "regex_detector", F.concat(F.col("__rule"), F.lit(" ["), rules.category_of(F.col("__rule")), F.lit("]"))))
            .otherwise(late)
        )
        return staged.select("__row.*", verdict.alias(name))

    def funnel(self, df: DataFrame, column: str) -> DataFrame:
        """One row: how many texts each cheap stage stops."""
        s = self.cheap_stages(df, column)
        return s.agg(F.count("*").alias("total"), F.count_if(F.col("__hit")).alias("bloom_blocked"), F.count_if(F.col("__rule").isNotNull()).alias("regex_blocked"), F.count_if(~F.col("__hit") & F.col("__rule").isNull()).alias("residual"))


def distinct_scorer(scorer: Scorer) -> Scorer:
    """scorer run once for each distinct text (trimmed, lower case), its result joined back: the batch form of a prediction cache."""

    def run(df: DataFrame) -> DataFrame:
        keyed = df.withColumn("__key", F.lower(F.trim("text")))
        once = scorer(keyed.groupBy("__key").agg(F.min("text").alias("text"))).select("__key", "probs")
        return keyed.join(once, keyed["__key"].eqNullSafe(once["__key"]), "left").drop("__key")

    return run
