"""The decision around a classifier: labels, threat test, and the choice of least Bayes risk."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .fixed import LABELS, SQL_WORDS, TRIGGER_WORDS
from .text import tokens

THREAT_CONFIDENCE = 0.75


def safe_override(text: Column) -> Column:
    """Whether text has none of the words that make a decision necessary, as whole tokens in any case."""
    words = F.array(*map(F.lit, SQL_WORDS + TRIGGER_WORDS))
    return F.coalesce(~F.arrays_overlap(tokens(F.lower(text)), words), F.lit(True))


def label(probabilities: Column) -> Column:
    """The first label of greatest probability; probabilities: array by LABELS."""
    return F.element_at(F.array(*map(F.lit, LABELS)), F.array_position(probabilities, F.array_max(probabilities)).cast("int"))


def confidence(probabilities: Column) -> Column:
    return F.bround(F.array_max(probabilities), 4)


def predict(text: Column, probabilities: Column) -> Column:
    """struct<label, confidence>; a blank or null text is safe for certain."""
    blank = text.isNull() | (F.trim(text) == "")
    return F.struct(F.when(blank, "SAFE").otherwise(label(probabilities)).alias("label"), F.when(blank, 1.0).otherwise(confidence(probabilities)).alias("confidence"))


def predict_proba(text: Column, probabilities: Column) -> Column:
    """The distribution as a struct by LABELS; of a blank or null text, SAFE with certainty."""
    blank = F.trim(F.coalesce(text, F.lit(""))) == ""
    return F.struct(*(F.when(blank, 1.0 if i == 0 else 0.0).otherwise(F.element_at(probabilities, i + 1)).alias(name) for i, name in enumerate(LABELS)))


def is_threat(label: Column, confidence: Column, threshold: float = THREAT_CONFIDENCE) -> Column:
    return (label != "SAFE") & (confidence >= threshold)


def decide(p_safe: Column, cost_fp: float = 1.0, cost_fn: float = 2.0, uncertain_ratio: float = 0.2, override: Column | None = None) -> Column:
    """struct<decision, margin>: the risk of blocking is cost_fp * p_safe, that of passing cost_fn * (1 - p_safe)."""
    block, passing = F.lit(cost_fp) * p_safe, F.lit(cost_fn) * (F.lit(1.0) - p_safe)
    most = F.greatest(block, passing)
    gap = F.when(most == 0, F.lit(0.0)).otherwise(F.abs(block - passing) / most)
    choice = F.when(most == 0, "PASS").when(gap < uncertain_ratio, "UNCERTAIN").when(block < passing, "BLOCK").otherwise("PASS")
    if override is not None:
        choice, gap = F.when(override, "PASS").otherwise(choice), F.when(override, 0.0).otherwise(gap)
    return F.struct(choice.alias("decision"), gap.alias("margin"))
