"""Confidence, logit and rate expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def softmax_conf(neg: Column, pos: Column) -> Column:
    """Probability of the positive of two logits; 0.5 where one is missing or not finite."""
    bad = neg.isNull() | pos.isNull() | F.isnan(neg) | F.isnan(pos)
    return F.when(bad, F.lit(0.5)).otherwise(1.0 / (1.0 + F.exp(F.least(F.greatest(neg - pos, F.lit(-700.0)), F.lit(700.0)))))


def log_prob(p: Column, eps: float = 1e-8) -> Column:
    return F.ln(F.least(F.greatest(p, F.lit(eps)), F.lit(1.0 - eps)))


def clamp_confidence(text: Column) -> Column:
    """A confidence as text -> double in [0, 1]; null if empty or not a number."""
    return F.least(F.greatest(F.nullif(F.trim(text), F.lit("")).try_cast("double"), F.lit(0.0)), F.lit(1.0))


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 where the whole is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def f1(precision: Column, recall: Column) -> Column:
    return ratio(2 * precision * recall, precision + recall)
