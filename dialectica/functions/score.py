"""Score expressions: rating normalisation, clamps, combination, probabilistic sum, gradual semantics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """c within [low, high]; null stays null (least and greatest alone would drop it), NaN becomes high."""
    return F.when(c.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), c)))


def normalize_rating(c: Column) -> Column:
    """A rating of 1 to 5 on [0, 1]."""
    return clamp((c.cast("double") - 1) / 4)


def normalize_score(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """As clamp, but NaN passes through."""
    return F.when(F.isnan(c), c).otherwise(clamp(c, low, high))


def check_weights(llm_weight: float, mf_weight: float) -> None:
    """Weights must add up to 1; single weights may be negative."""
    if abs(llm_weight + mf_weight - 1.0) > 1e-9:
        raise ValueError(f"weights must add up to 1: {llm_weight} + {mf_weight}")


def combine(llm: Column, mf: Column, llm_weight: float = 0.5, mf_weight: float = 0.5) -> Column:
    check_weights(llm_weight, mf_weight)
    return llm * llm_weight + mf * mf_weight


def base_score(combined: Column, llm: Column, mf: Column, default: float = 0.5) -> Column:
    return F.coalesce(combined, llm, mf, F.lit(default))


def probabilistic_sum(scores: Column) -> Column:
    """1 minus the product of the complements, in array order; 0 for an empty array."""
    return 1 - F.aggregate(scores, F.lit(1.0), lambda a, s: a * (1 - clamp(s)))


def gradual(base: Column, attack: Column, support: Column) -> Column:
    """Final strength of an argument with aggregated attack and support."""
    b, a, s = clamp(base), clamp(attack), clamp(support)
    return clamp(F.when(s >= a, b + (1 - b) * (s - a)).otherwise(b - b * (a - s)))
