"""Scores and levels as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULT, Config


def any_of(scores: Column) -> Column:
    """Probability of any: 1 minus the product of the complements, in array order."""
    return F.when(F.size(scores) == 0, F.lit(0.0)).otherwise(F.lit(1.0) - F.aggregate(scores, F.lit(1.0), lambda acc, s: acc * (F.lit(1.0) - s)))


def level(score: Column, config: Config = DEFAULT) -> Column:
    return F.when(score >= config.high_from, "HIGH").when(score >= config.medium_from, "MEDIUM").otherwise("LOW")


def ranked(signals: Column) -> Column:
    """Signals by falling score, ties in the order of emission."""
    return F.array_sort(signals, lambda a, b: F.when(a.score > b.score, -1).when(a.score < b.score, 1).when(a.ord < b.ord, -1).when(a.ord > b.ord, 1).otherwise(0))
