"""Signals to risk: union, order, probability of any, level, report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.scoring import any_of, level, ranked


def all_signals(*arrays: Column) -> Column:
    """One array of the signals of all detectors; a null array counts as none."""
    return F.flatten(F.array_compact(F.array(*arrays)))


def with_risk(df: DataFrame, signals: Column, config: Config = DEFAULT) -> DataFrame:
    """``df`` with signals in order, risk_score and risk_level. The level comes from the unrounded score."""
    df = df.withColumn("signals", ranked(signals))
    df = df.withColumn("risk_score", any_of(F.transform("signals", lambda s: s["score"])))
    return df.withColumn("risk_level", level(F.col("risk_score"), config))


def signal_rows(df: DataFrame, key: str, signals: str = "signals") -> DataFrame:
    """One row per signal with its rank (1 is the highest)."""
    exploded = df.select(key, F.posexplode(signals).alias("pos", "s"))
    return exploded.select(key, (F.col("pos") + 1).alias("rank"), "s.source", "s.code", "s.weight", "s.confidence", "s.score")


def risk_from_rows(rows: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """(key, risk_score, risk_level) from a table of signal scores, by a product aggregate."""
    out = rows.groupBy(key).agg((F.lit(1.0) - F.product(F.lit(1.0) - F.col("score"))).alias("risk_score"))
    return out.withColumn("risk_level", level(F.col("risk_score"), config))


def shown(x: Column) -> Column:
    """Three decimals, for reports."""
    return F.call_function("format_number", x, F.lit("0.000")).cast("double")


def report(df: DataFrame) -> DataFrame:
    """The columns of a report, with scores rounded for display."""
    parts = lambda s: F.struct(s["source"].alias("source"), s["code"].alias("code"), s["description"].alias("description"), s["weight"].alias("weight"), s["confidence"].alias("confidence"), shown(s["score"]).alias("score"), s["evidence"].alias("evidence"))
    return df.withColumn("signals", F.transform("signals", parts)).withColumn("risk_score", shown(F.col("risk_score")))
