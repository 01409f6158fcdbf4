"""Detection quality against labels: confusion counts, precision, recall, F1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LABELS = ("clean", "duplicate", "synthetic_vendor", "tampered")


def flagged(df: DataFrame) -> DataFrame:
    """``df`` (label, risk_level) with predicted and actual as booleans."""
    return df.withColumn("predicted", F.col("risk_level") != "LOW").withColumn("actual", F.col("label") != "clean")


def confusion(df: DataFrame, labels: tuple[str, ...] | None = LABELS) -> DataFrame:
    """tp, fp, tn, fn per label and, as label ``overall``, in all; every label has a row."""
    p, a = F.col("predicted"), F.col("actual")
    counts = [F.count_if(x).alias(k) for k, x in (("tp", p & a), ("fp", p & ~a), ("tn", ~p & ~a), ("fn", ~p & a))]
    rows = flagged(df).groupingSets([[F.col("label")], []], F.col("label")).agg(F.grouping("label").alias("all_rows"), *counts)
    rows = rows.select(F.when(F.col("all_rows") == 1, "overall").otherwise(F.col("label")).alias("label"), "tp", "fp", "tn", "fn")
    if not labels:
        return rows
    spark = df.sparkSession
    every = spark.createDataFrame([("overall",), *((x,) for x in labels)], "label string")
    joined = every.join(rows.withColumnRenamed("label", "__label"), F.col("label") == F.col("__label"), "full")
    return joined.select(F.coalesce("label", "__label").alias("label"), *[F.coalesce(k, F.lit(0)).alias(k) for k in ("tp", "fp", "tn", "fn")])


def quality(counts: DataFrame, digits: int = 6) -> DataFrame:
    """``counts`` with precision, recall, f1 and fp_rate; f1 is made from the unrounded values."""
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    rate = F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1))
    f1 = F.lit(2.0) * F.col("__p") * F.col("__r") / F.greatest(F.col("__p") + F.col("__r"), F.lit(1e-9))
    out = counts.withColumns({"__p": p, "__r": r, "__rate": rate})
    return out.select("label", "tp", "fp", "tn", "fn", F.round("__p", digits).alias("precision"), F.round("__r", digits).alias("recall"), F.round(f1, digits).alias("f1"), F.round("__rate", digits).alias("fp_rate"))


def distribution(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows and percent per label, in label order."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(F.lit(1)))
    return counts.select("label", "n", F.round(F.lit(100.0) * F.col("n") / total, 6).alias("percent")).orderBy("label")
