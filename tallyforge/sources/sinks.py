"""Where reports, history, errors and metrics go."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.evaluate import confusion, distribution, quality
from ..operators.imaging import data_urls

HISTORY = ("seq", "invoice_id", "content_hash", "vendor_name", "total", "invoice_date")


def write_reports(reports: DataFrame, path: str, mode: str = "append") -> None:
    """Reports as JSON lines; null fields are kept as keys."""
    reports.write.mode(mode).option("ignoreNullFields", "false").json(path)


def as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def split_errors(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that went well, (path, error) of the others)."""
    return df.where("status = 'ok'"), df.where("status <> 'ok'").select("path", F.col("status").alias("error"))


def append_history(df: DataFrame, path: str) -> None:
    """Add every row that was analysed to the history, flagged or not."""
    df.select(*HISTORY).write.mode("append").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A few rows of metrics as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


def write_evaluation(scored: DataFrame, path: str, seed: int | None = None) -> dict:
    """The evaluation of labelled rows (label, risk_level) as one JSON file: n, seed, label_distribution, results.

    Only the few rows of metrics come to the driver; the file is written by Spark, so the path may be in any store.
    """
    counts = confusion(scored)
    labels = {r.label: {"n": r.n, "percent": r.percent} for r in distribution(scored).orderBy("label").collect()}
    results = {r.label: {k: v for k, v in r.asDict().items() if k != "label"} for r in quality(counts).orderBy("label").collect()}
    out = {"n": sum(x["n"] for x in labels.values()), "seed": seed, "label_distribution": labels, "results": results}
    spark = scored.sparkSession
    spark.createDataFrame([(json.dumps(out, indent=2),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return out


def write_images(df: DataFrame, path: str, saved: int = 95) -> None:
    """Images (image_id, height, width, pixels) as JPEG, one row each; those whose size doesn't fit have none."""
    jpeg = F.unbase64(F.regexp_replace("__url", "^data:image/jpeg;base64,", ""))
    encoded = data_urls(df.select("image_id", "height", "width", "pixels"), out="__url", most=1 << 16, quality=saved)
    encoded.select("image_id", jpeg.alias("jpeg")).write.mode("overwrite").parquet(path)


def write_heatmaps(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)
