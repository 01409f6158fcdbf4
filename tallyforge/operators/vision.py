"""Findings of a vision model from its JSON answer, through VARIANT.

Anything malformed gives no findings; invalid elements are skipped one by one.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import DETECTORS, EVIDENCE_FIELDS, EVIDENCE_TYPE, ORD_STEP, SIGNALS, VISION_CODES, clamp01, no_signals


def with_answers(df: DataFrame, client: Callable[[list[str]], list[str]] | None, image: str = "data_url", out: str = "vision", batch: int = 8, per_minute: float | None = None) -> DataFrame:
    """``df`` with a vision model's JSON answers, and ``vision_warning`` and ``vision_error``.

    client: takes some images (data URLs) and gives an answer for each; a plain
    function that holds the model's name and settings, called on the executors with
    up to ``batch`` images at a time, and at most ``per_minute`` images a minute in
    each task. Without one the answers are null: no findings. Where it raises
    RuntimeError (it isn't available), its images have no answer and a warning;
    any other failure is the error of its rows.
    """
    if client is None:
        return df.withColumns({c: F.lit(None).cast("string") for c in (out, "vision_warning", "vision_error")})

    @F.pandas_udf("answer string, warning string, error string")
    def ask(frames: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        free = 0.0
        for images in frames:
            rows, known = [(None, None, None)] * len(images), [k for k, x in enumerate(images) if x is not None]
            for at in range(0, len(known), batch):
                some = known[at : at + batch]
                if per_minute:
                    time.sleep(max(0.0, free - time.monotonic()))
                    free = time.monotonic() + 60 * len(some) / per_minute
                try:
                    answers = client([images.iloc[k] for k in some])
                    got = [(a, None, None) for _, a in zip(some, answers, strict=True)]
                except RuntimeError as e:
                    got = [(None, f"{type(e).__name__}: {e}", None)] * len(some)
                except Exception as e:
                    got = [(None, None, f"{type(e).__name__}: {e}")] * len(some)
                for k, row in zip(some, got, strict=True):
                    rows[k] = row
            yield pd.DataFrame(rows, columns=["answer", "warning", "error"], dtype="object")

    named = {out: "answer", "vision_warning": "warning", "vision_error": "error"}
    return df.withColumn("__asked", ask(F.col(image))).withColumns({k: F.col(f"__asked.{v}") for k, v in named.items()}).drop("__asked")


def vision_findings(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, pos, code, description, confidence, weight, score) of the valid findings of each answer."""
    parsed = df.select(F.col(key), F.try_variant_get(F.try_parse_json(content), "$.findings", "variant").alias("__f"))
    found = parsed.where(F.schema_of_variant("__f").startswith("ARRAY")).select(F.col(key), F.col("__f").cast("array<variant>").alias("__list"))
    rows = found.select(key, F.posexplode("__list").alias("pos", "value"))
    kind = lambda name: F.schema_of_variant(F.try_variant_get("value", f"$.{name}", "variant"))
    is_object = F.schema_of_variant("value").startswith("OBJECT")
    number = kind("confidence")
    valid = (kind("code") == "STRING") & (kind("description") == "STRING") & (number.isin("BIGINT", "DOUBLE", "FLOAT", "BOOLEAN") | number.startswith("DECIMAL"))
    confidence = F.when(number == "BOOLEAN", F.try_variant_get("value", "$.confidence", "boolean").cast("int").cast("double")).otherwise(F.try_variant_get("value", "$.confidence", "double"))
    weights = F.create_map(*[F.lit(x) for c in VISION_CODES for x in (c, SIGNALS[c][1])])
    out = rows.where(is_object & valid).select(
        key, "pos", F.try_variant_get("value", "$.code", "string").alias("code"), F.try_variant_get("value", "$.description", "string").alias("description"), clamp01(confidence).alias("confidence")
    )
    out = out.where(F.col("code").isin(*VISION_CODES)).withColumn("weight", weights[F.col("code")])
    return out.withColumn("score", F.col("weight") * F.col("confidence"))


def vision_signals(df: DataFrame, key: str, content: str, out: str = "vision_signals") -> DataFrame:
    """``df`` with an array of vision signals in the order of the answer."""
    found = vision_findings(df, key, content)
    evidence = F.struct(*[F.lit(None).alias(k) for k in EVIDENCE_FIELDS]).cast(EVIDENCE_TYPE).alias("evidence")
    place = (F.col("pos") + DETECTORS.index("gpt4v") * ORD_STEP).cast("int").alias("ord")
    one = F.struct(F.lit("gpt4v").alias("source"), "code", "description", "weight", "confidence", "score", evidence, place)
    lists = found.groupBy(F.col(key).alias("__vkey")).agg(F.sort_array(F.collect_list(F.struct("pos", one.alias("s")))).alias("__list"))
    joined = df.join(lists, F.col(key) == F.col("__vkey"), "left")
    return joined.withColumn(out, F.coalesce(F.transform("__list", lambda x: x.s), no_signals())).drop("__vkey", "__list")
