"""Risk reports for a batch of invoices, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..operators.duplicates import duplicate_signals
from ..operators.extract import extract
from ..operators.imaging import data_urls, ela_signals, ela_stats
from ..operators.risk import all_signals, with_risk
from ..operators.vendor import vendor_signals
from ..operators.vision import vision_signals, with_answers
from ..sources.files import Provider, with_fallback, with_ids, with_pages, with_text
from ..sources.results import Results
from ..storage import shared_folder, stored


def analyse(df: DataFrame, directory: DataFrame | None = None, prior: Column | None = None, history: DataFrame | None = None, config: Config = DEFAULT) -> DataFrame:
    """``df`` with signals, risk_score and risk_level.

    df: seq, invoice_id, content_hash and either raw_text (fields are then
    extracted) or the fields as columns. Optional: pixels with height and width
    (error level analysis), vision (a model's JSON answer). prior: which rows count
    as history for later ones; history: a table of earlier rows.
    """
    if "vendor_name" not in df.columns:
        df = extract(df, config=config)
        df = df.select("*", *[F.col(f"fields.{k}").alias(k) for k in ("vendor_name", "vendor_address", "vendor_tax_id", "total", "invoice_date")])
    arrays = []
    if "pixels" in df.columns:
        df = ela_signals(ela_stats(df, config=config), config=config)
        arrays.append("ela_signals")
    df = duplicate_signals(df, prior, history, config=config)
    df = vendor_signals(df, directory, config=config)
    arrays += ["duplicate_signals", "vendor_signals"]
    if "vision" in df.columns:
        df = vision_signals(df, "invoice_id", "vision")
        arrays.append("vision_signals")
    return with_risk(df, all_signals(*[F.col(a) for a in arrays]), config).drop(*arrays)


def answered_files(files: DataFrame, text: Provider | None = None, tokens: Provider | None = None, pages=None, client=None, results: str | None = None, limit: int = 1) -> DataFrame:
    """Scanned files with what the providers say of them, stored: path, seq, invoice_id, content_hash, raw_text, warnings, error; with pages also height, width, pixels and vision.

    results: the folder of the providers' answers (``Results``). Every distinct file is
    handed to the text and page providers once, every distinct image to the model
    once, and none that the folder has an answer for. Without a folder a new one is
    taken, so that is so within this call only.
    """
    spark = files.sparkSession
    base = results or shared_folder(spark, "answers")
    bad = F.col("status") != "ok"
    light = files.select("path", "content_hash", "status")
    content = files.where(~bad).select("content_hash", "content", "path")
    if pages:
        page = Results(spark, base, "pages").ensure(content, "content_hash", lambda d: with_pages(d, pages, limit=limit), F.col("page.error").isNotNull())
        digest = F.sha2(F.concat(F.concat_ws("x", "page.height", "page.width", F.lit("")).cast("binary"), F.col("page.pixels")), 256)
        page = page.select(F.col("content_hash").alias("__page"), "page.*", digest.alias("__image"))
        images = page.select("__image", "height", "width", "pixels")
        ask = lambda d: with_answers(data_urls(d), client).drop("data_url")
        seen = ask(images.where("__image is not null")).drop("height", "width", "pixels").dropDuplicates(["__image"]) if client is None else Results(spark, base, "vision").ensure(images, "__image", ask, F.col("vision_warning").isNotNull() | F.col("vision_error").isNotNull())
        page = page.join(seen.withColumnRenamed("__image", "__seen"), F.col("__image") == F.col("__seen"), "left").drop("__image", "__seen").withColumnRenamed("error", "__page_error")
        light = light.join(page, F.col("content_hash") == F.col("__page"), "left").drop("__page")
    said = _texts(content, text, Results(spark, base, "text"), "raw_text", "__text")
    if tokens is not None:
        blank = said.where(F.col("raw_text") == "").select("content_hash")
        more = _texts(content.join(blank, "content_hash", "left_semi"), tokens, Results(spark, base, "tokens"), "__other", "__tokens")
        said = with_fallback(said.join(more, "content_hash", "left"), "raw_text", "__other").drop("__other")
    light = light.join(said.withColumnRenamed("content_hash", "__said"), F.col("content_hash") == F.col("__said"), "left").drop("__said")
    errors = [F.when(bad, F.col("status")), *([F.col("__page_error"), F.col("vision_error")] if pages else [])]
    warnings = ["__text", *(["__tokens"] if tokens is not None else []), *(["vision_warning"] if pages else [])]
    df = light.withColumns({"error": F.coalesce(*errors), "warnings": F.array_compact(F.array(*warnings)), "raw_text": F.coalesce("raw_text", F.lit(""))})
    df = df.drop("status", *warnings, "__page_error", "vision_error")
    # numbered once: what is stored doesn't change when a branch of a plan reads it again
    df = df.repartitionByRange("path").sortWithinPartitions("path").withColumn("seq", F.monotonically_increasing_id())
    return stored(with_ids(df), "answered-files")


def _texts(content: DataFrame, provider: Provider | None, results: Results, out: str, warning: str) -> DataFrame:
    if provider is None:
        return content.select("content_hash", F.lit("").alias(out), F.lit(None).cast("string").alias(warning)).dropDuplicates(["content_hash"])
    return results.ensure(content, "content_hash", lambda d: with_text(d, provider, out, warning), F.col(warning).isNotNull())


def analyse_files(
    files: DataFrame, directory: DataFrame | None = None, text: Provider | None = None, tokens: Provider | None = None, pages=None, client=None,
    history: DataFrame | None = None, config: Config = DEFAULT, results: str | None = None,
) -> DataFrame:
    """From scanned files (``scan_files``) to reports: path, invoice_id, risk_level, risk_score, signals, warnings, error.

    text and tokens: providers of text, the second for files without any; pages:
    a decoder of PDF pages and images; client: a vision model's. All are plain
    functions, and are asked once for each distinct content (``answered_files``).
    A file that was not read, or whose page or answer failed, is a row with an
    ``error`` and nothing else, and is no history for others; a provider that isn't
    there or fails costs its text or findings only and leaves a warning. Files
    arrive in the order of their paths.
    """
    df = answered_files(files, text, tokens, pages, client, results)
    names = ("path", "invoice_id", "risk_level", "risk_score", "signals", "warnings", "error")
    reports = analyse(df.where("error is null"), directory, history=history, config=config).select(*names)
    return reports.unionByName(df.where("error is not null").select("path", "error"), allowMissingColumns=True)


def evaluate(scenarios: DataFrame, directory: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """(label, risk_level, ...) of labelled scenarios. Only clean rows become history, and a
    row's content hash stands for its vendor and total."""
    df = scenarios.withColumn("invoice_id", F.concat(F.lit("s"), "seq")).withColumn("content_hash", F.sha2(F.concat_ws("|", "vendor_name", F.col("total").cast("string")), 256))
    return analyse(df, directory, F.col("label") == "clean", config=config)
