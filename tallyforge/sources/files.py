"""Scans of document files, with pluggable decoders and text providers.

A provider is a plain function; it runs in Arrow batches on the executors and
a failure of it marks its row and no other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config

Provider = Callable[[bytes, str], str]
PAGES = "height int, width int, pixels binary, error string"
TEXT = "text string, warning string"


def scan_files(spark: SparkSession, path: str, glob: str | None = None, config: Config = DEFAULT) -> DataFrame:
    """path, content, length, content_hash and status of files; those over the size limit have no content.

    The source doesn't list files of zero bytes.
    """
    reader = spark.read.format("binaryFile")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    df = reader.load(path)
    large = F.col("length") > config.max_bytes
    status = F.when(large, "too large").otherwise("ok")
    content = F.when(~large, F.col("content"))
    return df.select("path", content.alias("content"), "length", F.sha2(content, 256).alias("content_hash"), status.alias("status"))


def checked_uploads(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Uploads (request_id, filename, content) as ``scan_files`` gives files, with what is wrong as the status.

    A request's one file: a missing field, an empty name and a file over the limit are errors of their own.
    """
    size = F.octet_length("content").cast("long")
    large = size > config.max_bytes
    status = F.when(F.col("filename").isNull() & F.col("content").isNull(), "no file field").when(F.coalesce("filename", F.lit("")) == "", "empty file name").when(large, "too large").otherwise("ok")
    content = F.when(status == "ok", F.col("content"))
    return df.select("request_id", F.col("filename").alias("path"), content.alias("content"), size.alias("length"), F.sha2(content, 256).alias("content_hash"), status.alias("status"))


def checked_batches(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Uploads of several files a request: files without a name are left out, a request without any other is one error row."""
    named = F.coalesce("filename", F.lit("")) != ""
    files = checked_uploads(df.where(named), config)
    bare = df.groupBy("request_id").agg(F.max(named).alias("some")).where("not some")
    nil = {"path": "string", "content": "binary", "length": "long", "content_hash": "string"}
    return files.unionByName(bare.select("request_id", *[F.lit(None).cast(t).alias(k) for k, t in nil.items()], F.lit("no files").alias("status")))


def scan_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, raw_text) of text files, one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("raw_text"))


def scan_images(spark: SparkSession, path: str) -> DataFrame:
    """path, height, width, RGB pixels and status of image files; a file that is no image has no pixels."""
    df = spark.read.format("image").load(path).select("image.*")
    fits = F.col("height") > 0
    size = [F.when(fits, F.col(c)).alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))]
    return as_rgb(df.select(F.col("origin").alias("path"), *size, F.when(fits, "ok").otherwise("not an image").alias("status")))


def as_rgb(df: DataFrame) -> DataFrame:
    """(height, width, channels, data) in blue, green, red order (or grey) to RGB ``pixels``."""

    @F.pandas_udf("binary")
    def flip(data: pd.Series, channels: pd.Series) -> pd.Series:
        import numpy as np

        out = []
        for d, c in zip(data, channels, strict=True):
            if d is None:
                out.append(None)
                continue
            a = np.frombuffer(d, np.uint8).reshape(-1, int(c))
            out.append((np.repeat(a, 3, 1) if c == 1 else a[:, 2::-1]).tobytes())
        return pd.Series(out)

    return df.withColumn("pixels", flip("data", "channels")).drop("data", "channels")


def with_text(df: DataFrame, provider: Provider | None, out: str = "raw_text", warning: str | None = None) -> DataFrame:
    """``df`` (content, path) with text from a provider such as OCR; without one, or where it fails, empty text.

    warning: a column for what a failure said.
    """
    if provider is None:
        df = df.withColumn(out, F.lit(""))
        return df if warning is None else df.withColumn(warning, F.lit(None).cast("string"))

    @F.pandas_udf(TEXT)
    def read(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for contents, paths in frames:
            rows = []
            for content, path in zip(contents, paths, strict=True):
                try:
                    rows.append((provider(content, path) if content is not None else "", None))
                except Exception as e:
                    rows.append(("", f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["text", "warning"], dtype="object")

    df = df.withColumn("__read", read("content", "path")).withColumn(out, F.coalesce("__read.text", F.lit("")))
    return (df if warning is None else df.withColumn(warning, F.col("__read.warning"))).drop("__read")


def with_token_text(df: DataFrame, provider: Provider | None, text: str = "raw_text", warning: str | None = None) -> DataFrame:
    """``df`` where empty text is replaced by a second provider's, such as a model's tokens.

    Only rows without text are handed to it; without one, or where it fails, the text stays empty and extraction goes by its rules alone.
    """
    missing = F.coalesce(F.col(text), F.lit("")) == ""
    kept = df.select("*", F.col("content").alias("__content")).withColumn("content", F.when(missing, F.col("content")))
    kept = with_text(kept, provider, "__other", warning)
    kept = kept.withColumn("content", F.col("__content")).drop("__content")
    return with_fallback(kept, text, "__other").drop("__other")


def with_pages(df: DataFrame, decoder: Callable[..., tuple[int, int, bytes]], out: str = "page", suffix: str | None = None, limit: int = 1) -> DataFrame:
    """``df`` (content, path) with the last of at most ``limit`` pages that a decoder gives, as an image struct.

    decoder: (content, path) to (height, width, RGB pixels), or to an iterable of such pages, of
    which no more than ``limit`` are taken. No page is an error, as is a failure: each its own row's ``error``.
    suffix: only paths that end so, in any case, are decoded; others have a null page.
    """

    @F.pandas_udf(PAGES)
    def read(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        from itertools import islice

        for contents, paths in frames:
            rows = []
            for content, path in zip(contents, paths, strict=True):
                try:
                    got = decoder(content, path)
                    if not (isinstance(got, tuple) and len(got) == 3 and isinstance(got[0], int)):
                        pages = list(islice(got, limit))
                        if not pages:
                            raise ValueError("no pages")
                        got = pages[-1]
                    rows.append((*got, None))
                except Exception as e:
                    rows.append((None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=[p.split()[0] for p in PAGES.split(", ")])

    if suffix is None:
        return df.withColumn(out, read("content", "path"))
    fits = F.lower("path").endswith(suffix.lower())
    return df.withColumn(out, F.when(fits, read("content", "path")))


def with_ids(df: DataFrame, seq: str = "seq") -> DataFrame:
    """``df`` (content_hash, seq) with a short id that a rerun gives again: eight digits of the hash, and the row's number."""
    return df.withColumn("invoice_id", F.concat(F.substring("content_hash", 1, 8), F.lit("-"), F.col(seq).cast("string")))


def with_fallback(df: DataFrame, text: str, other: str) -> DataFrame:
    """``df`` where an empty or missing text is replaced by that of another provider."""
    return df.withColumn(text, F.coalesce(F.nullif(F.col(text), F.lit("")), F.col(other), F.lit("")))
