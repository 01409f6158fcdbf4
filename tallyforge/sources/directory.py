"""The directory of approved vendors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..schema import DIRECTORY

# The default directory.
DEFAULT_ROWS = (("Acme Corporation", "12-3456780"), ("Globex LLC", "98-7654320"), ("Initech Inc.", "45-6789012"))


def directory_of(spark: SparkSession, rows=DEFAULT_ROWS) -> DataFrame:
    """A directory from (name, tax id or None) pairs, in their order."""
    return spark.createDataFrame([(n, t, k) for k, (n, t) in enumerate(rows)], DIRECTORY)


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DIRECTORY).parquet(path)
