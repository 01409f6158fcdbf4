"""Answers of providers, kept by what was asked.

OCR, page decoders and vision models are dear, limited and may answer otherwise
the next time. Their answers are therefore results of a job of their own: the
distinct keys that a batch asks for are held against a write-once table, only
those without an answer go to the provider, once each, and what it says is
stored before any plan reads it. Reports, duplicate searches and reruns read the
table, however often they read.

Keys are digests of the content, so an answer must hang on the content alone; a
model of another name or with other settings needs a folder of its own. An
answer that came with a warning or an error serves the batch that asked, and is
asked for again by the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .ledger import Ledger


class Results:
    """A write-once table of (key, answer) in a ledger."""

    def __init__(self, spark: SparkSession, path: str, name: str):
        self.ledger, self.name = Ledger(spark, path), name

    def read(self, schema: StructType | str) -> DataFrame:
        """The answers that are kept, one for each key."""
        return self.ledger.read(self.name, schema).where("not failed").drop("failed")

    def ensure(self, asked: DataFrame, key: str, ask: Callable[[DataFrame], DataFrame], failed: Column) -> DataFrame:
        """The answers for all keys of ``asked``: (key, what ``ask`` adds), one row for each key.

        asked: (key, ...), keys may repeat and be null; null ones are left out. ask: a
        function that adds columns to such rows; of rows that share a key it sees any one,
        and none whose key has an answer. failed: whether an answer is not to be kept.
        """
        asked = asked.where(F.col(key).isNotNull())
        shape = self._answers(ask(asked), key, asked.columns, failed)
        before = self.read(shape.schema)
        missing = asked.join(before.select(key), key, "left_anti").dropDuplicates([key])
        with self.ledger.commit() as commit:
            now = commit.add(self.name, self._answers(ask(missing), key, asked.columns, failed))
        return before.unionByName(now.drop("failed"))

    @staticmethod
    def _answers(df: DataFrame, key: str, given: list[str], failed: Column) -> DataFrame:
        return df.select(key, *[c for c in df.columns if c not in given], F.coalesce(failed, F.lit(False)).alias("failed"))
