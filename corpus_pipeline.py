"""The corpus pipeline: from raw documents to sampled segmentations.

Each stage calls one operator of ``tallyforge.llm`` on all that its predecessor
kept; stages are written as Parquet and read again, in ``run`` as elsewhere.

1. quality rules: documents that the rules reject go
2. near-duplicates: of each class of copies and near copies one document stays
3. PII: entities are replaced by surrogates of their type and format
4. mixing: sources are repeated or sampled to their target weights
5. pieces: every document in ``pieces.SAMPLES`` sampled SentencePiece segmentations

Defined cases: a missing text counts as empty; an empty table gives an empty
result; further columns of documents are passed on up to the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import mixing, nearcopies, pieces, pii, quality
from tallyforge.llm.common import discard, last_path, scratch, stored, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return nearcopies.deduplicate(docs)


def surrogates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = pii.replace_pii(docs, pii.checked_key(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def segmentations(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pieces.sample_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("pii", surrogates),
    ("mixing", mixture),
    ("pieces", segmentations),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next one reads it; what a stage leaves behind is deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
            keep.add(last_path())
        discard(spark, before)
        before = last_path()
    return STAGES[-1][1](spark, docs, sf_dir)
