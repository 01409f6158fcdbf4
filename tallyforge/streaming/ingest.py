"""Streaming ingestion against a history that is never evicted.

A stream's duplicates are found by keyed state (``state``), so what a batch reads
doesn't grow with the history. Reports, errors and the history itself go to a
ledger: one manifest names the parts of all three, so a batch appears whole or
not at all, readers keep their snapshot, and a batch that is replayed after its
commit changes nothing. The state lies in the checkpoint, and is of the batches
that the checkpoint has.

``analyse_batch`` is the same for batches that come without a stream: it joins
the ledger's history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..plans.pipeline import analyse
from ..sources.ledger import Ledger
from ..sources.sinks import HISTORY
from . import state

HISTORY_TYPES = "seq long, invoice_id string, content_hash string, vendor_name string, total double, invoice_date date"
ERROR_TYPES = "seq long, invoice_id string, error string"


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """The rows that committed batches of a ledger have recorded."""
    return Ledger(spark, path).read("history", HISTORY_TYPES)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """The reports that committed batches of a ledger have given."""
    return Ledger(spark, path).read("reports")


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """(seq, invoice_id, error) of rows that were neither analysed nor recorded."""
    return Ledger(spark, path).read("errors", ERROR_TYPES)


def _recorded(commit, rows: DataFrame, reports: DataFrame, failed: DataFrame | None) -> None:
    commit.add("reports", reports)
    commit.add("history", rows.select(*HISTORY))
    if failed is not None:
        commit.add("errors", failed.select("seq", "invoice_id", "error"))


def _parted(batch: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(rows to analyse, failed rows) by the column ``error``, where there is one."""
    if "error" not in batch.columns:
        return batch, None
    return batch.where("error is null").drop("error"), batch.where("error is not null")


def analyse_batch(batch: DataFrame, batch_id: int, path: str, directory: DataFrame | None = None, config: Config = DEFAULT) -> None:
    """Analyse a batch against the ledger's history and itself, and commit its reports, errors and history.

    Rows with an ``error`` (where the batch has that column) are errors of the ledger,
    and neither analysed nor recorded.
    """
    ledger = Ledger(batch.sparkSession, path)
    with ledger.commit(batch_id) as commit:
        if commit is None:
            return
        rows, failed = _parted(batch)
        past = ledger.read("history", HISTORY_TYPES)
        _recorded(commit, rows, analyse(rows, directory, history=past, config=config), failed)


def ingest(stream: DataFrame, path: str, checkpoint: str, directory: DataFrame | None = None, config: Config = DEFAULT, **trigger):
    """Start the query that fills the ledger at ``path``; ``trigger`` as in writeStream.trigger, e.g. availableNow=True.

    ``seq`` is unique and says which row is earlier. The session is set to ``state.STORE``.
    """
    spark = stream.sparkSession
    for name, value in state.STORE.items():
        spark.conf.set(name, value)
    rows, _ = _parted(stream)
    columns = stream.columns
    # rows and what the state says of them, in one batch; the source is read once for both
    both = stream.select(F.struct(*columns).alias("row")).unionByName(state.found(rows, config).select(F.struct("*").alias("found")), allowMissingColumns=True)

    def run(batch: DataFrame, batch_id: int) -> None:
        with Ledger(spark, path).commit(batch_id) as commit:
            if commit is None:
                return
            staged = commit.stage(batch)
            good, failed = _parted(staged.where("row is not null").select("row.*"))
            matched = state.with_found(good, staged.where("found is not null").select("found.*"), config)
            _recorded(commit, good, analyse(matched, directory, config=config), failed)

    return both.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
