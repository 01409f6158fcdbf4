"""Tables that a query makes on its way, in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder under the one that the cluster shares; only a local session that names none takes one under /tmp."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file:///tmp/checkpoints/tallyforge"
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex[:12]}"


_made: list[str] = []


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the shared folder and read again: what several branches of a plan need is made once, and outlives executors."""
    path = shared_folder(df.sparkSession, tag)
    _made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def purge(spark: SparkSession) -> None:
    """Delete what ``stored`` has put into the shared folder, once the results are written elsewhere."""
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
