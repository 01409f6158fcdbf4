"""Connected components of a link table, by large-star and small-star rounds.

Every round is two aggregations and joins on node ids, so no component is ever
held in one place; a node with very many links is a skewed join key that
adaptive execution splits. Rounds are stored in the shared folder and go on
until the links no longer change, a number that grows with the logarithm of
the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _lowest(pairs: DataFrame) -> DataFrame:
    """(u, v, m): each pair with the lowest of u and all its partners."""
    low = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return pairs.join(low, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return _lowest(both).where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = _lowest(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    return down.select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).where("a < b")


def components(links: DataFrame) -> DataFrame:
    """links: (a, b) of comparable ids. Gives (node, root), root the lowest id reachable.

    Nodes without links are left out; repeated links and links of a node to
    itself change nothing; no links give no rows.
    """
    now = stored(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct(), "links")
    mark = None
    while True:
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(seen) == mark or not seen[0]:
            return now.select(F.col("b").alias("node"), F.col("a").alias("root")).unionAll(now.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct()
        mark = tuple(seen)
        now = stored(_small_star(_large_star(now).distinct()).distinct(), "links")
