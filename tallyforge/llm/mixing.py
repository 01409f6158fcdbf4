"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of the word budget in proportion to its weight.
No source may be read more than ``max_epochs`` times; what a clamped source
cannot take goes to the others in proportion to their weights until all fit.
A round needs two sums over the sources, so there may be any number of them;
only the sums come to the driver.

A source's target becomes whole repetitions of all its documents and a seeded
fractional one. The fractional one takes documents in the order of a hash of
their id and text until the words that remain are reached. To find that threshold
without ordering a source (one may hold a third of all rows), word counts are
first summed over 1024 ranges of the hash, map side first; the one range per
source in which the threshold falls is summed over 1024 finer ones, and only
the finer one with the threshold, a millionth of the source, is ordered.

Rows of one source, id and text are one unit of many. Where the threshold falls
inside such a unit only some of its rows are taken once more; those rows alone
are numbered, by ranges of a random number, so a unit may hold any share of them.

Defined cases: null text has size 0 and takes no words; a document without
words is taken ``max_epochs`` times at most, like any other; a null source is a
source of its own, ordered last; a null id hashes like a fixed value; of rows
that agree in id and text any may be those that are taken; an empty table gives
an empty result; extra columns of ``docs`` are passed on by ``mix``, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import n_words, ranked, stored, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_EPOCHS = 2.0
SEED = 20240607
UNIT = ("__mix_u", "__mix_id", "__mix_text")  # what tells rows of a source apart
BITS = 10  # of the hash, for each of the two levels of ranges


def _keyed(docs: DataFrame, seed: int) -> DataFrame:
    return docs.withColumns(
        {
            "__mix_size": n_words(F.col("text")),
            "__mix_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)).cast("long")),
            "__mix_text": F.xxhash64("text"),
        }
    ).withColumns(
        {
            "__mix_u": F.xxhash64(F.lit(seed), F.col("__mix_id"), F.col("__mix_text")),
        }
    ).withColumn("__mix_bin", F.shiftright("__mix_u", 64 - 2 * BITS))


def water_fill(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """Targets of sources. sizes: (source, source_size), one row per source.

    Each round is one sum over the sources that are under the level, and clamps
    those that the new level would lift over their caps; clamped ones stay so.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    order = [F.col("source").asc_nulls_last()]
    rows = stored(ranked(sizes.select("source", "source_size"), order, "rank", "mix-ranks").select("source", "source_size", weight.alias("weight"), (F.col("source_size") * F.lit(float(max_epochs))).alias("cap")), "mix-weights")
    level, seen = None, -1
    while True:
        free = F.lit(True) if level is None else F.col("cap") / F.col("weight") > F.lit(level)
        words, held, heavy, clamped = rows.agg(F.sum("source_size"), F.sum(F.when(~free, F.col("cap"))), F.sum(F.when(free, F.col("weight"))), F.count_if(~free)).first()
        if clamped == seen or not heavy:
            break
        seen, level = clamped, (words * float(share) - (held or 0.0)) / heavy
    lifted = F.col("cap") if not heavy else F.least("cap", F.col("weight") * F.lit(level))
    return rows.select("source", "source_size", "weight", lifted.alias("target"))


def _edges(bins: DataFrame, rooms: DataFrame) -> DataFrame:
    """(source, edge, room): the bin in which a source's words reach its room, and what of the room is left there.

    bins: (source, bin, words); rooms: (__room_source, room), the room over 0.
    """
    run = Window.partitionBy("source").orderBy("bin")
    before = bins.withColumn("before", F.sum("words").over(run) - F.col("words"))
    inside = (F.col("room") > 0) & (F.col("before") <= F.col("room")) & (F.col("room") < F.col("before") + F.col("words"))
    return before.join(rooms, F.col("source").eqNullSafe(F.col("__room_source"))).where(inside).select("source", F.col("bin").alias("edge"), (F.col("room") - F.col("before")).alias("room"))


def source_plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """One row per source: target, whole repetitions, and where the fractional one ends."""
    light = stored(_keyed(docs, seed).select("source", "__mix_size", "__mix_u", "__mix_id", "__mix_text", "__mix_bin"), "mix-sizes")
    coarse = F.shiftright("__mix_bin", BITS)
    bins = light.groupBy("source", coarse.alias("bin")).agg(F.sum("__mix_size").alias("words"))
    targets = water_fill(bins.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs)
    plan = targets.withColumn("whole", F.floor(F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)) + F.lit(1e-12)).cast("int")).withColumn(
        "rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))
    )
    first = stored(_edges(bins, plan.select(F.col("source").alias("__room_source"), F.col("rest").alias("room"))), "mix-edges")
    # the range in which the threshold falls, in as many finer ones
    near = light.join(first.select(F.col("source").alias("__room_source"), "edge"), F.col("source").eqNullSafe(F.col("__room_source")) & (coarse == F.col("edge")))
    fine = near.groupBy("source", F.col("__mix_bin").alias("bin")).agg(F.sum("__mix_size").alias("words"))
    edges = _edges(fine, first.select(F.col("source").alias("__room_source"), F.nullif("room", F.lit(0.0)).alias("room")))
    # words that fill the coarse range's beginning exactly: nothing of it is taken
    exact = first.where("room = 0").select("source", F.shiftleft("edge", BITS).alias("edge"), "room")
    edges = edges.unionAll(exact).withColumnRenamed("source", "__room_source")
    plan = stored(plan.join(edges, F.col("source").eqNullSafe(F.col("__room_source")), "left").drop("__room_source"), "mix-plan")
    units = (
        light.withColumnRenamed("source", "__mix_source")
        .join(plan.select("source", "edge", "room"), F.col("__mix_source").eqNullSafe(F.col("source")) & (F.col("__mix_bin") == F.col("edge")))
        .groupBy("source", "room", *UNIT)
        .agg(F.count("*").alias("of"), F.first("__mix_size").alias("size"))
    )
    before = F.sum(F.col("of") * F.col("size")).over(Window.partitionBy("source").orderBy(*UNIT)) - F.col("of") * F.col("size")
    taken = F.least(F.col("of"), F.greatest(F.lit(0), F.floor(F.coalesce(F.try_divide(F.col("room") - before, "size"), F.when(before < F.col("room"), F.col("of")), F.lit(0)) + F.lit(0.5)))).cast("long")
    last = (
        units.withColumn("part", taken)
        .where("room > 0 and part > 0")
        .groupBy("source")
        .agg(F.max(F.struct(F.struct(*UNIT).alias("unit"), "part", "of")).alias("last"))
        .withColumnRenamed("source", "__mix_source")
    )
    return stored(
        plan.join(last, F.col("__mix_source").eqNullSafe(F.col("source")), "left").select(
            F.col("source").alias("__mix_source"), F.col("source_size").alias("__mix_total"), F.col("target").alias("__mix_target"), F.col("whole").alias("__mix_whole"),
            F.col("edge").alias("__mix_edge"), F.col("last.unit").alias("__mix_last"), F.col("last.part").alias("__mix_part"), F.col("last.of").alias("__mix_of"),
        ),
        "mix-last",
    )


def assign(docs: DataFrame, plan: DataFrame, seed: int = SEED) -> DataFrame:
    """``docs`` with __mix_size, __mix_total, __mix_target and __mix_copies. plan: of ``source_plan``, which is stored."""
    here = F.struct(*UNIT)
    more = (F.col("__mix_bin") < F.col("__mix_edge")) | ((F.col("__mix_bin") == F.col("__mix_edge")) & F.coalesce(here <= F.col("__mix_last"), F.lit(False)))
    rows = _keyed(docs, seed).join(plan, F.col("source").eqNullSafe(F.col("__mix_source")))
    own = ("__mix_source", "__mix_whole", "__mix_edge", "__mix_last", "__mix_part", "__mix_of", *UNIT, "__mix_bin")
    copies = lambda df, some: df.withColumn("__mix_copies", F.col("__mix_whole") + F.coalesce(some, F.lit(False)).cast("int"))
    if plan.where("__mix_part < __mix_of").isEmpty():
        return copies(rows, more).drop(*own)
    # units of which some rows are taken: these are numbered
    parted = F.coalesce((F.col("__mix_part") < F.col("__mix_of")) & (here == F.col("__mix_last")), F.lit(False))
    some = ranked(rows.where(parted).withColumn("__mix_any", F.rand(seed)), ["__mix_source", "__mix_any"], "__mix_at", "mix-parted").drop("__mix_any")
    first = some.groupBy(F.col("__mix_source").alias("__mix_of_source")).agg(F.min("__mix_at").alias("__mix_first"))
    some = some.join(first, F.col("__mix_source").eqNullSafe(F.col("__mix_of_source")))
    some = copies(some, F.col("__mix_at") - F.col("__mix_first") < F.col("__mix_part")).drop("__mix_at", "__mix_first", "__mix_of_source", *own)
    return copies(rows.where(~parted), more).drop(*own).unionByName(some)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_epochs: float = MAX_EPOCHS, seed: int = SEED) -> DataFrame:
    """The mixture itself: every document as often as it is taken, columns of ``docs``."""
    rows = docs.select("doc_id", "text", "source", F.struct("*").alias("__mix_row"))
    out = assign(rows, source_plan(rows, weights, share, max_epochs, seed), seed).where("__mix_copies > 0")
    return out.select("__mix_row", F.explode(F.sequence(F.lit(1), F.col("__mix_copies"))).alias("__mix_copy")).select("__mix_row.*")


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return assign(docs, source_plan(docs)).select(
        "doc_id", F.col("__mix_size").alias("size"), F.col("__mix_total").alias("source_size"), F.col("__mix_target").alias("target"),
        (F.col("__mix_size") * F.col("__mix_copies")).alias("taken"),
    )
