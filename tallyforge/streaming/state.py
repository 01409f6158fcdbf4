"""The duplicate search of a stream as keyed state that is never evicted.

A batch's rows become events by their key: one for the content hashes of a shard
that a partition has, packed in lists, as each event costs Python as much as a few
dozen hashes in it; and of the first row of each (name, amount) in a partition one for each word of the name, in
the amount's bucket and in a neighbour that its band reaches into. Events meet in
``transformWithState``, so a batch reads and writes the state of its own keys only,
in the state store that the checkpoint holds; no table of earlier rows is read.
Kept are the first row of each hash (a group holds the hashes of one shard), and
per bucket and word the first row of each (name, amount): only these can be the
earliest match. The state answers once for a hash that recurs and once for a name
and amount; rows find their matches there by a join, and look at rows of a lower
``seq`` alone, so rows of one batch see each other as if they had come one by one.

A shard's hashes are a map, of which a batch reads its own keys; each is a call out
of Python. Hashes that many came with at once stay packed in a list instead, which
goes in a few calls. The list is read whole, and becomes part of the map when it is
longer than ``SCAN`` times the hashes that a batch brings: so what a batch reads goes
by the batch, and a packed hash is moved once at most.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..config import DEFAULT, Config
from ..functions.sequence import score
from ..functions.similarity import name_tokens
from ..functions.text import strip
from ..operators.duplicates import usable, with_nearest

FIRST = "seq long, invoice_id string"
PACKED = "hashes array<string>, seqs array<long>, ids array<string>"
SHARDS = 4096  # of hashes; a shard's map is read by its keys, never whole
FEW = 4  # hashes of a shard in a batch that go to its map by themselves
SCAN = 16  # times a batch's hashes of a shard that its list may hold; a read entry costs far less than a call
PACK = 5_000  # hashes of one entry of the list
HELD = 200_000  # rows of a partition that wait to be packed, or names and amounts for their first row
WIDTH = 0.2  # of a bucket of amounts; its edges lie between cents
NEAR = "vendor_name string, words string, folded string, total double, seq long, invoice_id string, day int"
KIND = "seq long, invoice_id string, vendor_name string, total double, day int"
FOUND = "content_hash string, seq long, invoice_id string, vendor_name string, total double, near array<struct<order: int, seq: long, invoice_id: string, day: int>>"
#: The state store: one that reads by key, and whose checkpoints hold a batch's changes, not the whole state.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def _packed(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    lists = pa.Table.from_batches(held).group_by("key", use_threads=False).aggregate([("content_hash", "list"), ("seq", "list"), ("invoice_id", "list")])
    names = ["key", "hashes", "seqs", "ids"]
    yield from lists.select(["key", "content_hash_list", "seq_list", "invoice_id_list"]).rename_columns(names).to_batches()


def packed_rows(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of a shard, of some ``HELD`` of a partition, as one of ``PACKED``."""
    held: list[pa.RecordBatch] = []
    for part in parts:
        held.append(part)
        if sum(x.num_rows for x in held) >= HELD:
            yield from _packed(held)
            held = []
    if held:
        yield from _packed(held)


def _earliest(held: list[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(held).sort_values("seq").drop_duplicates(["vendor_name", "total"])


def first_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The first row of each (name, amount) of a partition; of one with very many, some come more than once."""
    held: list[pd.DataFrame] = []
    for part in parts:
        held.append(_earliest([part]))
        if sum(map(len, held)) > HELD:
            held = [_earliest(held)]
            if len(held[0]) > HELD // 2:
                yield held.pop()
    if held:
        yield _earliest(held)


def events(df: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """The events of rows (seq, invoice_id, content_hash, vendor_name, total, invoice_date), by ``key``."""
    own = ("seq", "invoice_id")
    shard = F.pmod(F.xxhash64("content_hash"), F.lit(SHARDS)).cast("string")
    hashes = df.where("content_hash is not null").select(F.concat(F.lit("h|"), shard).alias("key"), *own, "content_hash")
    hashes = hashes.mapInArrow(packed_rows, f"key string, {PACKED}")
    kinds = usable(df).select(*own, "vendor_name", F.col("total").cast("double").alias("total"), F.unix_date("invoice_date").alias("day")).mapInPandas(first_rows, KIND)
    named = kinds.select("*", F.lower(strip(F.col("vendor_name"))).alias("folded"), name_tokens(F.col("vendor_name")).alias("tokens"))
    worded = config.name_similarity == "tokens" and config.vendor_threshold > 0
    words = F.when(F.size("tokens") > 0, F.col("tokens")).otherwise(F.array(F.lit(""))) if worded else F.array(F.lit(""))
    width = max(WIDTH, 4 * config.amount_tolerance)
    bucket = lambda by: F.floor((F.col("total") + F.lit(by + 0.505 * width)) / F.lit(width))
    reach = 1.001 * config.amount_tolerance + 1e-6  # a little over the band: amounts are compared as doubles
    around = F.array_distinct(F.array(bucket(0.0), bucket(-reach), bucket(reach)))
    spread = named.withColumn("token", F.explode(words)).withColumn("at", F.explode(around))
    kind = F.struct("vendor_name", F.array_join("tokens", " ").alias("words"), "folded", "total", "day", (F.col("at") == bucket(0.0)).alias("probe"))
    near = spread.select(F.concat(F.lit("n|"), F.col("at").cast("string"), F.lit("|"), "token").alias("key"), *own, kind.alias("kind"))
    return near.unionByName(hashes, allowMissingColumns=True)


@lru_cache(maxsize=100_000)
def _tokens_alike(a: str, b: str, a_folded: str, b_folded: str) -> int:
    """The token similarity, from names' words and their small letters."""
    s, t = set(a.split()), set(b.split())
    if not s or not t:
        return 100 if a_folded == b_folded else 0
    share = len(s & t) / len(s | t)
    return int(min(100.0, 70.0 + 30.0 * share)) if len(s & t) == min(len(s), len(t)) else int(100.0 * share)


class Matcher(StatefulProcessor):
    """Answers events of a key from what the key has seen, and remembers their rows."""

    def __init__(self, config: Config = DEFAULT):
        self.config = config

    def init(self, handle) -> None:
        self.first = handle.getMapState("first", "content_hash string", FIRST)
        self.packed = handle.getListState("packed", PACKED)
        self.near = handle.getListState("near", NEAR)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        return self._same(rows) if key[0].startswith("h|") else self._alike(rows)

    def _same(self, rows) -> Iterator[Row]:
        """The first row of each hash that the shard had already, or that several rows have."""
        batch: dict[str, tuple] = {}
        often = set()
        for value, *one in (x for r in rows for x in zip(r.hashes, r.seqs, r.ids)):
            old = batch.get(value)
            if old:
                often.add(value)
            if not old or one[0] < old[0]:
                batch[value] = tuple(one)
        listed: dict[str, tuple] = {}
        for hashes, seqs, ids in self.packed.get():
            for value, *one in zip(hashes, seqs, ids):
                if value not in listed or one[0] < listed[value][0]:
                    listed[value] = tuple(one)
        mapped = self.first.exists()
        fresh: dict[str, tuple] = {}
        for value, one in batch.items():
            # the list is later than the map, and has a hash of the map only with an earlier row
            known = listed.get(value) or (mapped and self.first.getValue((value,)))
            if not known or one[0] < known[0]:
                fresh[value] = one
            if known or value in often:
                yield Row(content_hash=value, **dict(zip(("seq", "invoice_id"), fresh.get(value) or known)), vendor_name=None, total=None, near=None)
        if len(batch) >= FEW and len(listed) + len(fresh) <= SCAN * len(batch):
            new = list(fresh.items())
            packs = [new[k : k + PACK] for k in range(0, len(new), PACK)]
            if packs:
                self.packed.appendList([([h for h, _ in p], [x[0] for _, x in p], [x[1] for _, x in p]) for p in packs])
        else:
            for value, one in {**listed, **fresh}.items():
                self.first.updateValue((value,), one)
            if listed:
                self.packed.clear()

    def _similarity(self, a, b) -> int:
        if self.config.name_similarity == "sequence":
            return score(a[0], b[0])
        return _tokens_alike(a[1], b[1], a[2], b[2])

    def _alike(self, rows) -> Iterator[Row]:
        """Rows of state are (vendor_name, words, folded, total, seq, invoice_id, day); a later one of a (name, amount) may be earlier."""
        firsts: dict[tuple, tuple] = {}
        for x in self.near.get():
            kind = (x[0], x[3])
            if kind not in firsts or x[4] < firsts[kind][4]:
                firsts[kind] = tuple(x)
        changed: dict[tuple, tuple] = {}
        probes = set()
        for r in rows:
            x = r.kind
            kind = (x["vendor_name"], x["total"])
            if kind not in firsts or r.seq < firsts[kind][4]:
                firsts[kind] = changed[kind] = (x["vendor_name"], x["words"], x["folded"], x["total"], r.seq, r.invoice_id, x["day"])
            if x["probe"]:
                probes.add(kind)
        if changed:
            self.near.appendList(list(changed.values()))
        for kind in probes:
            own, best = firsts[kind], {}
            for x in firsts.values():
                if abs(own[3] - x[3]) <= self.config.amount_tolerance:
                    s = self._similarity(own, x)
                    if s >= self.config.vendor_threshold and (s not in best or x[4] < best[s]["seq"]):
                        best[s] = {"order": -s, "seq": x[4], "invoice_id": x[5], "day": x[6]}
            if best:
                yield Row(content_hash=None, seq=None, invoice_id=None, vendor_name=kind[0], total=kind[1], near=list(best.values()))


def found(stream: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Of hashes that recur the first row, and per (name, amount) and word, of each similarity, the first row."""
    return events(stream, config).groupBy("key").transformWithState(Matcher(config), FOUND, "append", "none")


def with_found(rows: DataFrame, answers: DataFrame, config: Config = DEFAULT) -> DataFrame:
    """Rows of a batch with ``MATCHES`` from what ``found`` gave for it."""
    firsts = answers.where("content_hash is not null").select(F.col("content_hash").alias("__hash"), F.col("seq").alias("__first"), F.col("invoice_id").alias("__id"))
    exact = rows.join(firsts, F.col("content_hash") == F.col("__hash"), "left")
    exact = exact.withColumn("exact_match", F.when(F.col("__first") < F.col("seq"), F.col("__id"))).drop("__hash", "__first", "__id")
    # ordered by similarity, then seq, as with_nearest reads them; words of one name may say the same twice
    one = lambda x: F.struct(x["order"].alias("order"), x["seq"].alias("seq"), x["invoice_id"].alias("invoice_id"), F.date_from_unix_date(x["day"]).alias("invoice_date"), (-x["order"]).alias("similarity"))
    every = F.sort_array(F.array_distinct(F.transform(F.flatten(F.collect_list("near")), one)))
    near = answers.where("vendor_name is not null").groupBy(F.col("vendor_name").alias("__name"), F.col("total").alias("__total")).agg(every.alias("__near"))
    best = with_nearest(exact, near, config)
    fuzzy = F.col("exact_match").isNull()
    named = {"matched_invoice_id": F.col("__best.invoice_id"), "similarity": F.col("__best.similarity"), "date_match": F.col("__close")}
    return best.withColumns({k: F.when(fuzzy, v) for k, v in named.items()}).drop("__best", "__close")
