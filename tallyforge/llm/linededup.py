"""Line dedup through a sharded minimal perfect hash.

A line's key is the line without blanks at its ends, A-Z in lower case. Keys of
``MIN_CHARS`` code points or more are hashed to 128 bits on the JVM and counted
over the documents that hold them, map side first. The distinct hashes of keys
in ``MIN_DOCS`` documents or more are dealt to shards by their bits; one task a
shard builds a minimal perfect hash over them and writes three compact arrays
in its order: 64-bit fingerprints, document counts, and the largest document id.
A key in fewer documents can never lose a line, so it takes no room in the index;
a probe of it lands on a slot whose fingerprint is another (but for a chance of
2^-64 a line).

Documents probe the arrays: no line is joined. Their line hashes go to Python as
plain integers, texts stay on the JVM. A task holds at most ``CACHE_MB`` of
shards; where the index is larger it gathers ``HELD_LINES`` lines first and goes
through the shards one after the other, so memory doesn't grow with the index.

The hash: level after level, keys fall on a bit table of ``GAMMA`` bits a key;
those alone on their bit stay, the others go to the next level. A key's slot is
the number of bits set before its own.

Defined cases: null or empty text is one empty line; every row is a document, so
repeated rows count each; of rows that share the largest id all keep their
lines; a null id is below every other; short lines always stay; an empty table
gives an empty result; extra columns are passed on by ``deduplicate``.
"""

from __future__ import annotations

import io
from collections import OrderedDict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_path, publish, small_batches, stored, table

MIN_CHARS = 40
MIN_DOCS = 5
BLANKS = " \t\n\x0b\x0c\r"
SEED = 7919
SHARD_KEYS = 1 << 18
GAMMA = 2.0
CACHE_MB = 192
HELD_LINES = 1 << 21
NO_ID = -(2**63)
_GOLD, _M1, _M2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _mixed(x: np.ndarray) -> np.ndarray:
    """64 bits mixed so that each depends on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M1)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M2)
    return x ^ (x >> np.uint64(31))


def _place(a: np.ndarray, b: np.ndarray, level: int, size: int) -> np.ndarray:
    """Where keys fall on a level's table; both halves of a key count."""
    salt = np.uint64((level + 1) * _GOLD % 2**64)
    return _mixed(a ^ _mixed(b + salt)) % np.uint64(size)


class PerfectHash:
    """Slots 0 to n - 1 for n distinct 128-bit keys, given as two arrays of 64 bits."""

    def __init__(self, bits: np.ndarray, sizes: np.ndarray):
        """bits: 64-bit words of all levels' tables, one after the other; sizes: bits of each level, multiples of 64."""
        self.bits, self.sizes = bits, sizes
        ones = np.bitwise_count(bits).astype(np.int64)
        self.before = np.cumsum(ones) - ones

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, gamma: float = GAMMA) -> PerfectHash:
        tables, sizes = [], []
        while len(a):
            size = -(-int(gamma * len(a)) // 64) * 64 or 64
            at = _place(a, b, len(sizes), size).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            tables.append(np.packbits(alone, bitorder="little").view("<u8"))
            sizes.append(size)
            left = ~alone[at]
            a, b = a[left], b[left]
        return cls(np.concatenate([np.zeros(0, "<u8"), *tables]), np.array(sizes, np.int64))

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A slot for each key: its own if it is one of those built on, else any, or -1."""
        out, todo, first = np.full(len(a), -1, np.int64), np.arange(len(a)), 0
        for level, size in enumerate(self.sizes.tolist()):
            at = _place(a[todo], b[todo], level, size).astype(np.int64) + first
            word, bit = self.bits[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit & np.uint64(1)).astype(bool)
            low = word[hit] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            out[todo[hit]] = self.before[at[hit] >> 6] + np.bitwise_count(low)
            todo, first = todo[~hit], first + size
        return out


class Shard:
    """A perfect hash with a fingerprint, a document count and the largest id for each of its keys."""

    def __init__(self, bits, sizes, prints, counts, owners):
        self.hash, self.prints, self.counts, self.owners = PerfectHash(bits, sizes), prints, counts, owners
        self.nbytes = sum(x.nbytes for x in (bits, self.hash.before, prints, counts, owners))

    @classmethod
    def build(cls, a, b, counts, owners) -> Shard:
        mph = PerfectHash.build(a, b)
        order = np.argsort(mph.slots(a, b))
        counts = counts[order]
        return cls(mph.bits, mph.sizes, b[order], counts.astype(np.min_scalar_type(int(counts.max(initial=0)))), owners[order])

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, bits=self.hash.bits, sizes=self.hash.sizes, prints=self.prints, counts=self.counts, owners=self.owners)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data) -> Shard:
        with np.load(io.BytesIO(data)) as f:
            return cls(*(f[k] for k in ("bits", "sizes", "prints", "counts", "owners")))

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, largest id) of each key; a key that isn't here has count 0."""
        slot = self.hash.slots(a, b)
        known = slot >= 0
        known[known] = self.prints[slot[known]] == b[known]
        counts, owners = np.zeros(len(a), np.int64), np.full(len(a), NO_ID, np.int64)
        counts[known], owners[known] = self.counts[slot[known]], self.owners[slot[known]]
        return counts, owners


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(F.btrim(line, F.lit(BLANKS)), upper, upper.lower())


def _hashed(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(SEED), key).alias("b"))


def _shard_of(a, n: int):
    return (a >> np.uint64(24)) % np.uint64(n)


def repeated_keys(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(a, b, n_docs, owner): hashes of keys in at least ``min_docs`` documents, and the largest id that holds each; stored."""
    keys = F.array_distinct(F.filter(F.transform(lines_of(F.col("text")), line_key), lambda k: F.length(k) >= min_chars))
    each = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), F.explode(keys).alias("key"))
    counted = each.select("id", F.inline(F.array(_hashed(F.col("key"))))).groupBy("a", "b").agg(F.count("*").alias("n_docs"), F.max("id").alias("owner"))
    return stored(counted.where(F.col("n_docs") >= min_docs), "line-keys")


def _path(root: str, shard: int) -> str:
    return f"{root}/shard-{shard:06d}.npz"


def _shard_writer(base: str) -> Callable[[pa.Table], pa.Table]:
    def write(rows: pa.Table) -> pa.Table:
        fs, root = pafs.FileSystem.from_uri(base)
        a, b = (np.asarray(rows.column(c)).view(np.uint64) for c in ("a", "b"))
        shard = Shard.build(a, b, np.asarray(rows.column("n_docs")), np.asarray(rows.column("owner")))
        k = rows.column("shard")[0].as_py()
        temp = f"{root}/.shard-{k}-{TaskContext.get().taskAttemptId()}"
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(temp) as out:
            out.write(shard.to_bytes())
        publish(fs, temp, _path(root, k))
        return pa.table({"shard": [k], "n_keys": [len(a)]}, schema=pa.schema([("shard", pa.int64()), ("n_keys", pa.int64())]))

    return write


def build_index(keys: DataFrame, base: str, shard_keys: int = SHARD_KEYS) -> tuple[int, DataFrame]:
    """Write the shards of an index over ``repeated_keys`` under ``base``: their number, and (shard, n_keys), one row a shard."""
    n = max(1, -(-keys.count() // shard_keys))
    bits = F.shiftrightunsigned("a", 24)
    dealt = keys.withColumn("shard", F.pmod(bits, F.lit(n)).cast("long"))
    return n, stored(dealt.groupBy("shard").applyInArrow(_shard_writer(base), "shard long, n_keys long"), "line-shards")


class Index:
    """Looks up keys in the shards of an index, with a bounded number of them in memory."""

    def __init__(self, base: str, n: int, there: set[int], cache_mb: int = CACHE_MB):
        self.fs, self.root = pafs.FileSystem.from_uri(base)
        self.n, self.there, self.room = n, there, cache_mb << 20
        self.held: OrderedDict[int, Shard] = OrderedDict()

    def shard(self, k: int) -> Shard:
        if k not in self.held:
            with self.fs.open_input_file(_path(self.root, k)) as f:
                got = Shard.from_bytes(f.read())
            while self.held and got.nbytes + sum(s.nbytes for s in self.held.values()) > self.room:
                self.held.popitem(last=False)
            self.held[k] = got
        self.held.move_to_end(k)
        return self.held[k]

    def look(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        counts, owners = np.zeros(len(a), np.int64), np.full(len(a), NO_ID, np.int64)
        where = _shard_of(a, self.n).astype(np.int64)
        order = np.argsort(where, kind="stable")
        kinds, first = np.unique(where[order], return_index=True)
        for k, at in zip(kinds.tolist(), np.split(order, first[1:]), strict=True):
            if k in self.there:
                counts[at], owners[at] = self.shard(k).look(a[at], b[at])
        return counts, owners


def _held(batches: Iterator[tuple[pa.Array, pa.Array]], lines: int) -> Iterator[list[tuple[pa.Array, pa.Array]]]:
    some, total = [], 0
    for keys, ids in batches:
        some.append((keys, ids))
        total += len(keys.values)
        if total >= lines:
            yield some
            some, total = [], 0
    if some:
        yield some


def _prober(base: str, n: int, there: set[int], min_docs: int, cache_mb: int, lines: int):
    def probe(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        index = Index(base, n, there, cache_mb)
        for some in _held(batches, lines):
            flat = [keys.flatten() for keys, _ in some]
            a, b = (np.concatenate([np.asarray(pc.fill_null(x.field(k), 0)).view(np.uint64) for x in flat]) for k in (0, 1))
            long = np.concatenate([np.asarray(x.is_valid()) for x in flat])
            id_of = np.concatenate([np.repeat(np.asarray(ids), np.diff(np.asarray(keys.offsets))) for keys, ids in some])
            drop = np.zeros(len(a), bool)
            counts, owners = index.look(a[long], b[long])
            drop[long] = (counts >= min_docs) & (owners != id_of[long])
            at = 0
            for keys, _ in some:
                offsets = np.asarray(keys.offsets)
                offsets = offsets - offsets[0]
                yield pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(drop[at : at + offsets[-1]]))
                at += int(offsets[-1])

    def typed(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from probe(batches)

    return typed


def judged(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS, cache_mb: int = CACHE_MB, held_lines: int = HELD_LINES) -> DataFrame:
    """(row, lines, dropped): each row of ``docs`` as a struct, its lines, and for each line whether it goes."""
    spark = docs.sparkSession
    small_batches(spark)
    base = fresh_path(spark, "line-index")
    n, shards = build_index(repeated_keys(docs, min_chars, min_docs), base, shard_keys)
    there = {r.shard for r in shards.select("shard").collect()}  # a number a shard: one for each shard_keys keys
    small = len(there) * 24 * shard_keys <= cache_mb << 20
    probe = F.arrow_udf(_prober(base, n, there, min_docs, cache_mb, 1 if small else held_lines), "array<boolean>")
    keys = F.transform(F.transform(lines_of(F.col("text")), line_key), lambda k: F.when(F.length(k) >= min_chars, _hashed(k)))
    rows = docs.select(F.struct("*").alias("row"), keys.alias("keys"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), "text")
    return rows.withColumn("dropped", probe("keys", "id")).select("row", lines_of(F.col("text")).alias("lines"), "dropped")


def kept_text() -> Column:
    """The lines that stay of a row of ``judged``, joined."""
    return F.array_join(F.filter("lines", lambda line, k: ~F.get("dropped", k)), "\n")


def deduplicate(docs: DataFrame, **bounds) -> DataFrame:
    """``docs`` with the text of the lines that stay; bounds: see ``judged``."""
    return judged(docs, **bounds).select(F.col("row").withField("text", kept_text()).alias("row")).select("row.*")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "row.doc_id", F.size("lines").cast("long").alias("n_lines"), F.size(F.filter("dropped", lambda d: d)).cast("long").alias("n_dropped"), F.sha2(kept_text(), 256).alias("kept_sha256")
    )


ORACLE_SQL = """WITH l AS (SELECT doc_id, row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
 e AS (SELECT doc_id, r, generate_subscripts(lines, 1) AS k, unnest(lines) AS line FROM l),
 n AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
 c AS (SELECT key, max(doc_id) AS owner FROM n WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
 j AS (SELECT n.*, c.key IS NOT NULL AND c.owner IS DISTINCT FROM n.doc_id AS gone FROM n LEFT JOIN c ON n.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM j GROUP BY r, doc_id"""
