"""SimHash near-duplicates through a byte-position inverted index.

A 64-bit fingerprint is eight positional bytes. Two fingerprints that differ
in at most ``max_bits`` bits agree in at least ``8 - max_bits`` of them, the
guaranteed minimum of matches. Postings are keyed by the values of several
positions at once: the eight positions form ``max_bits + 2`` blocks, at most
``max_bits`` of which can differ, so such a pair meets in the posting of some
two blocks (six keys of four bytes each for two bits). Within a posting the
shared positional bytes of each pair are tallied, pairs that reach the minimum
are kept and verified by their differing bits, and what is emitted is a
spanning forest: no more links than members.

Copies are one index entry, as the index holds distinct fingerprints. A posting
of over ``CAP`` entries (a large family of near copies) is never gathered: its
members go to postings of all ``8 - max_bits`` agreeing positions, which hold
the minimum by construction and, with two bits, at most 65,536 fingerprints.
There partners are looked up by flipping bits of the free positions, in time
linear in the members.

Defined cases: null or empty text has fingerprint zero and is linked like any
other; texts of fewer words than a shingle are one shingle; a null id gets a
class id only from documents with ids; repeated rows stay; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table, utf8
from .graph import components

SEED = 42
CAP = 1024
PAIRWISE = 256  # members up to which pairs are tallied at once


def votes(hashes: np.ndarray, counts: np.ndarray, block: int = 6) -> np.ndarray:
    """How often each bit is set, per document. hashes: (n, w) words of 64 bits; counts: rows per document.

    Rows are added in blocks of 2^block as bit planes: each plane holds one
    binary digit of 64 counters, and a pair of rows is added plane by plane.
    """
    size = -(-counts >> block) << block
    start = np.cumsum(size) - size
    rows = np.zeros((int(size.sum()), hashes.shape[1]), np.uint64)
    rows[np.arange(len(hashes)) + np.repeat(start - np.cumsum(counts) + counts, counts)] = hashes
    planes = [rows]
    for _ in range(block):
        carry, out = np.uint64(0), []
        for p in planes:
            a, b = p[::2], p[1::2]
            differ = a ^ b
            out.append(differ ^ carry)
            carry = (a & b) | (differ & carry)
        planes = [*out, carry]
    total = np.zeros((len(rows) >> block, 64 * hashes.shape[1]), np.int32)
    for k, p in enumerate(planes):
        total += np.unpackbits(np.ascontiguousarray(p).astype(">u8").view(np.uint8).reshape(len(total), -1), axis=1).astype(np.int32) << k
    return np.add.reduceat(total, start >> block, axis=0)


def majority(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Fingerprints as big-endian bytes; a bit is 1 if set in over half the rows. Documents without rows have zero."""
    out = np.zeros((len(counts), 8 * hashes.shape[1]), np.uint8)
    some = np.flatnonzero(counts)
    edges = np.concatenate([[0], np.cumsum(counts[some])])
    at = 0
    while at < len(some):  # so many documents that their counters fit in some MB
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + 100_000, "right")) - 1)
        n = counts[some[at:to]]
        out[some[at:to]] = np.packbits(2 * votes(hashes[edges[at] : edges[to]], n) > n[:, None], axis=1)
        at = to
    return out


def fingerprint_batch(texts: list[bytes], words: int) -> np.ndarray:
    """Fingerprints of texts; a bit is 1 if set in over half the shingle hashes."""
    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for text in texts:
        parts = text.lower().split()
        flat = b" ".join(parts)
        starts, at = [], 0
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        if not parts:
            counts.append(0)
        elif len(parts) <= words:
            hashes.append(digest(flat, SEED))
            counts.append(1)
        else:
            ends = starts[words:]
            hashes += [digest(flat[a : z - 1], SEED) for a, z in zip(starts, ends, strict=False)]
            hashes.append(digest(flat[starts[-words] :], SEED))
            counts.append(len(parts) - words + 1)
    got = majority(np.array(hashes, np.uint64).reshape(-1, 1), np.array(counts, np.int64))
    return got.view(">u8")[:, 0].astype(np.uint64)


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = fingerprint_batch(utf8(b.column("text")), words)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): a 64-bit SimHash over shingles of ``words`` words, repeats included."""
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_fingerprints(words), "doc_id long, fp long")


def _mask(positions) -> int:
    m = sum(0xFF << (8 * p) for p in positions)
    return m - (1 << 64) if m >> 63 else m


def block_masks(max_bits: int) -> list[int]:
    """Masks of any two of ``max_bits + 2`` blocks of the eight positions."""
    blocks = np.array_split(np.arange(8), max_bits + 2)
    return [_mask([*x.tolist(), *y.tolist()]) for x, y in combinations(blocks, 2)]


def _flips(mask: int, max_bits: int) -> np.ndarray:
    """All differences of 1 to ``max_bits`` bits outside ``mask``."""
    free = [b for b in range(64) if not (mask >> b) & 1]
    return np.array([sum(1 << b for b in c) for k in range(1, max_bits + 1) for c in combinations(free, k)], np.uint64)


def forest(fps: np.ndarray, mask: int, max_bits: int) -> np.ndarray:
    """(root, member) links that connect what verified pairs connect. fps: distinct, sorted."""
    m = len(fps)
    if m <= PAIRWISE:
        own = fps.view(np.uint8).reshape(m, 8)
        tally = (own[:, None, :] == own[None, :, :]).sum(2)
        u, v = np.nonzero(np.triu(tally >= 8 - max_bits, 1))
        near = np.bitwise_count(fps[u] ^ fps[v]) <= max_bits
        u, v = u[near], v[near]
    else:
        found = []
        for flip in _flips(mask, max_bits):
            there = fps ^ flip
            k = np.minimum(np.searchsorted(fps, there), m - 1)
            hit = np.flatnonzero((fps[k] == there) & (fps < there))
            found.append(np.stack([hit, k[hit]]))
        u, v = np.concatenate(found, 1)
    label = np.arange(m)
    while True:
        low = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], low)
        np.minimum.at(new, label[v], low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(m))
    return np.stack([fps[label[member]], fps[member]], 1)


def _links(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            members = b.column("members")
            values, cuts = np.asarray(members.flatten()), members.offsets.to_numpy()
            cuts, found = cuts - cuts[0], [np.zeros((0, 2), np.uint64)]
            for mask, a, z in zip(b.column("mask").to_pylist(), cuts[:-1], cuts[1:], strict=True):
                found.append(forest(np.unique(values[a:z].view(np.uint64)), mask & (2**64 - 1), max_bits))
            pairs = np.concatenate(found).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    return run


def _postings(distinct: DataFrame, masks: list[int]) -> DataFrame:
    keys = F.array(*[F.lit(m).cast("long") for m in masks])
    return distinct.select("fp", F.explode(keys).alias("mask")).select("fp", "mask", F.col("fp").bitwiseAND(F.col("mask")).alias("key"))


def links(distinct: DataFrame, max_bits: int = 2, cap: int = CAP) -> DataFrame:
    """Links (a, b) that connect all pairs of distinct fingerprints within ``max_bits`` bits."""
    small_batches(distinct.sparkSession)
    posts = _postings(distinct, block_masks(max_bits))
    sizes = stored(posts.groupBy("mask", "key").agg(F.count("*").alias("n")).where("n > 1"), "simhash-sizes")
    gather = lambda p: p.groupBy("mask", "key").agg(F.collect_list("fp").alias("members")).where("size(members) > 1").select("mask", "members")
    usual = gather(posts.join(sizes.where(F.col("n") <= cap).drop("n"), ["mask", "key"], "left_semi"))
    dense = posts.join(sizes.where(F.col("n") > cap).drop("n"), ["mask", "key"], "left_semi").select("fp").distinct()
    full = [_mask(p) for p in combinations(range(8), 8 - max_bits)]
    refined = gather(_postings(dense, full))
    return usual.unionAll(refined).mapInArrow(_links(max_bits), "a long, b long")


def classes(prints: DataFrame, max_bits: int = 2) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``prints`` (doc_id, fp)."""
    reps = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-reps")
    roots = components(links(reps.select("fp"), max_bits))
    rooted = stored(reps.join(roots, reps.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    lowest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(lowest, "root").select(F.col("fp").alias("named"), "component_id")
    return prints.join(named, prints.fp == named.named).select("doc_id", "fp", "component_id")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = stored(fingerprints(table(spark, sf_dir, "documents")), "simhash-prints")
    return classes(prints).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
