"""Near copies by a shingle similarity, found through wide SimHash fingerprints.

At a similarity of 0.8 two texts differ in too many bits for a fingerprint of
64. So the index takes 256 bits, 32 positional bytes, over pairs of words, which
an edit disturbs less than longer shingles. It has a posting for every two
positions side by side and the values there. Within a posting the shared
positional bytes of each pair are tallied; pairs that reach ``SHARED`` are
filtered by the bits in which second fingerprints, of 1024 bits over five words,
differ. Both are made of distinct shingles, so their share is the angle between
the texts' shingle sets and tells the Jaccard similarity up to about 0.03: 0.8
is 155 bits, give or take 12. Up to ``BITS`` bits the texts decide, by the
Jaccard similarity of their ``words``-word shingles; no pair is joined without
them. Words are compared in lower case.

A pair at the threshold that differs in scattered words shares about 15 of the
32 bytes and meets in some posting with a probability of 0.97; one that differs
in a single piece meets less often. So the index only shortens the work. What it
leaves is found exactly: a text's distinct shingles are ranked, rare ones first,
and of two similar texts the first fifth or so of each holds a common shingle
(prefix filter). Pairs that share one there, are not yet in one class and may be
similar by their sizes and places are compared on the texts. Texts that merely
have a passage in common would make pairs in the square of their number; so a
pair of ``FEW`` shingles or more each must also agree in 128 bits of the second
fingerprints but for ``APART``. At the threshold 19 differ, give or take 4, so a
similar pair fails this with a probability of about 10^-10.

What a posting gives is the spanning forest of its filtered pairs with the
fewest differing bits, so a family of any size gives links in proportion to its
size. A link that fails on the texts may have displaced a true one; its ends are
then in different classes, and the prefix filter gives all pairs across them. A
posting of over ``DENSE`` entries is divided by further positions; pairs it
no longer compares are the prefix filter's. That one compares blocks of all pairs.
Copies of a text are one entry of the index. Links of one text to very many are
verified in parts, each with a copy of that text.

Defined cases: null is an empty text; texts of fewer words than a shingle are
one shingle; texts without words are alike. Rows that share an id are documents each if their texts differ, in
the order of a hash of the text; rows without an id are documents like others
and come first; of rows equal in id and text the one that is least in all its
columns stays. An empty table gives an empty result; extra columns are passed on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors, rolling
from .common import larger, shares, small_batches, stored, utf8
from .graph import components
from .simhash import majority

POSITIONS = 32
SHARED = 5
LONG = 5  # words of the shingles of the second fingerprint
LONG_BYTES = 128
BITS = 186
DENSE = 1500
PAIRWISE = 64  # entries up to which all postings are compared together
HELD = 2_000_000  # pairs held before they are brought down to a forest
SAMPLE, COMMON = 10_000, 100_000  # texts that tell which shingles are common, and how many of these are kept
POSTING = np.dtype([("hash", "<u8"), ("id", "<i8"), ("root", "<i8"), ("size", "<i4"), ("place", "<i4"), ("bits", "<u8", (2,))])
FEW = 64  # shingles below which a pair of the prefix filter isn't held against fingerprints
APART = 48  # differing bits of 128 up to which it is compared on the texts
PART = 500  # texts that one copy of another is held against
WIDE = POSITIONS + LONG_BYTES
PACKED = 1 << 21  # bytes of entries that are packed by bucket at once
CHUNK = (1 << 19) - 1024
SALTS = rolling.mix(np.arange(1, 4 + LONG_BYTES // 8 + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
SMALL = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)


def _word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in lower case, and how many each text has."""
    buf, docs = rolling.joined(texts)
    start, end = rolling.words_of(buf)
    return rolling.Hashes(rolling.byte_values(SMALL[buf]))(start, end), np.diff(np.searchsorted(start, docs))


def _windows(words: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of n words, and how many each text has; a text of fewer words is one."""
    have = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    first = np.cumsum(counts) - counts
    at = np.repeat(first - np.cumsum(have) + have, have) + np.arange(have.sum())
    return rolling.Hashes(words)(at, at + np.repeat(np.minimum(counts, n), have)), have


def _distinct(hashes: np.ndarray, have: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, ascending, and how many it has."""
    text = np.repeat(np.arange(len(have)), have)
    order = np.lexsort((hashes, text))
    hashes, text = hashes[order], text[order]
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[first], np.bincount(text[first], minlength=len(have))


def wide_fingerprints(texts: list[bytes]) -> np.ndarray:
    """(n, 160) bytes per text: the index's 32 positions over pairs of words, then 128 over ``LONG`` words."""
    words, counts = _word_hashes(texts)
    out = []
    for n, salts in ((2, SALTS[:4]), (LONG, SALTS[4:])):
        hashes, have = _distinct(*_windows(words, counts, n))
        out.append(majority(rolling.mix(hashes[:, None] ^ salts), have))
    return np.concatenate(out, 1)


def prefixes(hashes: np.ndarray, size: np.ndarray, common: tuple[np.ndarray, np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's distinct shingles, rarest first, as many as hold one of any similar text; and how many.

    ``common`` has hashes, ascending, and their frequencies; others rank before them. Any order
    that is the same for all texts is right; this one keeps postings short.
    """
    rank = np.zeros(len(hashes), np.int64)
    if len(common[0]):
        at = np.minimum(np.searchsorted(common[0], hashes), len(common[0]) - 1)
        rank = np.where(common[0][at] == hashes, common[1][at], 0)
    text = np.repeat(np.arange(len(size)), size)
    order = np.lexsort((hashes, rank, text))
    many = np.where(size > 0, size - np.ceil(similarity * size - 1e-9).astype(np.int64) + 1, 0)
    place = np.arange(len(hashes)) - np.repeat(np.cumsum(size) - size, size)
    return hashes[order][place < many[text]], many


def _table(common: tuple[np.ndarray, np.ndarray], n: int, similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column("text"))
            for at, to in rolling.chunks([len(t) for t in texts], CHUNK):
                part = texts[at:to]
                digest = [hashlib.blake2b(t, digest_size=16).digest() for t in part]
                prints = [p.tobytes() for p in wide_fingerprints(part)]
                hashes, size = _distinct(*_windows(*_word_hashes(part), n))
                first, many = prefixes(hashes, size, common, similarity)
                cuts = np.concatenate([[0], np.cumsum(many)]).tolist()
                lead = [first[x:y].tobytes() for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, to - at), pa.array(digest, pa.binary()), pa.array(prints, pa.binary()), pa.array(size, pa.int32()), pa.array(lead, pa.binary())],
                    names=["doc_id", "digest", "fp", "size", "prefix"],
                )

    return run


def _counted(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column("text"))
            for at, to in rolling.chunks([len(t) for t in texts], CHUNK):
                hashes, count = np.unique(_distinct(*_windows(*_word_hashes(texts[at:to]), n))[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(count)], names=["hash", "n"])

    return run


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, and frequencies of the shingles that recur most in a sample of the texts."""
    every = max(1, rows.count() // SAMPLE)
    counted = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(every)) == 0).mapInArrow(_counted(words), "hash long, n long")
    top = counted.groupBy("hash").agg(F.sum("n").alias("n")).where("n > 2").orderBy(F.desc("n"), "hash").limit(COMMON).toArrow()
    hashes, n = np.asarray(top.column("hash")).view(np.uint64), np.asarray(top.column("n"))
    order = np.argsort(hashes)
    return hashes[order], n[order]


def _postings(splits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in larger(batches, PACKED):
            ids = np.asarray(b.column("id"))
            prints = np.frombuffer(b"".join(b.column("fp").to_pylist()), np.uint8).reshape(-1, WIDE)
            rows = []
            for p in range(0, POSITIONS, 2):
                share = (rolling.mix(prints[:, p].astype(np.uint64) << np.uint64(8) | prints[:, p + 1]) % np.uint64(splits)).astype(np.int64)
                order = np.argsort(share, kind="stable")
                share = share[order]
                cuts = np.flatnonzero(np.diff(share, prepend=-1, append=-1)).tolist()
                rows += [(p * splits + int(share[x]), p, ids[order[x:y]].tobytes(), prints[order[x:y]].tobytes()) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "position", "ids", "fps"])

    return run


def near(prints: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, bits) of the pairs that reach the tally and stay within ``BITS``."""
    long = np.ascontiguousarray(prints[:, POSITIONS:]).view(np.uint64)
    short = np.ascontiguousarray(prints[:, :POSITIONS])
    found = []
    for at in range(0, len(u), 100_000):
        x, y = u[at : at + 100_000], v[at : at + 100_000]
        hit = np.flatnonzero((short[x] == short[y]).sum(1) >= SHARED)
        bits = np.bitwise_count(long[x[hit]] ^ long[y[hit]]).sum(1, dtype=np.int64)
        keep = bits <= BITS
        found.append((x[hit][keep], y[hit][keep], bits[keep]))
    nil = np.zeros(0, np.int64)
    return tuple(np.concatenate([nil, *(f[k] for f in found)]) for k in range(3))


def forest(n: int, u: np.ndarray, v: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The links of a spanning forest with the fewest bits: each round every tree takes its best link outward."""
    label, taken = np.arange(n), np.zeros(len(u), bool)
    rank = np.empty(len(u), np.int64)
    rank[np.lexsort((v, u, bits))] = np.arange(len(u))
    left = np.arange(len(u))
    while True:
        left = left[label[u[left]] != label[v[left]]]
        if not len(left):
            return u[taken], v[taken], bits[taken]
        best = np.full(n, len(u))
        np.minimum.at(best, label[u[left]], rank[left])
        np.minimum.at(best, label[v[left]], rank[left])
        pick = left[(best[label[u[left]]] == rank[left]) | (best[label[v[left]]] == rank[left])]
        taken[pick] = True
        while True:
            low = np.minimum(label[u[pick]], label[v[pick]])
            new = label.copy()
            np.minimum.at(new, label[u[pick]], low)
            np.minimum.at(new, label[v[pick]], low)
            new = new[new]
            if (new == label).all():
                break
            label = new


def _divided(key: np.ndarray, prints: np.ndarray, position: int, more: int = 2) -> np.ndarray:
    """Postings by number; one of over ``DENSE`` entries is divided by the values at further positions."""
    _, group, size = np.unique(key, return_inverse=True, return_counts=True)
    dense = size[group] > DENSE
    if not dense.any() or more == POSITIONS:
        return group
    finer = key.astype(np.int64)
    finer[dense] = (group[dense].astype(np.int64) << 8 | prints[dense, (position + more) % POSITIONS]) + (1 << 40)
    return _divided(np.unique(finer, return_inverse=True)[1], prints, position, more + 1)


def posting_links(ids: np.ndarray, prints: np.ndarray, position: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower id, higher id, bits): the forest of the postings at a position and the next."""
    key = _divided(prints[:, position].astype(np.int32) << 8 | prints[:, position + 1], prints, position)
    order = np.lexsort((ids, key))
    ids, prints, key = ids[order], prints[order], key[order]
    cuts = np.flatnonzero(np.diff(key, prepend=-1, append=-1))
    size, n = np.diff(cuts), len(ids)
    nil = np.zeros(0, np.int64)
    held, count = [(nil, nil, nil)], 0

    def add(u: np.ndarray, v: np.ndarray) -> None:
        nonlocal held, count
        held.append(near(prints, u, v))
        count += len(held[-1][0])
        if count > HELD:
            held = [forest(n, *(np.concatenate([h[k] for h in held]) for k in range(3)))]
            count = 0

    own = np.flatnonzero(np.repeat(size <= PAIRWISE, size))
    end = np.repeat(cuts[1:], size)
    for d in range(1, min(PAIRWISE, int(size.max()) if len(size) else 0)):
        own = own[own + d < end[own]]
        if not len(own):
            break
        add(own, own + d)
    for a, z in zip(cuts[:-1][size > PAIRWISE].tolist(), cuts[1:][size > PAIRWISE].tolist(), strict=True):
        step = max(1, 1_000_000 // (z - a))
        for at in range(a, z, step):
            i = np.arange(at, min(z, at + step))
            many = z - 1 - i
            add(np.repeat(i, many), np.repeat(i + 1 - np.cumsum(many) + many, many) + np.arange(many.sum()))
    u, v, bits = forest(n, *(np.concatenate([h[k] for h in held]) for k in range(3)))
    return np.minimum(ids[u], ids[v]), np.maximum(ids[u], ids[v]), bits


def _candidates(table: pa.Table) -> pa.Table:
    position = table.column("position")[0].as_py()
    ids = np.frombuffer(b"".join(table.column("ids").to_pylist()), np.int64)
    prints = np.frombuffer(b"".join(table.column("fps").to_pylist()), np.uint8).reshape(-1, WIDE)
    a, b, bits = posting_links(ids, prints, position)
    return pa.table({"a": a, "b": b, "bits": bits})


def shingles(text: bytes, words: int) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles."""
    own, _ = _word_hashes([text])
    if len(own) <= words:
        return rolling.Hashes(own)(np.array([0]), np.array([len(own)])) if len(own) else own
    return np.unique(rolling.Hashes(own).fixed(words))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    total = len(a) + len(b) - both
    return both / total if total else 1.0


def _verify(words: int, similarity: float):
    """Over partitions in the order of (a, part), the text of ``a`` itself first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, leads = None, []
        for b in batches:
            hits = []
            for a, part, other, text in zip(b.column("a").to_pylist(), b.column("part").to_pylist(), b.column("b").to_pylist(), utf8(b.column("text")), strict=True):
                if other is None:  # an id may have several texts
                    now, leads = (a, part), [*(leads if now == (a, part) else []), shingles(text, words)]
                elif now == (a, part):
                    own = shingles(text, words)
                    if any(jaccard(lead, own) >= similarity for lead in leads):
                        hits.append((a, other))
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64())], names=["a", "b"])

    return run


def candidates(reps: DataFrame) -> DataFrame:
    """Distinct links (a, b, bits), a < b, of (id, fp).

    An entry goes to one bucket for every two positions, by the values at both; buckets and
    tasks grow with the entries, up to a bucket for each posting.
    """
    small_batches(reps.sparkSession)
    tasks = shares(reps, 2 * 64 // POSITIONS)
    splits = max(1, min(1 << 16, tasks // 4))
    packed = reps.select("id", "fp").mapInArrow(_postings(splits), "bucket long, position long, ids binary, fps binary")
    return packed.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_candidates, "a long, b long, bits long").distinct()


def _prefix_postings(splits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in larger(batches, PACKED):
            hashes = np.frombuffer(b"".join(b.column("prefix").to_pylist()), np.uint64)
            many = np.array([len(x) // 8 for x in b.column("prefix").to_pylist()], np.int64)
            rows = np.empty(len(hashes), POSTING)
            rows["hash"], rows["place"] = hashes, np.arange(len(hashes)) - np.repeat(np.cumsum(many) - many, many)
            for c in ("id", "root", "size"):
                rows[c] = np.repeat(np.asarray(b.column(c)), many)
            rows["bits"] = np.repeat(np.frombuffer(b"".join(b.column("bits").to_pylist()), "<u8").reshape(-1, 2), many, axis=0)
            share = (hashes % np.uint64(splits)).astype(np.int64)
            rows, share = rows[np.argsort(share, kind="stable")], np.sort(share)
            cuts = np.flatnonzero(np.diff(share, prepend=-1, append=-1))
            packed = [rows[x:y].tobytes() for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(share[cuts[:-1]], pa.int64()), pa.array(packed, pa.binary())], names=["bucket", "rows"])

    return run


def prefix_pairs(rows: np.ndarray, similarity: float) -> np.ndarray:
    """Distinct (lower id, higher id) of different roots that share a posting and, by sizes and places in it, may be similar."""
    rows = rows[np.lexsort((rows["size"], rows["hash"]))]
    group = np.cumsum(np.diff(rows["hash"], prepend=rows["hash"][:1]) != 0)
    key = group << 32 | rows["size"]
    # partners of a row follow it, up to the greatest size that can be similar
    many = np.searchsorted(key, group << 32 | (rows["size"] / similarity + 1e-9).astype(np.int64), "right") - np.arange(len(rows)) - 1
    upto = np.concatenate([[0], np.cumsum(many)])
    held, count, at = [np.zeros((0, 2), np.int64)], 0, 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(upto, upto[at] + 1_000_000, "right")) - 1)
        u = np.repeat(np.arange(at, to), many[at:to])
        v = u + 1 + np.arange(len(u)) - np.repeat(upto[at:to] - upto[at], many[at:to])
        keep = rows["root"][u] != rows["root"][v]
        u, v = rows[u[keep]], rows[v[keep]]
        rest = np.minimum(u["size"] - u["place"], v["size"] - v["place"])
        keep = rest >= similarity / (1 + similarity) * (u["size"].astype(np.int64) + v["size"]) - 1e-9
        u, v = u[keep], v[keep]
        keep = (np.bitwise_count(u["bits"] ^ v["bits"]).sum(1) <= APART) | (np.minimum(u["size"], v["size"]) < FEW)
        a, b = u["id"][keep], v["id"][keep]
        held.append(np.stack([np.minimum(a, b), np.maximum(a, b)], 1))
        count += len(a)
        if count > HELD:
            held, count = [np.unique(np.concatenate(held), axis=0)], 0
        at = to
    return np.unique(np.concatenate(held), axis=0)


def _prefix_candidates(similarity: float):
    def run(table: pa.Table) -> pa.Table:
        pairs = prefix_pairs(np.frombuffer(b"".join(table.column("rows").to_pylist()), POSTING), similarity)
        return pa.table({"a": pairs[:, 0], "b": pairs[:, 1]})

    return run


def open_pairs(entries: DataFrame, similarity: float = 0.8) -> DataFrame:
    """Every pair (a, b), a < b, of different roots that may reach the similarity. entries: (id, root, size, prefix, bits)."""
    small_batches(entries.sparkSession)
    tasks = shares(entries, 16)
    packed = entries.mapInArrow(_prefix_postings(4 * tasks), "bucket long, rows binary")
    return packed.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(_prefix_candidates(similarity), "a long, b long").distinct()


def verified(docs: DataFrame, pairs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The pairs whose texts reach the similarity. docs: (doc_id, text)."""
    small_batches(docs.sparkSession)
    many = pairs.groupBy(F.col("a").alias("lead")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = pairs.join(many, F.col("a") == F.col("lead")).select("a", "b", "parts", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"))
    roles = dealt.select(F.col("b").alias("id"), "a", "part", "b").unionAll(
        many.select(F.col("lead").alias("id"), F.col("lead").alias("a"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast("long").alias("b"))
    )
    # merged at every size: what asks for texts grows with the corpus
    texts = docs.join(roles.hint("merge"), F.col("doc_id") == F.col("id")).select("a", "part", "b", "text")
    dealt = texts.repartition(shares(docs), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    return dealt.mapInArrow(_verify(words, similarity), "a long, b long")


def classes(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) of the rows with an id; component_id is the smallest id of the class."""
    small_batches(docs.sparkSession)
    rows = docs.where("doc_id is not null").selectExpr("cast(doc_id as long) doc_id", "text")
    scheme = "doc_id long, digest binary, fp binary, size int, prefix binary"
    prints = stored(rows.mapInArrow(_table(common_shingles(rows, words), words, similarity), scheme), "near-prints")
    reps = stored(prints.groupBy("digest").agg(F.min("doc_id").alias("id"), F.min("fp").alias("fp")), "near-reps")
    pairs = stored(candidates(reps.groupBy("id").agg(F.min("fp").alias("fp"))), "near-pairs")
    trees = stored(components(verified(rows, pairs.select("a", "b"), words, similarity)), "near-trees")
    # what the fingerprints have missed or left open: all pairs across the trees
    entries = reps.select("id", F.col("digest").alias("own")).join(trees, F.col("id") == F.col("node"), "left").select("id", "own", F.coalesce("root", "id").alias("root"))
    entries = prints.join(entries, (F.col("digest") == F.col("own")) & (F.col("doc_id") == F.col("id"))).select("id", "root", "size", "prefix", F.substring("fp", POSITIONS + 1, 16).alias("bits"))
    missed = verified(rows, stored(open_pairs(entries, similarity), "near-open"), words, similarity)
    roots = components(trees.select(F.col("root").alias("a"), F.col("node").alias("b")).unionAll(missed))
    named = reps.join(roots, F.col("id") == F.col("node"), "left").select(F.col("digest").alias("named"), F.coalesce("root", "id").alias("component_id"))
    return prints.join(named, F.col("digest") == F.col("named")).select("doc_id", "component_id")


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the one with the smallest key, columns as they are."""
    rows, shared = anchors.named(docs)
    texts = rows.select(F.col(anchors.KEY).alias("doc_id"), "text")
    found = stored(classes(texts.dropDuplicates(["doc_id"]) if shared else texts, words, similarity), "near-classes")
    gone = found.where("doc_id > component_id").select(F.col("doc_id").alias("__gone"))
    left = rows.join(gone.hint("merge"), F.col(anchors.KEY) == F.col("__gone"), "left_anti")
    if shared:  # rows of equal id and text
        left = left.groupBy(anchors.KEY).agg(F.min(F.struct(*docs.columns)).alias("__row")).select("__row.*")
    return left.select(*docs.columns)
