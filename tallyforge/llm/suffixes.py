"""Suffix-array deduplication of repeated byte strings.

Removes each byte that lies in a string of ``LENGTH`` bytes that also starts
earlier in the corpus: in a document with a smaller id, or earlier in the same
one. Strings are judged on the input and never cross documents.

Runs of windows that are equal as a whole are found by their hashes (see
``anchors``); the runs that share an anchor and differ, at the edges of
repeated passages, are compared by their text: each bucket of them becomes a
suffix array by two-stage sorting. Suffixes smaller than their successors are
sorted directly; one scan over the buckets induces all others; then the common
prefixes of neighbours tell which windows are equal, and all but the earliest
of each class are repeats.

What either way finds is verified: the bytes at the place where a range first
occurred travel to the document, and only bytes that are its own go.

An anchor may occur in very many different surroundings (a common line). So
the compared runs are dealt out by the anchor together with a hash of the
bytes before or after it that each half of a run's windows must contain.

Defined cases: null text is empty; texts under ``LENGTH`` bytes lose nothing;
rows with equal id and text are one document, rows with equal id and different
text are ordered by a hash of the text, a null id comes first; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import anchors
from .common import shares, small_batches, stored, table, trimmed, utf8

LENGTH = 100
GRAM = 36
SORTED = 1 << 19  # bytes of text in one suffix array
COLUMNS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text binary"


def suffix_array(text: bytes, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` bytes, by two-stage sorting."""
    n = len(text)
    if not n:
        return np.zeros(0, np.int64)
    t = np.frombuffer(text, np.uint8)
    # smaller than its successor: by the next byte that differs; the last suffix is larger than the empty one
    change = np.flatnonzero(t[1:] != t[:-1])
    rises = np.zeros(n, bool)
    up = t[change + 1] > t[change]
    lengths = np.diff(np.concatenate([[-1], change]))
    rises[: change[-1] + 1 if len(change) else 0] = np.repeat(up, lengths)
    direct = np.flatnonzero(rises).tolist()
    direct.sort(key=lambda i: text[i : i + depth])
    # buckets by first byte: induced suffixes come before the directly sorted ones
    total = np.bincount(t, minlength=256)
    end = np.cumsum(total)
    head, tail = end - total, end - np.bincount(t[rises], minlength=256)
    out = np.empty(n, np.int64)
    direct = np.array(direct, np.int64)
    out[tail[t[direct]] + _nth(t[direct])] = direct
    falls = ~rises
    if falls[n - 1]:
        out[head[t[n - 1]]] = n - 1
        head[t[n - 1]] += 1
    for c in np.flatnonzero(total).tolist():
        # the induced part of this bucket grows while it is scanned: by suffixes that begin with the same byte again
        at = end[c] - total[c]
        while True:
            if at < head[c]:
                now, at = out[at : head[c]], head[c]
            elif at < end[c]:
                now, at = out[tail[c] : end[c]], end[c]
            else:
                break
            before = now[now > 0] - 1
            before = before[falls[before]]
            if len(before):
                first = t[before]
                out[head[first] + _nth(first)] = before
                head += np.bincount(first, minlength=256)
    return out


def _nth(values: np.ndarray) -> np.ndarray:
    """How many equal values come before each."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    first = np.flatnonzero(np.diff(ordered.astype(np.int64), prepend=-1) if len(ordered) else ordered)
    out = np.empty(len(values), np.int64)
    out[order] = np.arange(len(values)) - np.repeat(first, np.diff(np.append(first, len(values))))
    return out


def common_prefixes(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Common prefix lengths of neighbours in ``order``, up to ``most``."""
    out = np.zeros(max(0, len(order) - 1), np.int64)
    pairs = np.arange(len(out))
    a, b = order[:-1], order[1:]
    padded = np.concatenate([text, np.zeros(most, np.uint8)])
    for d in range(most):
        pairs = pairs[padded[a[pairs] + d] == padded[b[pairs] + d]]
        if not len(pairs):
            break
        out[pairs] = d + 1
    return out


def repeated_windows(parts: list[bytes], windows: list[int], places: list[tuple[int, int]], n: int) -> np.ndarray:
    """The windows that equal one at an earlier place, as ``anchors.REPEAT``.

    parts: texts; windows: how many windows of n bytes count in each, from its
    start; places: (document, position) of each text.
    """
    text = b"\0".join([*parts, b""])
    size = np.array([len(p) + 1 for p in parts])
    start = np.cumsum(size) - size
    count = np.array(windows)
    order = suffix_array(text, n)
    owner = np.repeat(np.arange(len(parts)), size)[order]
    offset = order - start[owner]
    valid = offset < count[owner]
    order, owner, offset = order[valid], owner[valid], offset[valid]
    same = common_prefixes(np.frombuffer(text, np.uint8), order, n) >= n
    group = np.concatenate([[0], np.cumsum(~same)])[: len(order)]
    place = np.array(places, np.int64).reshape(-1, 2)
    doc, pos = place[owner, 0], place[owner, 1] + offset
    first = np.lexsort((pos, doc, group))
    new = np.ones(len(first), bool)
    new[1:] = group[first][1:] != group[first][:-1]
    # the earliest place of each class; a window may be listed twice
    lead = first[new][group]
    later = (doc > doc[lead]) | ((doc == doc[lead]) & (pos > pos[lead]))
    out = np.zeros(int(later.sum()), anchors.REPEAT)
    out["doc"], out["lo"], out["len"], out["src"], out["at"] = doc[later], pos[later], 1, doc[lead[later]], pos[lead[later]]
    return out


def _cut(text: bytes, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    return (text[a:z] for a, z in ranges)


def _halves(n: int, k: int):
    """Split each run's windows into those with at least half the free bytes before the anchor and the rest."""
    free = n - k
    left, right = free // 2, free - free // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for g, doc, lo, count, off, text in zip(*(b.column(c).to_pylist() for c in ("g", "doc", "lo", "len", "off", "text")), strict=True):
                # window i starts off - i bytes before the anchor
                many = max(0, min(count, off - left + 1))
                for side, at, to in ((0, 0, many), (1, many, count)):
                    if at < to:
                        near = text[off - left : off] if side == 0 else text[off + k : off + k + right]
                        key = int.from_bytes(hashlib.blake2b(near + bytes([side]) + g.to_bytes(8, "little", signed=True), digest_size=8).digest(), "little", signed=True)
                        out.append((key, doc, lo + at, to - at, text[at : to + n - 1]))
            columns = list(zip(*out, strict=True)) or [()] * 5
            kinds = (pa.int64(),) * 4 + (pa.binary(),)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["key", "doc", "lo", "len", "text"])

    return run


def _compare(n: int, buckets: int):
    """Over partitions that hold whole keys in order: suffix arrays of some keys at a time.

    A key with a single run has no partner. One with over ``SORTED`` bytes is
    not held: its windows go on one by one, by digest, to be matched in buckets.
    """

    def answer(rows: list[tuple]) -> np.ndarray:
        return repeated_windows([r[4] for r in rows], [r[3] for r in rows], [(r[1], r[2]) for r in rows], n)

    def singles(rows: list[tuple]) -> np.ndarray:
        return anchors.window_runs(((r[1], r[2], (r[4][k : k + n] for k in range(r[3]))) for r in rows), buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []
        size, own, hot = 0, 0, False
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("key", "doc", "lo", "len", "text")), strict=True):
                if group and row[0] != group[-1][0]:
                    if hot:
                        yield anchors.packed([singles(group)], True, buckets)
                    elif len(group) > 1:
                        held += group
                        size += own
                    group, own, hot = [], 0, False
                    if size >= SORTED:
                        yield anchors.packed([np.zeros(0, anchors.RUN)], True, buckets, answer(held))
                        held, size = [], 0
                group.append(row)
                own += len(row[4])
                if own >= SORTED:
                    yield anchors.packed([singles(group)], True, buckets)
                    group, own, hot = [group[-1][:3] + (0, b"")], 0, True
        if hot:
            yield anchors.packed([singles(group)], True, buckets)
        elif len(group) > 1:
            held += group
        if held:
            yield anchors.packed([np.zeros(0, anchors.RUN)], True, buckets, answer(held))

    return run


def repeats(documents: DataFrame, n: int = LENGTH, k: int = GRAM) -> DataFrame:
    """Candidates (doc, lo, len, src, at): starts of repeated windows of n bytes, and where they stand first."""
    spark = documents.sparkSession
    small_batches(spark)
    buckets = shares(documents, 4)
    packed = anchors.scan(documents, anchors.byte_tokens, n, k, buckets, True)
    found = stored(anchors.matched(packed, True), "byte-runs")
    anchors.release(spark)
    compare = anchors.snippets(documents, found.where("kind = 1"), _cut, n).mapInArrow(trimmed(_halves(n, k)), "key long, doc long, lo long, len long, text binary")
    dealt = compare.repartition(buckets, "key").sortWithinPartitions("key")
    more = stored(anchors.matched(dealt.mapInArrow(trimmed(_compare(n, buckets)), anchors.PACKED), True), "byte-windows")
    anchors.release(spark)
    return found.unionAll(more).where("kind = 0").select("doc", "lo", "len", "src", "at")


def _apply(n: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(5)]
            for text, starts in zip(utf8(b.column("text")), b.column("starts").to_pylist(), strict=True):
                same = [(s["lo"], s["len"]) for s in starts or () if text[s["lo"] : s["lo"] + s["len"] + n - 1] == s["piece"]]
                spans = anchors.covered(same, n, len(text))
                kept, at = [], 0
                for a, z in spans:
                    kept.append(text[at:a])
                    at = z
                left = b"".join([*kept, text[at:]]) if spans else text
                for column, v in zip(out, (len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if texts else None), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text"])

    return run


def deduplicate(docs: DataFrame, n: int = LENGTH, k: int = GRAM, texts: bool = True) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, the bytes left as ``text``."""
    rows, documents = anchors.keyed(docs)
    return anchors.with_checked(rows, documents, repeats(documents, n, k), _cut, n, "byte").mapInArrow(trimmed(_apply(n, texts)), COLUMNS)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), texts=False).drop("text")


ORACLE_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
 win AS (SELECT doc_id, unnest(range(0, length(x) // 2 - 99)) AS i, unnest(list_transform(range(0, length(x) // 2 - 99), lambda i: md5_number(substr(x, 2 * i + 1, 200)))) AS k FROM t),
 nth AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS n FROM win),
 hit AS (SELECT doc_id, i, coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 < i, true) AS fresh FROM nth WHERE n > 1),
 island AS (SELECT doc_id, i, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit),
 span AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM island GROUP BY doc_id, g),
 gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM span
         UNION ALL SELECT t.doc_id, coalesce(max(s.z), 0), any_value(length(x) // 2) FROM t LEFT JOIN span s ON t.doc_id = s.doc_id GROUP BY t.doc_id),
 kept AS (SELECT g.doc_id, string_agg(substr(x, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS x FROM gap g JOIN t ON t.doc_id = g.doc_id GROUP BY g.doc_id),
 spans AS (SELECT doc_id, count(*) AS n FROM span GROUP BY doc_id)
SELECT t.doc_id, length(t.x) // 2 AS n_bytes, (length(t.x) - length(kept.x)) // 2 AS n_removed, coalesce(spans.n, 0) AS n_spans, sha256(unhex(kept.x)) AS kept_sha256
FROM t JOIN kept ON t.doc_id = kept.doc_id LEFT JOIN spans ON t.doc_id = spans.doc_id
"""
