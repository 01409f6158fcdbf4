"""Content-defined anchors: which windows of n tokens repeat, without a row per window.

Of the ``w = n - k + 1`` grams of k tokens in a window, the one with the lowest
hash is its anchor, so equal windows have equal anchors at equal places. A run
is the range of consecutive windows of one document that share an anchor; a
run carries the anchor's hash ``g`` and a hash ``c`` of all its tokens. Two
runs with equal g and c are equal throughout. Runs with equal g and different c
may share some windows; only these go on to an exact comparison of their text.

Runs travel packed, as one row of arrays per task and bucket of g. Before that
each task settles the repeats among its own runs, so a passage that a third of
all documents contain is sent once per task. A repeat carries the place where
its windows stand first, so that ``with_checked`` can compare the texts.

Token positions are bytes or words, as the caller says.
"""

from __future__ import annotations

import bisect
import gc
import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling
from .common import ranked, released, shares, stored, trimmed, utf8

CHUNK = (1 << 19) - 1024  # bytes of text hashed at once
HELD = 400_000  # runs held by a task before they are sent
PART = 500  # ranges that one copy of a document's text is asked for
SENT = 2 << 20  # bytes of text in a batch that a task sends on, but for its last range
PACKED = "bucket long, n long, g binary, c binary, doc binary, lo binary, len binary, off binary, src binary, at binary"
FIELDS = {"g": "<u8", "c": "<u8", "doc": "<i8", "lo": "<u4", "len": "<u2", "off": "<u2"}
RUN = np.dtype([("bucket", "<i8"), *FIELDS.items()])
#: Windows that repeat: ``len`` from ``lo`` in ``doc`` on are those from ``at`` in ``src`` on.
REPEAT = np.dtype([(k, "<i8") for k in ("doc", "lo", "len", "src", "at")])
#: What the buckets give: kind 0 is a repeat, kind 1 a run to compare by its text.
FOUND = "kind long, g long, doc long, lo long, len long, off long, src long, at long"


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps."""
    gc.collect()
    spark._jvm.System.gc()


def sliding_low(values: np.ndarray, w: int) -> np.ndarray:
    low, size = values, 1
    while 2 * size <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    if size < w:
        low = np.minimum(low[: len(low) - (w - size)], low[w - size :])
    return low


def runs_of(tokens: np.ndarray, docs: np.ndarray, doc_ids: np.ndarray, n: int, k: int, buckets: int) -> np.ndarray:
    """Runs of the windows of n tokens. tokens: a 64-bit value each; docs: where documents start, and the end."""
    if len(tokens) < n:
        return np.zeros(0, RUN)
    grams = rolling.Hashes(tokens).fixed(k)
    bits = np.uint64(max(16, len(grams).bit_length()))
    low = np.uint64((1 << int(bits)) - 1)
    anchor = (sliding_low((grams & ~low) | np.arange(len(grams), dtype=np.uint64), n - k + 1) & low).astype(np.int64)
    step = np.zeros(len(anchor) + 1, np.int32)
    start, end = docs[:-1], docs[1:]
    fits = end - start >= n
    step[start[fits]] += 1
    np.subtract.at(step, end[fits] - n + 1, 1)
    at = np.flatnonzero(np.cumsum(step[:-1]))
    if not len(at):
        return np.zeros(0, RUN)
    own = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (own[1:] != own[:-1]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    lo, count = at[first], np.diff(np.append(first, len(at)))
    out = np.zeros(len(first), RUN)
    doc = np.searchsorted(docs, lo, "right") - 1
    gram = grams[own[first]]
    whole = rolling.Hashes(tokens ^ np.uint64(0xA0761D6478BD642F), rolling.BASES[1])
    place = ((own[first] - lo) << 20 | count).astype(np.uint64)
    out["bucket"] = (gram >> np.uint64(33)).astype(np.int64) % buckets
    out["g"] = gram
    out["c"] = rolling.mix(whole(lo, lo + count + n - 1) ^ rolling.mix(place))
    out["doc"], out["lo"] = doc_ids[doc], lo - docs[doc]
    out["len"], out["off"] = count, own[first] - lo
    return out


def settle(runs: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order runs by (g, c, doc, lo); which of them repeat an earlier one, and where the first like each is.

    ``within``: an earlier place in the same document counts too.
    """
    runs = runs[np.lexsort((runs["lo"], runs["doc"], runs["c"], runs["g"]))]
    if not len(runs):
        return runs, np.zeros(0, bool), np.zeros(0, np.int64)
    new = np.ones(len(runs), bool)
    new[1:] = (runs["c"][1:] != runs["c"][:-1]) | (runs["g"][1:] != runs["g"][:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return runs, ~new if within else runs["doc"] != runs["doc"][first], first


def repeats_of(runs: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Runs as repeats of others, one each."""
    out = np.zeros(len(runs), REPEAT)
    for k in ("doc", "lo", "len"):
        out[k] = runs[k]
    out["src"], out["at"] = firsts["doc"], firsts["lo"]
    return out


def merged(known: np.ndarray) -> np.ndarray:
    """Repeats whose places, here and there, adjoin or overlap as one."""
    known = known[np.lexsort((known["lo"], known["lo"] - known["at"], known["src"], known["doc"]))]
    if not len(known):
        return known
    end = known["lo"] + known["len"]
    new = np.ones(len(known), bool)
    new[1:] = (known["doc"][1:] != known["doc"][:-1]) | (known["src"][1:] != known["src"][:-1]) | ((known["lo"] - known["at"])[1:] != (known["lo"] - known["at"])[:-1]) | (known["lo"][1:] > end[:-1])
    at = np.flatnonzero(new)
    out = known[at]
    out["len"] = np.maximum.reduceat(end, at) - out["lo"]
    return out


def _pack(bucket: int, part: np.ndarray, fields: dict[str, str]) -> dict:
    return {"bucket": bucket, "n": len(part), **dict.fromkeys((*FIELDS, "src", "at"), b""), **{k: part[k].astype(kind).tobytes() for k, kind in fields.items()}}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    kinds = pa.schema([("bucket", pa.int64()), ("n", pa.int64()), *((k, pa.binary()) for k in (*FIELDS, "src", "at"))])
    return pa.RecordBatch.from_pylist(rows, schema=kinds)


Tokens = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def byte_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf, docs = rolling.joined(texts, b"")
    return rolling.byte_values(buf), docs


def word_tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    buf, docs = rolling.joined(texts)
    start, end = rolling.words_of(buf)
    return rolling.Hashes(rolling.byte_values(buf))(start, end), np.searchsorted(start, docs)


def packed(held: list[np.ndarray], within: bool, buckets: int, known: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of ``PACKED``: runs by bucket, after the repeats among them are settled; ``known`` are repeats already."""
    runs, repeat, first = settle(np.concatenate(held), within)
    own = repeats_of(runs[repeat], runs[first[repeat]])
    known = merged(own if known is None else np.concatenate([own, known]))
    runs = runs[~repeat]
    runs = runs[np.lexsort((runs["lo"], runs["doc"], runs["bucket"]))]  # near alike: it packs better
    cuts = np.append(np.flatnonzero(np.diff(runs["bucket"], prepend=-1)), len(runs))
    rows = [_pack(int(runs["bucket"][a]), runs[a:z], FIELDS) for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    for at in range(0, len(known), 100_000):
        rows.append(_pack(-1 - (int(known["doc"][at]) + at) % buckets, known[at : at + 100_000], dict.fromkeys(REPEAT.names, "<i8")))
    return _batch(rows)


def window_runs(parts: Iterable[tuple[int, int, Iterable[bytes]]], buckets: int) -> np.ndarray:
    """Single windows as runs of one, by a digest of their text. parts: (document, first start, texts), taken one by one."""
    digest, docs, starts, counts = bytearray(), [], [], []
    for doc, lo, texts in parts:
        before = len(digest)
        for w in texts:
            digest += hashlib.blake2b(w, digest_size=16).digest()
        docs.append(doc)
        starts.append(lo)
        counts.append((len(digest) - before) // 16)
    halves = np.frombuffer(bytes(digest), "<u8").reshape(-1, 2)
    count = np.array(counts, np.int64)
    out = np.zeros(len(halves), RUN)
    out["bucket"] = (halves[:, 0] >> np.uint64(33)).astype(np.int64) % buckets
    out["g"], out["c"] = halves[:, 0], halves[:, 1]
    out["doc"] = np.repeat(np.array(docs, np.int64), count)
    out["lo"] = np.arange(len(out)) + np.repeat(np.array(starts, np.int64) - (np.cumsum(count) - count), count)
    out["len"] = 1
    return out


def _scan(tokens: Tokens, n: int, k: int, buckets: int, within: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [np.zeros(0, RUN)], 0
        for b in batches:
            texts, ids = utf8(b.column("text")), np.asarray(b.column("key"))
            for at, to in rolling.chunks([len(x) for x in texts], CHUNK):
                values, docs = tokens(texts[at:to])
                held.append(runs_of(values, docs, ids[at:to], n, k, buckets))
                count += len(held[-1])
                if count >= HELD:
                    yield packed(held, within, buckets)
                    held, count = [held[0]], 0
        if count:
            yield packed(held, within, buckets)

    return run


def scan(keyed: DataFrame, tokens: Tokens, n: int, k: int, buckets: int, within: bool) -> DataFrame:
    """Packed runs of documents (key, text) by bucket; negative buckets hold settled repeats."""
    return keyed.select("key", "text").mapInArrow(trimmed(_scan(tokens, n, k, buckets, within)), PACKED)


def unpack(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The runs of a bucket's rows, and the settled repeats among them."""
    runs, known = [np.zeros(0, RUN)], [np.zeros(0, REPEAT)]
    for row in table.to_pylist():
        settled = row["bucket"] < 0
        part = np.zeros(row["n"], REPEAT if settled else RUN)
        for k, kind in (dict.fromkeys(REPEAT.names, "<i8") if settled else FIELDS).items():
            part[k] = np.frombuffer(row[k], kind)
        if not settled:
            part["bucket"] = row["bucket"]
        (known if settled else runs).append(part)
    return np.concatenate(runs), np.concatenate(known)


def to_compare(runs: np.ndarray) -> np.ndarray:
    """Of settled, unrepeated runs: those whose g occurs with another c."""
    if not len(runs):
        return np.zeros(0, bool)
    new_g = np.ones(len(runs), bool)
    new_g[1:] = runs["g"][1:] != runs["g"][:-1]
    new_c = np.ones(len(runs), bool)
    new_c[1:] = new_g[1:] | (runs["c"][1:] != runs["c"][:-1])
    group = np.cumsum(new_g) - 1
    return np.bincount(group, weights=new_c)[group] > 1


def found(repeats: list[np.ndarray], compare: np.ndarray) -> pa.Table:
    """Rows of ``FOUND`` from repeats and runs to compare."""
    known = np.concatenate([np.zeros(0, REPEAT), *repeats])
    nil, none = np.zeros(len(known), np.int64), np.zeros(len(compare), np.int64)
    columns = {"kind": (nil, none + 1), "g": (nil, compare["g"].view("<i8") if len(compare) else none), "off": (nil, compare["off"].astype(np.int64))}
    columns |= {k: (known[k], compare[k].astype(np.int64)) for k in ("doc", "lo", "len")} | {k: (known[k], none) for k in ("src", "at")}
    order = [c.split()[0] for c in FOUND.split(", ")]
    return pa.table({k: np.concatenate(columns[k]) for k in order})


def matched(rows: DataFrame, within: bool) -> DataFrame:
    """Rows of ``FOUND`` from packed rows: the repeats of each bucket and the runs to compare."""

    def settled(table: pa.Table) -> pa.Table:
        runs, known = unpack(table)
        runs, repeat, first = settle(runs, within)
        kept = runs[~repeat]
        return found([known, repeats_of(runs[repeat], runs[first[repeat]])], kept[to_compare(kept)])

    def run(table: pa.Table) -> pa.Table:
        out = settled(table)
        released()
        return out

    return rows.groupBy("bucket").applyInArrow(run, FOUND)


KEY = "__doc_key"


def named(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with a column ``KEY``, and whether rows may share a key.

    The key is the id where ids are unique. Else rows with equal id and text
    share a key, and those with equal id are told apart by a hash of the text;
    a null id comes before all others. The key is then the place in that order.
    """
    number = F.col("doc_id").cast("long")
    if docs.groupBy(number.alias("id")).count().where("count > 1 or id is null").limit(1).isEmpty():
        return docs.withColumn(KEY, number), False
    own = [number, F.xxhash64(F.coalesce("text", F.lit(""))), F.length(F.coalesce("text", F.lit("")))]
    names = ["__key_id", "__key_hash", "__key_size"]
    places = ranked(docs.select(*[c.alias(n) for c, n in zip(own, names, strict=True)]).distinct(), names, KEY, "names")
    same = [c.eqNullSafe(F.col(n)) for c, n in zip(own, names, strict=True)]
    return docs.join(places, same[0] & same[1] & same[2]).drop(*names), True


def keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, documents): rows (doc_id, key, text), and the same once per key, as ``named`` gives it."""
    rows, shared = named(docs.select("doc_id", "text"))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(KEY).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    return rows, rows.dropDuplicates(["key"]) if shared else rows


Cut = Callable[[bytes, list[tuple[int, int]]], Iterable[bytes]]


def pieces_of(cut: Cut, n: int, key: str | None, at: str, names: tuple[str, ...], out: str):
    """From batches (text, asked) a row for each range asked for: its fields ``names``, and its text as ``out``.

    key: the column, if any, that is repeated as ``doc``; at: the field that says where a range
    starts. A batch sent on has about ``SENT`` bytes, however many ranges one text is asked for.
    """
    columns = [*names, out]
    kinds = [*(pa.int64() for _ in names), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("asked")
            flat, cuts = lists.flatten(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
            field = {k: np.asarray(flat.field(k)) for k in (*(c for c in names if c != "doc" or key is None), "len", at)}
            if key is not None:
                field["doc"] = np.repeat(np.asarray(b.column(key)), np.diff(cuts))

            def batch(first: int, texts: list[bytes], field=field) -> pa.RecordBatch:
                own = [pa.array(field[k][first : first + len(texts)]) for k in names]
                return pa.RecordBatch.from_arrays([x.cast(t) for x, t in zip([*own, pa.array(texts, pa.binary())], kinds, strict=True)], names=columns)

            held, size, first = [], 0, 0
            for row, text in enumerate(b.column("text")):
                a, z = cuts[row], cuts[row + 1]
                start = field[at][a:z]
                for p in cut((text.as_py() or "").encode(), list(zip(start.tolist(), (start + field["len"][a:z] + n - 1).tolist(), strict=True))):
                    held.append(p)
                    size += len(p) + 64
                    if size >= SENT:
                        yield batch(first, held)
                        held, size, first = [], 0, first + len(held)
            if held:
                yield batch(first, held)

    return trimmed(run)


def snippets(documents: DataFrame, compare: DataFrame, cut: Cut, n: int) -> DataFrame:
    """The runs of ``compare`` with their text: (g, doc, lo, len, off, text).

    cut: gives the texts of token ranges of a document.
    """
    asked = compare.groupBy("doc").agg(F.collect_set(F.struct("g", "lo", "len", "off")).alias("asked"))
    both = documents.join(asked, documents.key == asked.doc).select("key", "text", "asked")
    return both.mapInArrow(pieces_of(cut, n, "key", "lo", ("g", "doc", "lo", "len", "off"), "text"), "g long, doc long, lo long, len long, off long, text binary")


def covered(starts: list[tuple[int, int]], n: int, size: int) -> list[tuple[int, int]]:
    """Maximal ranges of tokens under windows of n whose starts are (lo, len) ranges."""
    out: list[list[int]] = []
    for lo, length in sorted(starts):
        end = min(size, lo + length + n - 1)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([lo, end])
    return [(a, z) for a, z in out]


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        out = [np.zeros(0, REPEAT)]
        lists = b.column("rows")
        flat, cuts = lists.flatten(), (lists.offsets.to_numpy() - lists.offsets[0].as_py()).tolist()
        whole = np.zeros(len(flat), REPEAT)
        whole["doc"] = np.repeat(np.asarray(b.column("doc")), np.diff(cuts))
        for k in ("lo", "len", "src", "at"):
            whole[k] = np.asarray(flat.field(k))
        for a, z in zip(cuts[:-1], cuts[1:], strict=True):
            own = merged(whole[a:z])
            # the longest ranges first: what lies in one of them needs no text of its own
            order = np.argsort(-own["len"], kind="stable")
            own, keep, taken = own[order], [], []
            for k, (a, z) in enumerate(zip(own["lo"].tolist(), (own["lo"] + own["len"]).tolist(), strict=True)):
                at = bisect.bisect_right(taken, (a, float("inf"))) - 1
                if at < 0 or taken[at][1] < z:
                    keep.append(k)
                    bisect.insort(taken, (a, z))
            out.append(own[keep])
        flat = np.concatenate(out)
        yield pa.RecordBatch.from_arrays([pa.array(flat[k]) for k in REPEAT.names], names=list(REPEAT.names))


def with_checked(rows: DataFrame, documents: DataFrame, repeats: DataFrame, cut: Cut, n: int, tag: str) -> DataFrame:
    """rows (doc_id, key, text) with ``starts``: the (lo, len, piece) ranges of repeated windows, or null.

    ``piece`` is the text of the range's first occurrence, for the caller to compare with. Ranges
    asked of one document are dealt out by ``PART`` to copies of its text, however many ask.
    """
    lists = repeats.groupBy("doc").agg(F.collect_list(F.struct("lo", "len", "src", "at")).alias("rows"))
    segments = stored(lists.mapInArrow(trimmed(_segments), "doc long, lo long, len long, src long, at long"), f"{tag}-segments")
    release(rows.sparkSession)
    parts = segments.groupBy(F.col("src").alias("__src")).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    hot = stored(parts.where("parts > 1"), f"{tag}-hot")
    ask = F.collect_list(F.struct("doc", "lo", "len", "at")).alias("asked")
    asked = segments.join(hot, F.col("src") == F.col("__src"), "left_anti").groupBy("src").agg(ask)
    usual = documents.join(asked, documents.key == asked.src).select("text", "asked")
    # each part of what is asked of one document meets a copy of its text in a task of its own
    split = segments.join(hot, F.col("src") == F.col("__src")).withColumn("part", F.pmod(F.xxhash64("doc"), F.col("parts")))
    split = split.groupBy("src", "part").agg(ask)
    copied = documents.join(hot, documents.key == hot["__src"]).select("key", "text", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("__part"))
    dealt = [d.repartition(shares(documents), *d.columns[:1], p) for d, p in ((copied.select("key", "__part", "text"), "__part"), (split, "part"))]
    often = dealt[0].join(dealt[1], (F.col("key") == F.col("src")) & (F.col("__part") == F.col("part"))).select("text", "asked")

    given = stored(usual.unionAll(often).mapInArrow(pieces_of(cut, n, None, "at", ("doc", "lo", "len"), "piece"), "doc long, lo long, len long, piece binary"), f"{tag}-pieces")
    release(rows.sparkSession)
    own = given.groupBy("doc").agg(F.collect_list(F.struct("lo", "len", "piece")).alias("starts"))
    return rows.join(own, rows.key == own.doc, "left").select("doc_id", "text", "starts")
