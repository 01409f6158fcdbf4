"""Substring deduplication over a log-structured index of window fingerprints.

Documents come in batches of ascending keys. The index holds what earlier
batches had, as sorted immutable runs: per run and bucket one file of
fingerprints in the order of their hash, each with the place where it first
occurred. For a new batch every bucket is one merge join of the batch's sorted
fingerprints with the sorted files of that bucket; what is new becomes the
batch's own run, of level 0. Once there are ``FANIN`` runs of a level, the
bucket's task writes their merge along with the new fingerprints as one run of
the next level instead, and the old ones go (compaction). So a fingerprint is
rewritten once a level, as often as the logarithm of the number of batches.

The index is a folder with a manifest, the last one written whole, that names
the runs, the parameters, the last key and where the texts are; ``Index.open``
goes on from it in another session, and what a broken job left beside it is
not read. A batch's texts are kept in the folder, unless the caller says that
they can be had elsewhere.

The index doesn't list all windows: a fingerprint stands for the run of windows
that share an anchor (see ``anchors``), a fifth of the words. Equal
fingerprints make all windows of their runs candidates; where only the anchor's
hash is equal, the windows are candidates one by one. Every candidate range is
verified on the words: those at the place where it first occurred travel to the
document, and a word goes only where they are its own.

A word goes if it lies in a window of ``WORDS`` words whose sequence also
starts in a document with a smaller id.

Defined cases: null text has no words; texts of fewer words than a window lose
nothing; rows with equal id and text are one document, rows with equal id and
different text are ordered by a hash of the text, a null id comes first; an
empty table or batch gives an empty result; a batch for an index with keys up
to its last one, or without a key, raises; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anchors
from .common import fresh_path, publish, released, shares, small_batches, stored, table, trimmed, utf8

WORDS = 13
GRAM = 6
BATCHES = 4
FANIN = 3
COLUMNS = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string"


def write_run(fs, path: str, runs: np.ndarray) -> None:
    """A sorted run of one bucket, column by column; renamed once whole."""
    temp = f"{path}.{TaskContext.get().taskAttemptId() if TaskContext.get() else 0}"
    packer = zstandard.ZstdCompressor(level=1)
    with fs.open_output_stream(temp, compression=None) as out:
        out.write(np.array([len(runs)], "<u8").tobytes())
        for k, kind in anchors.FIELDS.items():
            data = packer.compress(runs[k].astype(kind).tobytes())
            out.write(np.array([len(data)], "<u8").tobytes() + data)
    publish(fs, temp, path)


def read_run(fs, path: str, bucket: int) -> np.ndarray:
    """A run of one bucket; empty if the run has nothing there."""
    if fs.get_file_info(path).type == pafs.FileType.NotFound:
        return np.zeros(0, anchors.RUN)
    opener = zstandard.ZstdDecompressor()
    with fs.open_input_stream(path, compression=None) as f:
        out = np.zeros(int(np.frombuffer(f.read(8), "<u8")[0]), anchors.RUN)
        out["bucket"] = bucket
        for k, kind in anchors.FIELDS.items():
            data = f.read(int(np.frombuffer(f.read(8), "<u8")[0]))
            out[k] = np.frombuffer(opener.decompress(data), kind)
    return out


def _key(runs: np.ndarray) -> np.ndarray:
    """(g, c) as 16 bytes in the order of a run's file."""
    both = np.empty((len(runs), 2), ">u8")
    both[:, 0], both[:, 1] = runs["g"], runs["c"]
    return both.view("S16").ravel()


def known_in(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Merge join of sorted runs: for each of ``new`` the place of its equal (g, c) in ``old``, or -1."""
    if not len(old):
        return np.full(len(new), -1)
    a, b = _key(old), _key(new)
    at = np.minimum(np.searchsorted(a, b), len(a) - 1)
    return np.where(a[at] == b, at, -1)


def anchored_in(old: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``new`` and of ``old`` share g with the other; both sorted."""
    if not len(old) or not len(new):
        return np.zeros(len(new), bool), np.zeros(len(old), bool)
    here = old["g"][np.minimum(np.searchsorted(old["g"], new["g"]), len(old) - 1)] == new["g"]
    there = new["g"][np.minimum(np.searchsorted(new["g"], old["g"]), len(new) - 1)] == old["g"]
    return here, there


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Two sorted runs as one: each entry goes to its place among the other's."""
    at = np.searchsorted(_key(a), _key(b), "right") + np.arange(len(b)) if len(a) else np.arange(len(b))
    out = np.empty(len(a) + len(b), anchors.RUN)
    own = np.ones(len(out), bool)
    own[at] = False
    out[at], out[own] = b, a
    return out


class Index:
    """A persistent index: its folder and what the manifest says."""

    def __init__(self, spark: SparkSession, base: str, state: dict):
        self.spark, self.base, self.state = spark, base.rstrip("/"), state

    @classmethod
    def create(cls, spark: SparkSession, base: str, buckets: int, n: int = WORDS, k: int = GRAM) -> Index:
        """A new index in a folder that the driver and all executors share."""
        index = cls(spark, base, {"buckets": buckets, "n": n, "k": k, "made": 0, "runs": [], "levels": {}, "texts": [], "last": None})
        index._commit()
        return index

    @classmethod
    def open(cls, spark: SparkSession, base: str) -> Index:
        """The index that a folder holds, as its last whole manifest has it."""
        fs, root = pafs.FileSystem.from_uri(base.rstrip("/"))
        names = sorted(f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("manifest-"))
        if not names:
            raise ValueError(f"{base} holds no index")
        with fs.open_input_stream(names[-1]) as f:
            return cls(spark, base, json.loads(f.read()))

    def _commit(self) -> None:
        """A new manifest under its own number; then the one before the last goes."""
        fs, root = pafs.FileSystem.from_uri(self.base)
        fs.create_dir(root, recursive=True)
        made = self.state["made"]
        temp = f"{root}/.manifest-{uuid.uuid4().hex}"
        with fs.open_output_stream(temp) as f:
            f.write(json.dumps(self.state).encode())
        publish(fs, temp, f"{root}/manifest-{made:05d}.json")
        old = f"{root}/manifest-{made - 2:05d}.json"
        if made > 1 and fs.get_file_info(old).type == pafs.FileType.File:
            fs.delete_file(old)

    def add(self, batch: DataFrame, keep_texts: bool = True) -> DataFrame:
        """Match a batch (key, text) with the index and put it in; gives rows of ``anchors.FOUND`` for ``confirmed``."""
        found, state = self._prepared(batch, keep_texts)
        self._adopt(state)
        return found

    def _prepared(self, batch: DataFrame, keep_texts: bool) -> tuple[DataFrame, dict]:
        """What ``add`` gives, and the state with the batch in it: its files are written, but no manifest names them yet."""
        last, (low, high, nulls) = self.state["last"], batch.agg(F.min("key"), F.max("key"), F.count_if(F.col("key").isNull())).first()
        if nulls:
            raise ValueError("a batch must have a key in every row")
        if low is not None and last is not None and low <= last:
            raise ValueError("a batch must have keys over those of the index")
        number = self.state["made"]
        texts = list(self.state["texts"])
        if keep_texts:
            texts.append(f"{self.base}/texts-{number:05d}-{uuid.uuid4().hex[:8]}")
            batch.select("key", "text").write.option("compression", "zstd").parquet(texts[-1])
        packed = anchors.scan(batch, anchors.word_tokens, self.state["n"], self.state["k"], self.state["buckets"], False)
        runs, own = list(self.state["runs"]), f"run-{number:05d}-{uuid.uuid4().hex[:8]}"
        level, gone = 0, []
        while len(full := [r for r in runs if self.state["levels"][r] == level]) >= FANIN:
            level, gone = level + 1, [*gone, *full]
        found = self._match(packed, runs, gone, own)
        anchors.release(self.spark)
        runs = [r for r in [*runs, own] if r not in gone]
        levels = {r: self.state["levels"].get(r, level) for r in runs}
        return found, {**self.state, "made": number + 1, "runs": runs, "levels": levels, "texts": texts, "last": high if high is not None else last}

    def _adopt(self, state: dict) -> None:
        """Commit a prepared batch; runs that it has merged go."""
        gone = [r for r in self.state["runs"] if r not in state["runs"]]
        self.state = state
        self._commit()
        fs, root = pafs.FileSystem.from_uri(self.base)
        for r in gone:  # a batch without windows has left none
            if fs.get_file_info(f"{root}/{r}").type == pafs.FileType.Directory:
                fs.delete_dir(f"{root}/{r}")

    def _match(self, packed: DataFrame, runs: list[str], gone: list[str], own: str) -> DataFrame:
        """Match with all runs and write the batch's own, into which those that go are merged."""
        base, compact = self.base, bool(gone)

        def bucket(rows: pa.Table) -> pa.Table:
            out = matched(rows)
            released()
            return out

        def matched(rows: pa.Table) -> pa.Table:
            number = rows.column("bucket")[0].as_py()
            new, known = anchors.unpack(rows)
            if number < 0:
                return anchors.found([known], np.zeros(0, anchors.RUN))
            fs, root = pafs.FileSystem.from_uri(base)
            new, repeat, first = anchors.settle(new, False)
            settled = [known, anchors.repeats_of(new[repeat], new[first[repeat]])]
            new = new[~repeat]
            history = [read_run(fs, f"{root}/{r}/{number:05d}", number) for r in runs]
            seen, near, partners = np.zeros(len(new), bool), anchors.to_compare(new), []
            for old in history:
                at = known_in(old, new)
                hit = (at >= 0) & ~seen
                settled.append(anchors.repeats_of(new[hit], old[at[hit]]))
                seen |= hit
                here, there = anchored_in(old, new)
                near |= here
                partners.append(old[there])
            fresh = new[~seen]
            fs.create_dir(f"{root}/{own}", recursive=True)
            keep = fresh
            for r, old in zip(runs, history, strict=True):
                if r in gone:
                    keep = merge(old, keep)
            write_run(fs, f"{root}/{own}/{number:05d}", keep)
            # partners matter where something new shares their anchor
            asked = np.isin(new["g"], fresh["g"][near[~seen]])
            partners = [p[np.isin(p["g"], fresh["g"])] for p in partners]
            return anchors.found(settled, np.concatenate([new[asked & ~seen], *partners]))

        if compact:  # a bucket that gets nothing new must still carry its history over
            every = self.spark.range(self.state["buckets"])
            nothing = [F.lit(b"").alias(k) for k in (*anchors.FIELDS, "src", "at")]
            packed = packed.unionByName(every.select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("n"), *nothing))
        return stored(packed.groupBy("bucket").applyInArrow(bucket, anchors.FOUND), "word-runs")

    def texts(self, state: dict | None = None) -> DataFrame:
        """(key, text) of all batches whose texts the index keeps, as its state or another has it."""
        return self.spark.read.schema("key long, text string").parquet(*(state or self.state)["texts"])

    def confirmed(self, found: DataFrame, documents: DataFrame | None = None) -> DataFrame:
        """Candidates (doc, lo, len, src, at) from what ``add`` gave; documents: (key, text) of all batches, if the index has no texts."""
        documents = self.texts() if documents is None else documents
        more = stored(compared(documents, found.where("kind = 1"), self.state["n"], self.state["buckets"]), "word-windows")
        anchors.release(self.spark)
        return found.unionAll(more).where("kind = 0").select("doc", "lo", "len", "src", "at")

    def drop(self) -> None:
        fs, root = pafs.FileSystem.from_uri(self.base)
        if fs.get_file_info(root).type == pafs.FileType.Directory:
            fs.delete_dir(root)


def _cut(text: bytes, ranges: list[tuple[int, int]]) -> Iterator[bytes]:
    words = text.split()
    return (b" ".join(words[a:z]) for a, z in ranges)


def _texts(words: list[bytes], n: int, many: int) -> Iterator[bytes]:
    return (b" ".join(words[k : k + n]) for k in range(many))


def _windows(n: int, buckets: int):
    """The windows to verify, each by a digest of its words, packed by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count = [np.zeros(0, anchors.RUN)], 0
        for b in batches:
            rows = zip(*(b.column(c).to_pylist() for c in ("doc", "lo", "len", "text")), strict=True)
            held.append(anchors.window_runs(((doc, lo, _texts(text.split(b" "), n, many)) for doc, lo, many, text in rows), buckets))
            count += len(held[-1])
            if count >= anchors.HELD:
                yield anchors.packed(held, False, buckets)
                held, count = [held[0]], 0
        if count:
            yield anchors.packed(held, False, buckets)

    return run


def compared(documents: DataFrame, compare: DataFrame, n: int, buckets: int) -> DataFrame:
    """Rows of ``anchors.FOUND``: the windows of compared runs that occur in an earlier document too."""
    windows = anchors.snippets(documents, compare, _cut, n).mapInArrow(trimmed(_windows(n, buckets)), anchors.PACKED)
    return anchors.matched(windows, False)


def cuts_of(documents: DataFrame, batches: int) -> list[tuple[int | None, int | None]]:
    """Key ranges (above, up to) of about equally many documents each."""
    at = documents.agg(F.percentile_approx("key", [k / batches for k in range(1, batches)])).first()[0] or []
    edges = [None, *sorted(set(at)), None]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _apply(n: int, texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in range(4)]
            for text, starts in zip(utf8(b.column("text")), b.column("starts").to_pylist(), strict=True):
                words = text.split()
                # the words decide: a range that isn't what stands at its first place is no repeat
                same = [(s["lo"], s["len"]) for s in starts or () if b" ".join(words[s["lo"] : s["lo"] + s["len"] + n - 1]) == s["piece"]]
                kept, at = [], 0
                for a, z in anchors.covered(same, n, len(words)):
                    kept += words[at:a]
                    at = z
                kept += words[at:]
                left = b" ".join(kept)
                for column, v in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left if texts else None), strict=True):
                    column.append(v)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(out, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *arrays[:3], arrays[3].cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "text"])

    return run


def without(rows: DataFrame, documents: DataFrame, candidates: DataFrame, n: int, texts: bool) -> DataFrame:
    """rows (doc_id, key, text) less the words of verified candidates."""
    return anchors.with_checked(rows, documents, candidates, _cut, n, "word").mapInArrow(trimmed(_apply(n, texts)), COLUMNS)


def deduplicate(docs: DataFrame, n: int = WORDS, k: int = GRAM, batches: int = BATCHES, texts: bool = True) -> DataFrame:
    """Per row: doc_id, n_words, n_removed, kept_sha256 and, if asked for, the words left as ``text``.

    The table goes through an index of its own, batch by batch; candidates are verified together.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows, documents = anchors.keyed(docs)
    index = Index.create(spark, fresh_path(spark, "substring-index"), shares(docs, 4), n, k)
    found = None
    for above, upto in cuts_of(documents, batches):
        batch = documents
        if above is not None:
            batch = batch.where(F.col("key") > above)
        if upto is not None:
            batch = batch.where(F.col("key") <= upto)
        part = index.add(batch, keep_texts=False)
        found = part if found is None else found.unionAll(part)
    candidates = index.confirmed(found, documents)
    index.drop()
    return without(rows, documents, candidates, n, texts)


def deduplicate_batch(index: Index, docs: DataFrame, texts: bool = True) -> DataFrame:
    """The same for one more batch (doc_id, text) of an index: against all before it, in this session or others.

    Ids must be unique, there, and over those of the index; they are the keys. The
    result is stored before the manifest names the batch, so one that fails
    anywhere can be given again.
    """
    small_batches(index.spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("doc_id").cast("long").alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    last = index.state["last"]
    found, state = index._prepared(rows.select("key", "text"), keep_texts=True)
    documents = index.texts(state)
    candidates = index.confirmed(found, documents)
    if last is not None:  # windows of earlier documents were compared along
        candidates = candidates.where(F.col("doc") > last)
    out = stored(without(rows, documents, candidates, index.state["n"], texts), "word-batch")
    index._adopt(state)
    return out


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), texts=False).drop("text")


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
 win AS (SELECT doc_id, unnest(range(1, len(words) - 11)) AS i, words FROM w),
 keyed AS (SELECT doc_id, i, array_to_string(words[i:i + 12], ' ') AS k FROM win),
 firsts AS (SELECT k, min(doc_id) AS low FROM keyed GROUP BY k),
 hit AS (SELECT doc_id, i FROM keyed JOIN firsts USING (k) WHERE doc_id > low),
 gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM hit),
 each AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
 kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.p) AS text, count(*) AS n FROM each e ANTI JOIN gone g ON e.doc_id = g.doc_id AND e.p = g.p GROUP BY e.doc_id)
SELECT w.doc_id, len(words) AS n_words, len(words) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id
"""
