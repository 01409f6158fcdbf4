"""Token-ID files: flat unsigned integers beside 64-bit document offsets.

A corpus is written as one pair of files per partition, documents in ascending
id order within and across partitions:

``part-00007.bin``  token ids, little-endian, 2 bytes each if the vocabulary
                    fits, else 4
``part-00007.idx``  magic ``TFIDS1``, one byte width, one byte zero, a 64-bit
                    document count n, n + 1 64-bit offsets in ids (the first is
                    0), n 64-bit document ids, n bytes that are 1 where the id
                    is null

The position of a partition in the whole stream, its base, is the prefix sum
of the counts that the writing tasks report (one row each). Files get their
names by a rename once they are complete, so a retried task leaves whole
files. Readers map the files into memory where the file system is local.

Encoding gives what the library gives for the whole text without special
tokens around it; an added token that occurs in a text is that token. A byte-level BPE with this kind of split pattern never joins a
non-space character and a following single space. So texts are cut before
single spaces between other characters, and each distinct cut is encoded once
by the library, many to a call; a bounded cache keeps the ids as bytes.

Defined cases: null or empty text is the end id alone; a null id sorts first;
rows that repeat an id are written each, ordered by a hash of their text; an
empty table gives files without documents; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, larger, partitions, publish, small_batches, stored, table

MAGIC = b"TFIDS1"
END_ID = 2
CACHE = 500_000  # words kept by a worker
HELD_MB = 24  # text encoded at once
MARKS = ".,;:!?*$%&#|"
LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏ]+")
LETTER_LAST = "[A-Za-zÀ-ÖØ-öø-ɏ]$"
WHITE = re.compile(r"[^\S \n]")  # white space beside spaces and line ends
COLUMNS = "doc_id long, start long, n_tokens long, ids_crc32 long"


class CutEncoder:
    """Encodes whole texts with a tokenizers file, by cuts at single spaces."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = f"<u{self.width}"
        self.known: dict[str, bytes] = {}
        # a text that holds an added token goes to the library whole
        added = sorted((t.content for t in self.tokenizer.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = re.compile("|".join(map(re.escape, added)) or r"(?!)")
        # a byte-level model names bytes by printable characters: its own where it has one, else the next free
        names = [b if 33 <= b <= 126 or 161 <= b <= 255 and b != 173 else None for b in range(256)]
        spare = iter(range(256, 512))
        self.alphabet = {b: next(spare) if n is None else n for b, n in enumerate(names)}
        space = chr(self.alphabet[32])
        del self.alphabet[9]
        self.after_space = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.after_space[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.startswith(space)]] = True
        self.direct = None
        if self.tokenizer.normalizer is None and isinstance(self.tokenizer.pre_tokenizer, pre_tokenizers.ByteLevel):
            self.direct = Tokenizer(self.tokenizer.model)
            self.direct.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\t")

    def plain(self, text: str) -> bool:
        """Whether every space of a text is the place of a cut."""
        return text[:1] != " " and text[-1:] != " " and "  " not in text and "\n " not in text and " \n" not in text and not WHITE.search(text) and not self.added.search(text)

    def _each(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for k in range(0, len(texts), 4096):
            out += [np.array(e.ids, self.kind).tobytes() for e in self.tokenizer.encode_batch_fast(texts[k : k + 4096], add_special_tokens=False)]
        return out

    def _learn(self, words: list[str]) -> None:
        """Add the ids of words after a space."""
        letters = [w for w in words if LETTERS.fullmatch(w)] if self.direct else []
        for k in range(0, len(letters), 1 << 16):
            self._learn_letters(letters[k : k + (1 << 16)])
        if letters:
            words = [w for w in words if w not in self.known]
        self.known.update(zip(words, self._each([" " + w for w in words]), strict=True))

    def _learn_letters(self, words: list[str]) -> None:
        """Words of letters are a piece each: the model gets them as such, between tabs."""
        mapped = (" " + "\t ".join(words)).encode().decode("latin-1").translate(self.alphabet)
        parts, at = [], 0
        while at < len(mapped):
            end = mapped.find("\t", at + (1 << 13))
            end = len(mapped) if end < 0 else end
            parts.append(mapped[at:end])
            at = end + 1
        ids = np.concatenate([np.array(e.ids, self.kind) for e in self.direct.encode_batch_fast(parts, add_special_tokens=False)])
        first = np.flatnonzero(self.after_space[ids])
        if len(first) != len(words):
            raise ValueError("the vocabulary has pieces with a space inside")
        data, cuts = ids.tobytes(), [*(first * self.width).tolist(), len(ids) * self.width]
        self.known.update((w, data[a:z]) for w, a, z in zip(words, cuts[:-1], cuts[1:], strict=True))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin, with the end."""
        if len(self.known) > CACHE:
            self.known.clear()
        texts = [x or "" for x in texts]
        cut = [self.plain(x) for x in texts]
        lists = pc.split_pattern(pa.array([x if p else "" for x, p in zip(texts, cut, strict=True)], pa.large_string()), " ")
        words, first = lists.values.dictionary_encode(), lists.offsets.to_numpy()[:-1]
        index = words.indices.to_numpy()
        # marks after a Latin letter are a piece of their own, so the part before is encoded once
        core = pc.utf8_rtrim(words.dictionary, MARKS)
        core = pc.if_else(pc.match_substring_regex(core, LETTER_LAST), core, words.dictionary).dictionary_encode()
        cores = core.dictionary.to_pylist()
        size = pc.utf8_length(core.dictionary).to_numpy(zero_copy_only=False)[core.indices.to_numpy()]
        tails = pa.array([w[n:] for w, n in zip(words.dictionary.to_pylist(), size.tolist(), strict=True)], pa.large_string()).dictionary_encode()
        self._learn([c for c in cores if c and c not in self.known])
        # the first word of a text has no space before it; a text with other cuts is encoded whole
        lead = [self.known[c] if c else b"" for c in cores]
        rest = self._each(tails.dictionary.to_pylist())
        data = [lead[a] + rest[z] for a, z in zip(core.indices.to_pylist(), tails.indices.to_pylist(), strict=True)]
        known = len(data)
        data += self._each([x.split(" ", 1)[0] if p else x for x, p in zip(texts, cut, strict=True)])
        index = index.astype(np.int32)
        index[first] = known + np.arange(len(texts), dtype=np.int32)
        flat = np.frombuffer(b"".join(data), self.kind)
        many = np.array([len(x) for x in data], np.int32) // self.width
        start, many = (np.cumsum(many, dtype=np.int32) - many)[index], many[index]
        ends = np.cumsum(many, dtype=np.int32)
        start -= ends
        start += many
        total = int(ends[-1]) if len(ends) else 0
        take = np.repeat(start, many)
        take += np.arange(total, dtype=np.int32)
        return flat[take], np.append((ends - many)[first], total).astype(np.int64)


_encoders: dict[str, CutEncoder] = {}


def encoder(path: str) -> CutEncoder:
    if path not in _encoders:
        _encoders[path] = CutEncoder(path)
    return _encoders[path]


def _writer(base: str, vocabulary: str, end_id: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        part, own = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        enc = encoder(vocabulary)
        name, temp = f"{root}/part-{part:05d}", f"{root}/.part-{part:05d}-{own}"
        lengths, ids, nulls = [], [], []
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(f"{temp}.bin") as out:
            for b in larger(batches, HELD_MB << 20):
                ids_of, cut = enc.encode(b.column("text").to_pylist())
                whole = np.insert(ids_of, cut[1:], end_id)
                out.write(whole.tobytes())
                lengths.append(np.diff(cut) + 1)
                got = b.column("doc_id").cast(pa.int64())
                nulls.append(np.asarray(got.is_null()))
                ids.append(np.asarray(got.fill_null(0)))
        lengths = np.concatenate([np.zeros(0, np.int64), *lengths])
        offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
        with fs.open_output_stream(f"{temp}.idx") as out:
            out.write(MAGIC + bytes([enc.width, 0]) + np.array([len(lengths)], "<u8").tobytes() + offsets.tobytes())
            out.write(np.concatenate([np.zeros(0, np.int64), *ids]).astype("<i8").tobytes())
            out.write(np.concatenate([np.zeros(0, bool), *nulls]).astype("u1").tobytes())
        for end_of in (".bin", ".idx"):
            publish(fs, f"{temp}{end_of}", f"{name}{end_of}")
        yield pa.RecordBatch.from_pydict({"part": [part], "n_docs": [len(lengths)], "n_tokens": [int(offsets[-1])]})

    return write


def write_token_ids(docs: DataFrame, base: str, vocabulary: str, end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """Write the files under ``base``; gives the manifest (part, n_docs, n_tokens, base_docs, base_tokens)."""
    spark = docs.sparkSession
    small_batches(spark)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    ranged = keyed.repartitionByRange(parts or partitions(spark), "doc_id", "h").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    counts = stored(ranged.mapInArrow(_writer(base, vocabulary, end_id), "part long, n_docs long, n_tokens long"), "ids-counts")
    before = Window.partitionBy(F.lit(1)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumns({f"base_{k}": F.coalesce(F.sum(f"n_{k}").over(before), F.lit(0)) for k in ("docs", "tokens")})


def _bytes_of(fs, path: str) -> np.ndarray:
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_buffer(), np.uint8)


def open_part(fs, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, doc ids, null marks) of one partition, mapped where possible."""
    idx = _bytes_of(fs, f"{name}.idx")
    if idx[:6].tobytes() != MAGIC:
        raise ValueError(f"{name}.idx is no token-id index")
    width, n = int(idx[6]), int(idx[8:16].view("<u8")[0])
    offsets = idx[16 : 24 + 8 * n].view("<u8")
    doc_ids = idx[24 + 8 * n : 24 + 16 * n].view("<i8")
    return _bytes_of(fs, f"{name}.bin").view(f"<u{width}"), offsets, doc_ids, idx[24 + 16 * n : 24 + 17 * n]


def _reader(base: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        for b in batches:
            for part, first in zip(b.column("part").to_pylist(), b.column("base_tokens").to_pylist(), strict=True):
                ids, offsets, doc_ids, nulls = open_part(fs, f"{root}/part-{part:05d}")
                for at in range(0, len(doc_ids), 8192):
                    to = min(at + 8192, len(doc_ids))
                    cut = offsets[at : to + 1].astype(np.int64)
                    crc = [zlib.crc32(ids[a:z].astype("<u4")) for a, z in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.array(doc_ids[at:to]), mask=np.array(nulls[at:to]) > 0), pa.array(cut[:-1] + first), pa.array(np.diff(cut)), pa.array(crc, pa.int64())],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return read


def read_token_ids(manifest: DataFrame, base: str) -> DataFrame:
    """Per document, from the files: where its ids start, how many, and their checksum."""
    return manifest.select("part", "base_tokens").repartition(partitions(manifest.sparkSession)).mapInArrow(_reader(base), COLUMNS)


def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    base = fresh_path(spark, "token-ids")
    manifest = write_token_ids(table(spark, sf_dir, "documents"), base, public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_ids(manifest, base)
