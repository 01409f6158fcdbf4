"""WARC archives compressed record by record with a dictionary of their own.

Each archive (``.warc.zst``) starts with a skippable frame that holds a
Zstandard dictionary, trained on ``TRAIN_MB`` of that archive's own records;
after it every record is one Zstandard frame, so that any record can be read
alone given the dictionary. Records lie in the order of their payload digests,
so those trained on are a sample that hangs on nothing else. A payload of at least ``MIN_REVISIT``
bytes is stored once, as the response with the largest page id; the others
with the same payload digest are revisit records that name it.

The html travels once, by page id and payload, to the archive that takes it. Which record
a page revisits is worked out beforehand on digests alone, aggregated per
digest before any join, so a payload with very many copies is one row there.

Defined cases: null html is an empty payload; rows that repeat a page id are
records of their own (with equal payloads all but one revisit the id); a null
page id is kept and comes last in choosing the response; an empty table gives
no archive; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_path, partitions, publish, small_batches, stored, table

MIN_REVISIT = 1000
TRAIN_MB = 4
DICT_KB = 110
LEVEL = 3
SKIPPABLE = 0x184D2A5D
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # RFC 4122, URLs
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
COLUMNS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def urn(page_id: int | None, digest: str, number: str = "") -> str:
    """A record's id; the one response that others revisit has no number."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'page:{page_id}:{digest}:{number}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, number: str = "") -> bytes:
    """One WARC/1.1 record, headers and block. number: tells records of one page and payload apart."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    own = number if revisit or len(payload) < MIN_REVISIT else ""
    head = [
        ("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", urn(page_id, digest, own)), ("WARC-Date", DATE),
        ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")), ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Page-Id", "" if page_id is None else str(page_id)), ("X-Payload-Length", str(len(payload))),
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if revisit:
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", urn(refers_to, digest)), ("X-Refers-To-Page", "" if refers_to is None else str(refers_to))]
    block = http if revisit else http + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return text.encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; the block must have its stated length."""
    top, _, rest = data.partition(b"\r\n\r\n")
    lines = top.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    n = int(head["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a record's block has another length than its header says")
    return head, rest[:n]


class ArchiveWriter:
    """Writes one archive; holds records back until the dictionary is trained."""

    def __init__(self, out):
        self.out, self.held, self.size, self.packer = out, [], 0, None

    def add(self, data: bytes) -> None:
        if self.packer:
            self.out.write(self.packer.compress(data))
            return
        self.held.append(data)
        self.size += len(data)
        if self.size >= TRAIN_MB << 20:
            self.start()

    def start(self) -> None:
        samples = [x[at : at + 8192] for x in self.held for at in range(0, len(x), 8192)]
        try:
            book = zstandard.train_dictionary(DICT_KB << 10, samples, steps=1, d=8, k=200).as_bytes()
        except zstandard.ZstdError:  # too few or too small records to train on
            book = b""
        if book:
            self.out.write(struct.pack("<II", SKIPPABLE, len(book)) + book)
        known = zstandard.ZstdCompressionDict(book) if book else None
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True)
        held, self.held = self.held, []
        for x in held:
            self.add(x)

    def close(self) -> None:
        if not self.packer and self.held:
            self.start()


def read_archive(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of an archive, frame by frame; memory is one record's and a buffer."""
    data, book = stream.read(8), None
    if len(data) == 8 and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        book = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", data[4:])[0]))
        data = b""
    opener = zstandard.ZstdDecompressor(dict_data=book) if book else zstandard.ZstdDecompressor()
    while True:
        data = data or stream.read(1 << 18)
        if not data:
            return
        one, parts = opener.decompressobj(), []
        while True:
            parts.append(one.decompress(data))
            data = one.unused_data if one.eof else stream.read(1 << 18)
            if one.eof:
                break
            if not data:
                raise ValueError("the archive ends inside a frame")
        yield parse(b"".join(parts))


def with_references(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, revisit, refers_to``, partitioned by page id and payload."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", body.alias("html"))
    keyed = keyed.withColumn("digest", F.sha1("html"))
    light = keyed.select("page_id", "digest", F.length("html").alias("n")).where(F.col("n") >= MIN_REVISIT)
    light = stored(light, "warc-digests")
    # one response per digest, whatever number of rows has it
    first = light.groupBy("digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("copies")).where("copies > 1")
    own = F.concat_ws(":", "digest", F.col("page_id").cast("string"))  # a null id is left out
    refers = light.join(first, "digest").groupBy(own.alias("__ref")).agg(F.max("holder").alias("holder"), F.lit(True).alias("__copied"))
    by_id = keyed.withColumn("__own", own).join(refers, F.col("__own") == F.col("__ref"), "left")
    # of rows with the holder's id and payload one is the response
    by_id = by_id.withColumn("__nth", F.row_number().over(Window.partitionBy("__own").orderBy("url")))
    revisits = F.coalesce((~F.col("page_id").eqNullSafe(F.col("holder")) | (F.col("__nth") > 1)) & F.col("__copied"), F.lit(False))
    return by_id.select("page_id", "url", "html", revisits.alias("revisit"), F.when(revisits, F.col("holder")).alias("refers_to"))


def _writer(base: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(base)
        part, own = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name, temp, n = f"{root}/part-{part:05d}.warc.zst", f"{root}/.part-{part:05d}-{own}", 0
        fs.create_dir(root, recursive=True)
        with fs.open_output_stream(temp, compression=None) as out:
            archive = ArchiveWriter(out)
            for b in batches:
                columns = [b.column(k).to_pylist() for k in ("page_id", "url", "html", "refers_to", "revisit")]
                for row in zip(*columns, strict=True):
                    archive.add(record(*row, number=f"{part}.{n}"))
                    n += 1
            archive.close()
        publish(fs, temp, name)
        yield pa.RecordBatch.from_pydict({"path": [name], "n": [n]})

    return write


def write_warc(pages: DataFrame, base: str) -> DataFrame:
    """Write the archives; gives (path, n) per archive."""
    small_batches(pages.sparkSession)
    return stored(with_references(pages).mapInArrow(_writer(base), "path string, n long"), "warc-files")


def _reader(base: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(base)
        kinds = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for head, block in read_archive(stream):
                        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        revisit = head["WARC-Type"] == "revisit"
                        if revisit:
                            n = int(head["X-Payload-Length"])
                        else:
                            payload = block.partition(b"\r\n\r\n")[2]
                            n = len(payload)
                            if hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"a payload in {path} doesn't match its digest")
                        rows.append((int(x) if (x := head["X-Page-Id"]) else None, n, digest, head["WARC-Type"], int(x) if revisit and (x := head["X-Refers-To-Page"]) else None))
                        if len(rows) >= 4096:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds.types, strict=True)], schema=kinds)

    return read


def read_warc(files: DataFrame, base: str) -> DataFrame:
    """One row per record of the archives."""
    return files.select("path").repartition(partitions(files.sparkSession)).mapInArrow(_reader(base), COLUMNS)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = fresh_path(spark, "warc")
    return read_warc(write_warc(table(spark, sf_dir, "pages"), base), base)


ORACLE_SQL = """
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN p.n >= 1000 AND p.page_id <> p.top THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.n >= 1000 AND p.page_id <> p.top THEN p.top END AS refers_to
FROM (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d,
             max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS top
      FROM pages) p
"""
