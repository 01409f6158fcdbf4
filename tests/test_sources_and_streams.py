import json
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallyforge.config import Config
from tallyforge.plans.pipeline import analyse
from tallyforge.sources import files, sinks
from tallyforge.sources.directory import directory_of
from tallyforge.streaming.ingest import analyse_batch, ingest, read_errors, read_history, read_reports

PAGE = "Acme Corporation\n500 Technology Dr\nSeattle\nTax ID: 12-3456780\nInvoice #: A-1\nTotal: $1,000.00\n"


def test_file_scan_limits_and_errors(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"x" * 50)
    (tmp_path / "c.bin").write_bytes(b"")
    df = files.scan_files(spark, str(tmp_path), "*.bin", Config(max_bytes=10))
    good, bad = sinks.split_errors(df)
    assert {r.error for r in bad.collect()} == {"too large"} and good.count() == 1

    def provider(content, path):
        if content == b"abc":
            raise OSError("no text")
        return "t"

    assert [r.raw_text for r in files.with_text(good, provider).collect()] == [""]
    assert [r.raw_text for r in files.with_text(good, None).collect()] == [""]
    page = files.with_pages(good, lambda content, path: (1, 1, content)).first().page
    assert bytes(page.pixels) == b"abc" and page.error is None
    broken = files.with_pages(good, lambda content, path: 1 / 0).first().page
    assert broken.error.startswith("ZeroDivisionError")


def test_texts_to_reports(spark, tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "1.txt").write_text(PAGE)
    df = files.scan_texts(spark, str(tmp_path / "t")).withColumns({"seq": F.lit(1).cast("long"), "invoice_id": F.lit("i"), "content_hash": F.sha2("raw_text", 256), "vision": F.lit("{}")})
    out = analyse(df, directory_of(spark))
    assert (out.first().risk_level, out.first().risk_score) == ("LOW", 0.0)
    sinks.write_reports(out.select("invoice_id", "risk_level", F.lit(None).cast("string").alias("warning")), str(tmp_path / "out"))
    line = next(p for p in (tmp_path / "out").glob("part-*") if p.stat().st_size).read_text()
    assert json.loads(line) == {"invoice_id": "i", "risk_level": "LOW", "warning": None}


def test_stream_sees_history_and_its_own_batch(spark, tmp_path):
    columns = "seq long, invoice_id string, content_hash string, vendor_name string, vendor_address string, vendor_tax_id string, total double, invoice_date date"
    row = lambda k, h, total: (k, f"i{k}", h, "Acme Corporation", "500 Technology Dr", "12-3456780", total, None)
    source, ledger = str(tmp_path / "in"), str(tmp_path / "ledger")
    for part in ([row(1, "a", 5.0), row(2, "a", 9.0)], [row(3, "b", 9.0), row(4, "a", 1.0)]):
        spark.createDataFrame(part, columns).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(columns).parquet(source)
        ingest(stream, ledger, str(tmp_path / "checkpoint"), directory_of(spark)).awaitTermination()
    got = {r.seq: [s.code for s in r.signals] for r in read_reports(spark, ledger).collect()}
    assert got == {1: [], 2: ["DUP_EXACT_FILE_HASH"], 3: ["DUP_FUZZY_MATCH"], 4: ["DUP_EXACT_FILE_HASH"]}
    assert read_history(spark, ledger).count() == 4


def test_images_come_as_rgb(spark):
    df = spark.createDataFrame([(1, 1, 3, bytes([1, 2, 3])), (1, 1, 1, b"\x07")], "height int, width int, channels int, data binary")
    assert [bytes(r.pixels) for r in files.as_rgb(df).collect()] == [bytes([3, 2, 1]), b"\x07\x07\x07"]


def test_ids_and_fallback_text(spark):
    df = spark.createDataFrame([(3, "abcdef0123", "", "t"), (4, "abcdef0123", None, None), (5, "ff", "own", "t")], "seq long, content_hash string, raw_text string, other string")
    assert [r.invoice_id for r in files.with_ids(df).collect()] == ["abcdef01-3", "abcdef01-4", "ff-5"]
    assert [r.raw_text for r in files.with_fallback(df, "raw_text", "other").collect()] == ["t", "", "own"]


def test_uploads(spark):
    columns = "request_id int, filename string, content binary"
    rows = [(1, "a.pdf", b"abc"), (2, None, None), (3, "", b"x"), (4, "b", b"y" * 20), (5, "c", b"")]
    got = {r.request_id: (r.status, r.length) for r in files.checked_uploads(spark.createDataFrame(rows, columns), Config(max_bytes=10)).collect()}
    assert got == {1: ("ok", 3), 2: ("no file field", None), 3: ("empty file name", 1), 4: ("too large", 20), 5: ("ok", 0)}
    rows = [(1, "a", b"a"), (1, "", b"b"), (1, "c", b"c"), (2, "", b"d"), (2, None, None), (3, "e", b"y" * 20)]
    got = files.checked_batches(spark.createDataFrame(rows, columns), Config(max_bytes=10))
    assert sorted((r.request_id, r.path or "", r.status) for r in got.collect()) == [(1, "a", "ok"), (1, "c", "ok"), (2, "", "no files"), (3, "e", "too large")]
    assert got.columns == ["request_id", "path", "content", "length", "content_hash", "status"]


def test_images_that_do_not_decode_are_error_rows(spark, tmp_path):
    import numpy as np

    from tallyforge.operators.jpeg import encode

    (tmp_path / "good.jpg").write_bytes(encode(np.full((8, 8, 3), 200, np.uint8)))
    (tmp_path / "bad.jpg").write_bytes(b"no image")
    good, bad = sinks.split_errors(files.scan_images(spark, str(tmp_path)))
    assert [(r.height, r.width, len(r.pixels)) for r in good.collect()] == [(8, 8, 192)]
    (row,) = bad.collect()
    assert row.path.endswith("bad.jpg") and row.error == "not an image"


def test_pages_and_texts_of_providers(spark):
    df = spark.createDataFrame([(b"2", "a.PDF"), (b"0", "b.pdf"), (b"9", "c.txt")], "content binary, path string")
    pages = lambda content, path: ((1, 1, bytes([k] * 3)) for k in range(int(content)))
    got = {r.path: r.page for r in files.with_pages(df, pages, suffix=".pdf").collect()}
    assert bytes(got["a.PDF"].pixels) == bytes(3) and got["b.pdf"].error == "ValueError: no pages" and got["c.txt"] is None
    assert bytes(files.with_pages(df, pages, limit=2).where("path = 'a.PDF'").first().page.pixels) == bytes([1] * 3)

    def ocr(content, path):
        if path == "b.pdf":
            raise RuntimeError("no such program")
        return "" if path == "c.txt" else "seen"

    def tokens(content, path):
        assert path != "a.PDF"  # only rows without text
        return f"tokens {path}"

    out = files.with_token_text(files.with_text(df, ocr, warning="w"), tokens)
    assert {r.path: (r.raw_text, r.w) for r in out.collect()} == {"a.PDF": ("seen", None), "b.pdf": ("tokens b.pdf", "RuntimeError: no such program"), "c.txt": ("tokens c.txt", None)}
    assert {r.raw_text for r in files.with_token_text(files.with_text(df, None), None).collect()} == {""} and out.columns == ["content", "path", "raw_text", "w"]


def test_vision_client(spark):
    import time

    from tallyforge.operators.vision import vision_signals, with_answers

    answer = json.dumps({"findings": [{"code": "LOGO_QUALITY", "description": "blurred", "confidence": 0.5}]})

    def client(images):
        assert len(images) <= 2
        if "down" in images:
            raise RuntimeError("not installed")
        if "bad" in images:
            raise OSError("refused")
        return [answer for _ in images]

    rows = [(1, "x"), (2, "y"), (3, "down"), (4, None), (5, "bad")]
    df = spark.createDataFrame(rows, "id int, data_url string").coalesce(1)
    got = {r.id: r for r in vision_signals(with_answers(df, client, batch=1), "id", "vision").collect()}
    assert [[s.code for s in got[k].vision_signals] for k in range(1, 6)] == [["LOGO_QUALITY"], ["LOGO_QUALITY"], [], [], []]
    assert got[3].vision_warning == "RuntimeError: not installed" and got[3].vision_error is None
    assert got[5].vision_error == "OSError: refused" and got[4].vision_warning is got[4].vision_error is None
    assert with_answers(df, None).where("vision is null").count() == 5
    start = time.monotonic()
    with_answers(df.where("id < 3"), client, batch=1, per_minute=60).collect()
    assert time.monotonic() - start >= 1.0


def test_files_to_reports(spark, tmp_path):
    from tallyforge.plans.pipeline import analyse_files

    folder = tmp_path / "files"
    folder.mkdir()
    (folder / "1.txt").write_text(PAGE)
    (folder / "2.txt").write_text(PAGE)
    (folder / "3.txt").write_text("x" * 5000)
    (folder / "4.txt").write_text("scan")
    (folder / "5.txt").write_text("fails")

    def text(content, path):
        if content == b"scan":
            raise OSError("no text layer")
        return content.decode()

    def pages(content, path):
        return None if content == b"fails" else (8, 8, bytes([200]) * 192)

    def client(images):
        raise RuntimeError("not installed")

    scanned = files.scan_files(spark, str(folder), config=Config(max_bytes=1000))
    out = analyse_files(scanned, directory_of(spark), text=text, pages=pages, client=client)
    got = {r.path[-5:]: r for r in out.collect()}
    assert [s.code for s in got["2.txt"].signals] == ["DUP_EXACT_FILE_HASH"] and got["1.txt"].signals == [] and got["1.txt"].risk_level == "LOW"
    assert got["3.txt"].error == "too large" and got["3.txt"].risk_level is None and got["5.txt"].error.startswith("TypeError")
    assert got["4.txt"].warnings == ["OSError: no text layer", "RuntimeError: not installed"] and got["4.txt"].error is None
    assert len(analyse_files(scanned, directory_of(spark), text=text).where("error is null").collect()) == 4


INVOICES = "seq long, invoice_id string, content_hash string, vendor_name string, vendor_address string, vendor_tax_id string, total double, invoice_date date"


def test_failed_rows_stay_out_of_history_and_batches_replay(spark, tmp_path):
    row = lambda k, h, e=None: (k, f"i{k}", h, "Acme Corporation", "500 Technology Dr", "12-3456780", float(k), None, e)
    ledger = str(tmp_path / "ledger")
    first, second = [row(1, "a"), row(2, "b", "no pages")], [row(3, "a"), row(4, "b")]
    for number, part in ((0, first), (1, second), (0, first), (1, second)):  # both come again
        analyse_batch(spark.createDataFrame(part, f"{INVOICES}, error string"), number, ledger)
    got = {r.seq: [s.code for s in r.signals if s.source == "duplicate"] for r in read_reports(spark, ledger).collect()}
    assert got == {1: [], 3: ["DUP_EXACT_FILE_HASH"], 4: []}
    assert sorted(r.seq for r in read_history(spark, ledger).collect()) == [1, 3, 4]
    assert [tuple(r)[::2] for r in read_errors(spark, ledger).collect()] == [(2, "no pages")]


def test_a_batch_that_fails_midway_leaves_the_old_snapshot(spark, tmp_path, monkeypatch):
    """Reports are written, then the history's part fails: neither is seen, and the batch can come again."""
    from tallyforge.sources.ledger import Commit, Ledger

    ledger = str(tmp_path / "ledger")
    batch = lambda k: spark.createDataFrame([(k, f"i{k}", "same", "Acme", "500 Technology Dr", None, 1.0, None)], INVOICES)
    analyse_batch(batch(1), 0, ledger)
    write = Commit.add

    def broken(self, table, df):
        if table == "history":
            raise OSError("disk is gone")
        return write(self, table, df)

    with monkeypatch.context() as m:
        m.setattr(Commit, "add", broken)
        with pytest.raises(OSError):
            analyse_batch(batch(2), 1, ledger)
    assert [r.seq for r in read_reports(spark, ledger).collect()] == [1] == [r.seq for r in read_history(spark, ledger).collect()]
    analyse_batch(batch(2), 1, ledger)
    assert sorted(r.seq for r in read_reports(spark, ledger).collect()) == [1, 2] == sorted(r.seq for r in read_history(spark, ledger).collect())
    book = Ledger(spark, ledger)
    assert book.compact("history") == 2 and book.vacuum(1) and sorted(r.seq for r in read_history(spark, ledger).collect()) == [1, 2]
    analyse_batch(batch(3), 2, ledger)
    assert {r.seq: r.signals[0].evidence.matched_invoice_id for r in read_reports(spark, ledger).where("seq > 1").collect()} == {2: "i1", 3: "i1"}


def stream_rows(n, seed):
    """Rows with repeated hashes, like names, amounts near each other and at edges of buckets, some without each."""
    import random

    rng = random.Random(seed)
    names = ["Acme", "Acme Corp", "Acme Widgets", "Widgets Acme Tools", "Inc", "inc", None, "", "Beta Acme", "Globex", "GLOBEX llc"]
    totals = [None, 10.0, 10.01, 10.02, 10.09, 10.1, 10.11, 10.2, 0.0, -3.0, -3.01, 1e9, 99.995, 100.005]
    days = [None, date(2024, 1, 1), date(2024, 1, 31), date(2024, 2, 1)]
    seqs = rng.sample(range(10 * n), n)
    return [(k, f"i{k}", rng.choice([None, f"h{k}", f"h{k % 37}"]), rng.choice(names), None, None, rng.choice(totals), rng.choice(days)) for k in seqs]


@pytest.mark.parametrize("kind", ["tokens", "sequence"])
def test_state_finds_what_the_history_join_finds(spark, tmp_path, kind):
    """Batches in any order of seq: the stream's reports are those of batches joined with the ledger's history."""
    config = Config(name_similarity=kind)
    rows, source = stream_rows(120, 4), str(tmp_path / "in")
    for number, at in enumerate((0, 40, 80)):
        part = spark.createDataFrame(rows[at : at + 40], INVOICES)
        part.coalesce(1).write.mode("append").parquet(source)
        ingest(spark.readStream.schema(INVOICES).parquet(source), str(tmp_path / "stream"), str(tmp_path / "checkpoint"), config=config).awaitTermination()
        analyse_batch(part, number, str(tmp_path / "joined"), config=config)
    found = lambda path: {r.seq: [(s.code, s.confidence, s.evidence.matched_invoice_id, s.evidence.vendor_similarity_pct) for s in r.signals if s.source == "duplicate"] for r in read_reports(spark, str(tmp_path / path)).collect()}
    got = found("stream")
    assert got == found("joined") and len(got) == 120 and sum(map(len, got.values())) > 30


def test_state_keeps_what_a_batch_reads_flat(spark, tmp_path):
    """Twenty batches of one size: the last read no more of the state than the first ones, and nothing else grows."""
    source, read = str(tmp_path / "in"), []
    for k in range(20):
        rows = [(k * 50 + j, f"i{k * 50 + j}", f"h{k * 50 + j}", f"Vendor{k * 50 + j} Only", None, None, float(k * 50 + j), None) for j in range(50)]
        spark.createDataFrame(rows, INVOICES).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(INVOICES).option("maxFilesPerTrigger", 1).parquet(source)
    query = ingest(stream, str(tmp_path / "ledger"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    for p in query.recentProgress:
        (state,) = p["stateOperators"]
        read.append((p["numInputRows"], state["customMetrics"]["rocksdbTotalBytesRead"] if "rocksdbTotalBytesRead" in state["customMetrics"] else state["customMetrics"]["rocksdbGetCount"]))
    assert len(read) == 20 and {n for n, _ in read} == {read[0][0]}
    assert max(b for _, b in read[15:]) <= 1.5 * max(b for _, b in read[1:6]) + 4096, read
    assert read_reports(spark, str(tmp_path / "ledger")).count() == 1000


class Handle:
    """A group's state in memory, which counts the calls to it."""

    def __init__(self):
        self.calls, self.map, self.list = 0, {}, []

    def getMapState(self, *args):
        return self

    def getListState(self, *args):
        return self

    def _called(self, out=None):
        self.calls += 1
        return out

    def exists(self):
        return self._called(bool(self.map))

    def getValue(self, key):
        return self._called(self.map.get(key))

    def updateValue(self, key, value):
        self._called(self.map.__setitem__(key, value))

    def get(self):
        return self._called(iter(self.list))

    def appendList(self, values):
        self._called(self.list.extend(values))

    def clear(self):
        self._called(self.list.clear())


def test_hashes_of_a_large_batch_go_in_few_calls(spark):
    """Batches of many hashes and of few, in any order of seq: the answers are the first rows so far; only few hashes go one by one."""
    import random

    from pyspark.sql import Row

    from tallyforge.streaming import state

    rng, handle, matcher, first, seqs = random.Random(3), Handle(), state.Matcher(), {}, rng_seqs(6000, 5)
    matcher.init(handle)
    for n in (1000, 1, 300, 2000, 5, 2, 900, 40, 1):
        rows = [(f"h{rng.randrange(2500)}", k, f"i{k}") for k in (seqs.pop() for _ in range(n))]
        had, handle.calls = set(first), 0
        for h, k, i in rows:
            first[h] = min(first.get(h, (k, i)), (k, i))
        events = [Row(hashes=[r[0] for r in part], seqs=[r[1] for r in part], ids=[r[2] for r in part]) for part in (rows[: n // 3], rows[n // 3 :]) if part]
        got = {r.content_hash: (r.seq, r.invoice_id) for r in matcher.handleInputRows(("h|0",), iter(events), None)}
        hashes = [r[0] for r in rows]
        assert got == {h: first[h] for h in hashes if h in had or hashes.count(h) > 1}
        if n == 1000 and not had:
            assert handle.calls <= 5 and not handle.map
        if n == 1:
            assert len(handle.map) == len(first) and not handle.list
    handle.calls = 0
    list(matcher.handleInputRows(("h|0",), iter([Row(hashes=["new"], seqs=[1], ids=["i"])]), None))
    assert handle.calls <= 4


def rng_seqs(n, seed):
    import random

    return random.Random(seed).sample(range(10 * n), n)


def test_events_go_by_names_and_shards_not_by_rows(spark, monkeypatch):
    """A partition sends one event a word for a name and amount, and one for a shard's hashes; none is lost where it holds little."""
    from tallyforge.streaming import state

    rows = [(k, f"i{k}", f"h{k}", "Acme Widgets", None, None, 10.0 + k % 2, None if k % 3 else date(2024, 1, 1)) for k in range(2000)]
    df = spark.createDataFrame(rows, INVOICES).coalesce(1)
    monkeypatch.setattr(state, "SHARDS", 8)
    got = state.events(df).collect()
    near = [r for r in got if r.kind is not None]
    assert sorted((r.seq, r.invoice_id, r.key, r.kind.total) for r in near) == sorted((k, f"i{k}", f"n|{at}|{word}", 10.0 + k) for k, at in ((0, 50), (1, 55)) for word in ("acme", "widgets"))
    packs = [r for r in got if r.hashes is not None]
    assert len(packs) == 8 and sorted(x for r in packs for x in zip(r.hashes, r.seqs, r.ids)) == sorted((f"h{k}", k, f"i{k}") for k in range(2000))

    import pandas as pd
    import pyarrow as pa

    monkeypatch.setattr(state, "HELD", 20)
    parts = [pd.DataFrame({"seq": [100 - k, k], "invoice_id": ["a", "b"], "vendor_name": [f"v{k % 30}", "same"], "total": [1.0, 2.0], "day": [None, k]}) for k in range(60)]
    kept = pd.concat(state.first_rows(iter(parts)))
    assert len(kept) < 120 and dict(kept.groupby("vendor_name")["seq"].min()) == {"same": 0} | {f"v{k}": 70 - k for k in range(30)}
    batches = [pa.RecordBatch.from_pydict({"key": [f"h|{k % 2}"] * 15, "seq": [k] * 15, "invoice_id": ["a"] * 15, "content_hash": ["b"] * 15}) for k in range(5)]
    out = [x for b in state.packed_rows(iter(batches)) for x in b.to_pylist()]
    assert sorted((x["key"], len(x["hashes"])) for x in out) == [("h|0", 15), ("h|0", 15), ("h|0", 15), ("h|1", 15), ("h|1", 15)]


def test_evaluation_file_and_images(spark, tmp_path):
    import numpy as np

    rows = [("clean", "LOW"), ("clean", "HIGH"), ("duplicate", "HIGH"), ("tampered", "LOW")]
    out = sinks.write_evaluation(spark.createDataFrame(rows, "label string, risk_level string"), str(tmp_path / "eval"), seed=42)
    (part,) = (tmp_path / "eval").glob("part-*")
    assert json.loads(part.read_text()) == out and (out["n"], out["seed"]) == (4, 42)
    assert out["label_distribution"]["clean"] == {"n": 2, "percent": 50.0} and (out["results"]["overall"]["tp"], out["results"]["overall"]["fp"]) == (1, 1)
    image = np.full((8, 8, 3), 90, np.uint8).tobytes()
    df = spark.createDataFrame([(1, 8, 8, image), (2, 9, 9, image)], "image_id int, height int, width int, pixels binary")
    sinks.write_images(df, str(tmp_path / "images"))
    got = {r.image_id: r.jpeg for r in spark.read.parquet(str(tmp_path / "images")).collect()}
    assert bytes(got[1][:2]) == b"\xff\xd8" and got[2] is None
