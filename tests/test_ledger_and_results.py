"""Ledgers of parts and manifests, and answers of providers kept by content."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tallyforge.plans.pipeline import analyse_files
from tallyforge.sources import files
from tallyforge.sources.directory import directory_of
from tallyforge.sources.ledger import Ledger
from tallyforge.sources.results import Results

ROWS = "k long, v string"


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_ledger_snapshots(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    assert ledger.version() == 0 and rows(ledger.read("a", ROWS)) == []
    with ledger.commit() as c:
        assert rows(c.add("a", spark.createDataFrame([(1, "x")], ROWS))) == [(1, "x")]
        c.add("b", spark.createDataFrame([(2, "y")], ROWS))
        assert rows(ledger.read("a", ROWS)) == []  # not yet
    opened = ledger.read("a", ROWS)
    with ledger.commit() as c:
        c.add("a", spark.createDataFrame([(3, "z")], ROWS))
    assert rows(opened) == [(1, "x")] and rows(ledger.read("a", ROWS)) == [(1, "x"), (3, "z")] and rows(ledger.read("b", ROWS)) == [(2, "y")]
    assert rows(ledger.read("a", ROWS, 1)) == [(1, "x")]


def test_ledger_commit_that_fails(spark, tmp_path):
    """Parts of a batch that failed are not seen, and go with the next upkeep."""
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    with ledger.commit(0) as c:
        c.add("a", spark.createDataFrame([(1, "x")], ROWS))
    with pytest.raises(ZeroDivisionError), ledger.commit(1) as c:
        c.add("a", spark.createDataFrame([(2, "y")], ROWS))
        1 / 0
    with pytest.raises(Exception, match="no such thing"), ledger.commit(1) as c:
        c.add("a", spark.range(1).select("id", F.raise_error(F.lit("no such thing")).cast("string")))
    assert ledger.version() == 1 and rows(ledger.read("a", ROWS)) == [(1, "x")]
    with ledger.commit(1) as c:
        c.add("a", spark.createDataFrame([(2, "z")], ROWS))
    with ledger.commit(1) as again, ledger.commit(0) as earlier:
        assert again is None and earlier is None
    assert rows(ledger.read("a", ROWS)) == [(1, "x"), (2, "z")] and ledger.version() == 2
    assert len(ledger.vacuum()) == 2 and rows(ledger.read("a", ROWS)) == [(1, "x"), (2, "z")]
    with pytest.raises(RuntimeError, match="another writer"), ledger.commit() as c, Ledger(spark, ledger.path).commit() as other:
        c.add("a", spark.createDataFrame([(5, "")], ROWS))
        other.add("a", spark.createDataFrame([(6, "")], ROWS))


def test_ledger_compaction(spark, tmp_path):
    ledger = Ledger(spark, f"file://{tmp_path}/ledger")
    for k in range(6):
        with ledger.commit(k) as c:
            c.add("a", spark.createDataFrame([(k, "x")] * 3, ROWS))
    before, old = rows(ledger.read("a", ROWS)), ledger.read("a", ROWS)
    assert ledger.compact("a") == 6 and ledger.compact("a") == 0
    (part,) = ledger.manifest()["tables"]["a"]
    assert rows(ledger.read("a", ROWS)) == before == rows(old) and part["bytes"] > 0 and ledger.manifest()["batch"] == 5
    assert len(list((tmp_path / "ledger" / part["name"]).glob("part-*.parquet"))) == 1
    assert len(ledger.vacuum(1)) == 6 and rows(ledger.read("a", ROWS)) == before


def counted(path, answer):
    """A provider that notes each thing that it is asked about."""

    def provider(*args):
        with open(path, "a") as f:
            f.write("x\n" * (len(args[0]) if isinstance(args[0], list) else 1))
        return answer(*args)

    return provider


def calls(path):
    n = len(open(path).readlines()) if os.path.exists(path) else 0
    if n:
        os.remove(path)
    return n


def test_providers_are_asked_once_for_each_content(spark, tmp_path):
    """30 files of 12 contents and 5 images: so many calls in all branches of the report, and none in a rerun."""
    folder, notes = tmp_path / "files", {k: str(tmp_path / k) for k in ("text", "tokens", "pages", "client")}
    folder.mkdir()
    for k in range(30):
        (folder / f"{k:02d}.txt").write_text("" if k % 12 == 11 else f"Acme Corporation {k % 12}\n500 Technology Dr\nTotal: ${k % 12}.00\n")
    (folder / "11.txt").write_text("blank")
    (folder / "23.txt").write_text("blank")
    answer = json.dumps({"findings": [{"code": "LOGO_QUALITY", "description": "blurred", "confidence": 0.5}]})
    text = counted(notes["text"], lambda content, path: "" if content == b"blank" else content.decode())
    tokens = counted(notes["tokens"], lambda content, path: "Globex LLC\n1 Main St\nTotal: $7.00")
    pages = counted(notes["pages"], lambda content, path: (8, 8, bytes([len(content) * 7 % 5 if content == b"blank" else content[17] % 4]) * 192))
    client = counted(notes["client"], lambda images: [answer for _ in images])
    run = lambda results: {r.path[-6:]: r for r in analyse_files(files.scan_files(spark, f"file://{folder}"), directory_of(spark), text=text, tokens=tokens, pages=pages, client=client, results=results).collect()}
    base = f"file://{tmp_path}/results"
    got = run(base)
    contents = len({(folder / p).read_text() for p in os.listdir(folder)})
    first = {k: calls(p) for k, p in notes.items()}
    assert first["text"] == first["pages"] == contents == 12 and first["tokens"] == 1 and 2 <= first["client"] <= 5
    assert len(got) == 30 and all(r.error is None for r in got.values())
    assert all([s.code for s in r.signals].count("LOGO_QUALITY") == 1 for r in got.values())
    dup = {k: [s.code for s in r.signals if s.source == "duplicate"] for k, r in got.items()}
    assert all(dup[f"{k:02d}.txt"] == ["DUP_EXACT_FILE_HASH"] for k in range(12, 24))
    assert got["11.txt"].invoice_id.endswith("-11")
    again = run(base)
    assert {k: calls(p) for k, p in notes.items()} == dict.fromkeys(notes, 0)
    assert {k: (r.invoice_id, r.risk_score) for k, r in got.items()} == {k: (r.invoice_id, r.risk_score) for k, r in again.items()}
    (folder / "99.txt").write_text("Wayne Enterprises\n1007 Mountain Dr\nTotal: $3.00\n")
    assert len(run(base)) == 31
    last = {k: calls(p) for k, p in notes.items()}
    assert (last["text"], last["tokens"], last["pages"]) == (1, 0, 1) and last["client"] <= 1


def test_failed_answers_are_asked_for_again(spark, tmp_path):
    marks = str(tmp_path / "asked")
    base, df = f"file://{tmp_path}/results", spark.createDataFrame([("a", "1"), ("a", "1"), ("b", "bad"), (None, "2"), ("c", "3")], "key string, what string")

    def ask(some):
        @F.udf("string")
        def note(what):
            with open(marks, "a") as f:
                f.write("x\n")
            return None if what == "bad" else f"said {what}"

        return some.withColumn("said", note.asNondeterministic()("what"))

    for expected in (3, 1):
        out = Results(spark, base, "said").ensure(df, "key", ask, F.col("said").isNull())
        assert sorted(map(tuple, out.collect())) == [("a", "said 1"), ("b", None), ("c", "said 3")] and calls(marks) == expected
    assert rows(Results(spark, base, "said").read("key string, said string, failed boolean")) == [("a", "said 1"), ("c", "said 3")]
