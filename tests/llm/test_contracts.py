"""Operators against brute force, on documents with all defined cases."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import lanes, media, mixing, quality, simhash, substrings, suffixes, tokenids

from .data import SCHEMA, documents, odd_documents

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(documents(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(odd_documents(), SCHEMA).repartition(3)


def texts():
    return {r[0]: (r[1] or "") for r in documents()}


def fingerprint(text, n=3):
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[k : k + n]), 42) for k in range(max(1, len(w) - n + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash(spark, docs, empty, odd):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.classes(simhash.fingerprints(docs)).collect()}
    want = {i: fingerprint(t) for i, t in texts().items()}
    assert {i: v & (2**64 - 1) for i, (v, _) in got.items()} == want
    parent = {i: i for i in want}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sorted(want):
        for b in sorted(want):
            if a < b and (want[a] ^ want[b]).bit_count() <= 2:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {i: c for i, (_, c) in got.items()} == {i: root(i) for i in want}
    assert simhash.classes(simhash.fingerprints(empty)).count() == 0
    assert simhash.classes(simhash.fingerprints(odd)).count() == len(odd_documents())


def test_simhash_dense_postings(spark):
    """Many fingerprints a few bits apart: the refined postings link what pairs would."""
    import numpy as np

    rng = np.random.default_rng(1)
    base = int(rng.integers(0, 2**62))
    values = {base}
    for _ in range(400):
        v = base
        for b in rng.integers(0, 20, 4).tolist():
            v ^= 1 << b
        values.add(v)
    values |= {int(x) for x in rng.integers(0, 2**62, 50)}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    for cap in (1000, 3):
        rows = simhash.components(simhash.links(df, 2, cap)).collect()
        label = {r.node: r.root for r in rows}
        left, want = set(values), {}
        while left:
            todo, group = [left.pop()], []
            while todo:
                x = todo.pop()
                group.append(x)
                near = {y for y in left if (x ^ y).bit_count() <= 2}
                left -= near
                todo += near
            want |= dict.fromkeys(group, min(group)) if len(group) > 1 else {}
        assert label == want


def kept(text, mark):
    return bytes(c for c, m in zip(text, mark, strict=True) if not m)


@pytest.mark.parametrize("size", [suffixes.SORTED, 2000])
def test_suffix_dedup(spark, docs, size, monkeypatch):
    monkeypatch.setattr(suffixes, "SORTED", size)  # the small size sends windows on by digest
    got = {r.doc_id: r for r in suffixes.deduplicate(docs).collect()}
    seen = set()
    for i, t in sorted(texts().items()):
        t = t.encode()
        mark = bytearray(len(t))
        for k in range(len(t) - 99):
            w = t[k : k + 100]
            if w in seen:
                mark[k : k + 100] = b"\1" * 100
            seen.add(w)
        left = kept(t, mark)
        r = got[i]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(t), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(left).hexdigest())
        assert bytes(r.text) == left


@pytest.mark.parametrize(("op", "text"), [(suffixes, "a" * 40_000), (substrings, "word " * 8_000)])
def test_pieces_of_one_text_go_in_bounded_batches(op, text):
    """However many ranges one text is asked for; each with its own place."""
    import pyarrow as pa

    from tallyforge.llm import anchors

    want = [{"doc": k, "lo": k, "len": 7_000, "at": k % 50} for k in range(900)]
    rows = pa.RecordBatch.from_arrays([pa.array(["", text]), pa.array([[], want])], names=["text", "asked"])
    out = list(anchors.pieces_of(op._cut, 13, None, "at", ("doc", "lo", "len"), "piece")(iter([rows])))
    assert max(b.nbytes for b in out) <= 2 * anchors.SENT < sum(b.nbytes for b in out)
    got = [r for b in out for r in b.to_pylist()]
    pieces = list(op._cut(text.encode(), [(k % 50, k % 50 + 7_012) for k in range(900)]))
    assert got == [{"doc": k, "lo": k, "len": 7_000, "piece": p} for k, p in enumerate(pieces)]
    asked = pa.array([[{"g": k, "lo": k, "len": 2, "off": 1} for k in range(5)]])
    rows = pa.RecordBatch.from_arrays([pa.array([9]), pa.array([text]), asked], names=["key", "text", "asked"])
    (one,) = anchors.pieces_of(op._cut, 13, "key", "lo", ("g", "doc", "lo", "len", "off"), "text")(iter([rows]))
    assert one.column("doc").to_pylist() == [9] * 5 and one.column("g").to_pylist() == list(range(5))


def test_windows_by_digest_are_taken_one_by_one():
    from tallyforge.llm import anchors

    live = []

    def texts(many):
        for k in range(many):
            live.append(1)
            yield b"%d" % (k % 7)
            live.pop()
            assert not live

    out = anchors.window_runs(((d, 10 * d, texts(d)) for d in (0, 3, 9)), 4)
    assert out["doc"].tolist() == [3] * 3 + [9] * 9 and out["lo"].tolist() == [*range(30, 33), *range(90, 99)]
    assert len(set(out["g"].tolist())) == 7 and (out["len"] == 1).all() and len(anchors.window_runs([], 4)) == 0



@pytest.mark.parametrize("batches", [1, 5])
def test_substrings(spark, docs, batches):
    got = {r.doc_id: r for r in substrings.deduplicate(docs, batches=batches).collect()}
    seen = {}
    for i, t in sorted(texts().items()):
        w = WORD.findall(t)
        mark = [0] * len(w)
        for k in range(len(w) - 12):
            if seen.setdefault(tuple(w[k : k + 13]), i) < i:
                mark[k : k + 13] = [1] * 13
        left = " ".join(x for x, m in zip(w, mark, strict=True) if not m)
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256, r.text) == (len(w), sum(mark), hashlib.sha256(left.encode()).hexdigest(), left)


def test_dedup_of_odd_rows(spark, odd, empty):
    for op in (suffixes, substrings):
        rows = op.deduplicate(odd, texts=False).collect()
        assert len(rows) == len(odd_documents())
        twice = [tuple(r) for r in rows if r.doc_id == odd_documents()[3][0]]
        assert len(twice) == 3 and len(set(twice)) == 2  # equal rows are one document
        assert op.deduplicate(empty).count() == 0


def test_two_stage_sort():
    import random

    rng = random.Random(2)
    for alphabet in (b"ab", b"abc\0", bytes(range(256))):
        text = bytes(rng.choice(alphabet) for _ in range(400)) + b"\0"
        got = suffixes.suffix_array(text, 500).tolist()
        assert got == sorted(range(len(text)), key=lambda i: text[i:])
    assert suffixes.suffix_array(b"", 5).tolist() == []


def test_index_compacts_and_keeps_runs_sorted(tmp_path):
    import numpy as np
    import pyarrow.fs as pafs

    from tallyforge.llm import anchors

    rng = np.random.default_rng(0)
    runs = np.zeros(500, anchors.RUN)
    runs["g"], runs["c"] = rng.integers(0, 50, 500), rng.integers(0, 2**63, 500)
    runs, repeat, first = anchors.settle(runs, False)
    assert (runs["c"][first] == runs["c"]).all() and (repeat == (runs["doc"] != runs["doc"][first])).all()
    fs = pafs.LocalFileSystem()
    substrings.write_run(fs, str(tmp_path / "r"), runs)
    assert (substrings.read_run(fs, str(tmp_path / "r"), 0) == runs).all()
    assert len(substrings.read_run(fs, str(tmp_path / "none"), 0)) == 0
    known = substrings.known_in(runs[::2], runs)
    assert (known[::2] == np.arange(250)).all() and (substrings.known_in(runs[::2], runs[1::2]) == -1).all() and len(substrings.known_in(runs[:0], runs)) == 500
    assert (substrings.merge(runs[::3], np.delete(runs, np.s_[::3])) == runs).all() and (substrings.merge(runs[:0], runs) == runs).all()
    here, there = substrings.anchored_in(runs[:40], runs[40:])
    assert here.sum() == np.isin(runs["g"][40:], runs["g"][:40]).sum() and there.sum() == np.isin(runs["g"][:40], runs["g"][40:]).sum()


def brute_words(docs, n=13):
    """(id, text) in order to the words left of each."""
    seen, out = {}, {}
    for i, t in docs:
        w = WORD.findall(t)
        mark = [0] * len(w)
        for k in range(len(w) - n + 1):
            if seen.setdefault(tuple(w[k : k + n]), i) < i:
                mark[k : k + n] = [1] * n
        out[i] = " ".join(x for x, m in zip(w, mark, strict=True) if not m)
    return out


def test_index_goes_on_in_other_sessions(spark, tmp_path):
    """Batches added by newly opened indexes, in sessions of their own, give what one pass over all gives."""
    base, want = f"file://{tmp_path}/index", brute_words(sorted(texts().items()))
    rows = sorted(texts().items())
    cuts = [0, 7, 20, 21, 33, 50, len(rows)]
    substrings.Index.create(spark, base, 4)
    got, runs = {}, []
    for a, z in zip(cuts[:-1], cuts[1:], strict=True):
        session = spark.newSession()
        index = substrings.Index.open(session, base)
        batch = session.createDataFrame(rows[a:z], "doc_id long, text string")
        got |= {r.doc_id: r.text for r in substrings.deduplicate_batch(index, batch).collect()}
        runs.append(len(index.state["runs"]))
    assert got == want and max(runs) == substrings.FANIN and runs[substrings.FANIN] == 1  # compacted
    index = substrings.Index.open(spark, base)
    assert substrings.deduplicate_batch(index, spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        index.add(spark.createDataFrame(rows[:2], "key long, text string"))
    with pytest.raises(ValueError):
        substrings.Index.open(spark, f"file://{tmp_path}")


def test_index_batch_that_fails_can_be_given_again(spark, tmp_path, monkeypatch):
    """A job lost after the runs are written leaves the manifest as it was."""
    base, rows = f"file://{tmp_path}/index", sorted(texts().items())
    want = brute_words(rows)
    index = substrings.Index.create(spark, base, 4)
    first, second = (spark.createDataFrame(r, "doc_id long, text string") for r in (rows[:30], rows[30:]))
    got = {r.doc_id: r.text for r in substrings.deduplicate_batch(index, first).collect()}
    before = dict(index.state)
    with monkeypatch.context() as m:
        m.setattr(substrings, "without", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            substrings.deduplicate_batch(index, second)
    assert index.state == before == substrings.Index.open(spark, base).state
    got |= {r.doc_id: r.text for r in substrings.deduplicate_batch(substrings.Index.open(spark, base), second).collect()}
    assert got == want
    with pytest.raises(ValueError, match="key in every row"):
        substrings.deduplicate_batch(substrings.Index.open(spark, base), spark.createDataFrame([(10**6, "a"), (None, "b")], "doc_id long, text string"))


def test_index_levels(spark, tmp_path):
    """Runs of a level are merged into one of the next, and only they: levels stay under FANIN + 1 runs each."""
    index = substrings.Index.create(spark, f"file://{tmp_path}/index", 1)
    shapes = []
    for k in range(3 * (substrings.FANIN + 1) + 2):
        substrings.deduplicate_batch(index, spark.createDataFrame([(k, LONG if k % 2 else f"{LONG} {k}")], "doc_id long, text string"))
        shapes.append(sorted(index.state["levels"].values(), reverse=True))
    assert shapes[:5] == [[0], [0, 0], [0, 0, 0], [1], [1, 0]] and shapes[7] == [1, 1] and shapes[11] == [1, 1, 1] and shapes[13] == [1, 1, 1, 0, 0]


def test_equal_hashes_of_different_words_remove_nothing(spark):
    """All runs get one fingerprint: what the words don't confirm stays, and real copies of the first text go."""
    from tallyforge.llm import anchors

    def blind(values, docs, ids, n, k, buckets):
        out = real(values, docs, ids, n, k, buckets)
        out["g"], out["c"], out["bucket"], out["len"], out["lo"] = 1, 1, 0, 1, 0
        return out

    real = anchors.runs_of
    rows = [(1, LONG), (2, " ".join(f"other{k}" for k in range(40))), (3, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    batch = [(i, t.encode()) for i, t in rows]
    values, cuts = anchors.word_tokens([t for _, t in batch])
    fake = blind(values, cuts, np.array([i for i, _ in batch]), 13, 6, 1)
    fake, repeat, first = anchors.settle(fake, False)
    known = anchors.merged(anchors.repeats_of(fake[repeat], fake[first[repeat]]))
    candidates = spark.createDataFrame([tuple(map(int, r)) for r in known.tolist()], "doc long, lo long, len long, src long, at long")
    keyed_rows, documents = anchors.keyed(df)
    got = {r.doc_id: r.n_removed for r in substrings.without(keyed_rows, documents, candidates, 13, False).collect()}
    assert {r[0] for r in known.tolist()} == {2, 3} and got == {1: 0, 2: 0, 3: 13}


def test_one_document_asked_by_very_many(spark, monkeypatch):
    from tallyforge.llm import anchors

    monkeypatch.setattr(anchors, "PART", 3)
    rows = [(k, LONG + f" end{k}") for k in range(40)]
    got = substrings.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id: r.text for r in got.collect()} == {k: f"{LONG} end0" if k == 0 else f"end{k}" for k in range(40)}


def test_quality_counts(spark, docs, empty, odd):
    field = quality.LineField.prior()
    got = {r.doc_id: r for r in quality.score(docs, field).collect()}
    for i, t in texts().items():
        w = WORD.findall(t)
        windows = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        mark = [0] * len(w)
        for k in range(len(w) - 4):
            if windows[tuple(w[k : k + 5])] > 1:
                mark[k : k + 5] = [1] * 5
        seen, again = set(), 0
        for line in t.split("\n"):
            if WORD.search(line):
                again += line in seen
                seen.add(line)
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), again, sum(mark))
        assert r.base_failed == (len(w) < 10 or 100 * sum(mark) > 20 * len(w)) and not (r.base_failed and r.kept)
    assert quality.score(empty, field).count() == 0 and quality.score(odd, field).count() == len(odd_documents())
    kept_rows = quality.filter_quality(docs, field)
    assert kept_rows.columns == docs.columns and {r.doc_id for r in kept_rows.collect()} == {i for i, r in got.items() if r.kept}


def test_quality_trains_on_one_row_an_id(spark, monkeypatch):
    """A labelled id on very many rows sends one of them to the driver, and which doesn't hang on their order."""
    seen = []
    monkeypatch.setattr(quality.LineField, "fit_latent", classmethod(lambda cls, found: seen.append(found)))
    rows = [(5, f"text of row {k} with some words in it") for k in range(3000)] + [(5, None), (6, "another"), (None, "no id")]
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, 1), (None, 1)], "doc_id long, quality int")
    for parts in (1, 6):
        quality.train(spark.createDataFrame(rows, "doc_id long, text string").repartition(parts), labels)
    assert [len(f) for f in seen] == [2, 2]
    assert all((a[0] == b[0]).all() and a[3] == b[3] for a, b in zip(*seen, strict=True))


def test_mixing(spark, docs, empty, odd):
    plan = mixing.source_plan(docs)
    rows = mixing.assign(docs, plan).select("source", F.col("__mix_total").alias("total"), F.col("__mix_target").alias("target"), (F.col("__mix_copies")).alias("copies"), "text", "doc_id").collect()
    size = {r[0]: len(WORD.findall(r[1] or "")) for r in documents()}
    total = collections.Counter()
    for r in documents():
        total[r[3]] += size[r[0]]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, capped = 1.5 * sum(total.values()), set()
    while True:
        rest = budget - sum(2 * total[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped) or 1
        target = {s: 2 * total[s] if s in capped else rest * weight[s] / share for s in order}
        over = {s for s in order if s not in capped and target[s] > 2 * total[s]}
        if not over:
            break
        capped |= over
    taken, longest = collections.Counter(), max(size.values())
    for r in rows:
        assert r.target == pytest.approx(target[r.source]) and r.total == total[r.source] and 0 <= r.copies <= 2
        taken[r.source] += size[r.doc_id] * r.copies
    assert len(rows) == len(documents()) and all(abs(taken[s] - target[s]) <= longest for s in order)
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in rows)
    assert {r["__mix_size"] for r in mixed.collect()} == {"clash"}
    assert mixing.mix(empty).count() == 0 and mixing.mix(odd).count() > 0


def test_mixing_again_and_without_words(spark, docs):
    """Reruns over other partitions agree; nothing is taken more than twice, documents without words included."""
    def of(df):
        return sorted(((r.doc_id, r["__mix_copies"]) for r in mixing.assign(df, mixing.source_plan(df)).collect()), key=repr)

    rows = [(k, "one two three" if k % 3 else None, "few" if k < 9 else "many") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first = of(df)
    assert first == of(df.repartition(7)) and max(c for _, c in first) == 2
    assert {c for i, c in first if i < 9} == {2}  # a source at its cap: every row twice, without words or not
    assert of(docs) == of(docs.repartition(5, "text"))


@pytest.mark.parametrize("nulls", [0.0, 0.4, 1.0])
@pytest.mark.parametrize("kind", ["null", "one id", "equal rows"])
def test_mixing_meets_its_target_whatever_the_ids(spark, nulls, kind):
    """A source of 20,000 words whose target is 30,000, of which a share has no id, or one id, or is one row repeated."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(1000):
        odd = rng.random() < nulls
        text = "w " * 20 if odd and kind == "equal rows" else f"v{k} " + "w " * 19
        rows.append((None if odd and kind == "null" else 7 if odd else k * 3, text, "s", f"row {k}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra string").repartition(4)
    got = mixing.assign(df, mixing.source_plan(df)).collect()
    taken = sum(r["__mix_size"] * r["__mix_copies"] for r in got)
    assert len(got) == 1000 and {r["__mix_target"] for r in got} == {30000.0} and abs(taken - 30000) <= 20
    assert {r["__mix_copies"] for r in got} == {1, 2}
    mixed = mixing.mix(df)
    assert mixed.columns == df.columns and abs(mixed.count() - 1500) <= 1
    assert len({r.extra for r in mixed.collect()}) == 1000


def test_mixing_thresholds_at_any_level(spark, monkeypatch):
    """Few wide ranges or many narrow ones: the documents taken are the same."""
    rows = [(k, "w " * (1 + k % 5), f"s{k % 3}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = []
    for bits in (1, 3, 10):
        monkeypatch.setattr(mixing, "BITS", bits)
        got.append(sorted((r.doc_id, r["__mix_copies"]) for r in mixing.assign(df, mixing.source_plan(df)).collect()))
    assert got[0] == got[1] == got[2]


def test_ids_over_the_whole_range(spark):
    """Ids that span 64 bits, one repeated, one null."""
    low, high = -(2**63), 2**63 - 1
    rows = [(high, LONG), (low, LONG + " a"), (high, "other text"), (None, LONG), (0, None), (high, LONG)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for op in (suffixes, substrings):
        got = collections.Counter((r.doc_id, r.n_removed > 0) for r in op.deduplicate(df, texts=False).collect())
        assert got == {(high, True): 2, (low, True): 1, (high, False): 1, (None, False): 1, (0, False): 1}


LONG = " ".join(f"word{k}" for k in range(40))


def test_water_fill_moves_the_excess(spark):
    df = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.water_fill(df, (5, 2, 1), 1.5, 2.0).collect()}
    assert got == {"a": 20.0, "b": 200.0, "c": pytest.approx(1665 - 220)}


def test_token_ids(spark, docs, empty, odd, tmp_path):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    base = f"file://{tmp_path}/ids"
    got = {r.doc_id: r for r in tokenids.read_token_ids(tokenids.write_token_ids(docs, base, path, parts=3), base).collect()}
    added = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>\n y <|endoftext| > <|endoftext|>z"]
    more = f"file://{tmp_path}/added"
    with_added = spark.createDataFrame([(k, t) for k, t in enumerate(added)], "doc_id long, text string")
    for r in tokenids.read_token_ids(tokenids.write_token_ids(with_added, more, path), more).collect():
        ids = [*plain.encode(added[r.doc_id], add_special_tokens=False).ids, 2]
        assert 50256 in ids and (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    start = 0
    for i, t in sorted(texts().items()):
        ids = np.array([*plain.encode(t, add_special_tokens=False).ids, 2], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    for k, (df, n) in enumerate(((empty, 0), (odd, len(odd_documents())))):
        base = f"file://{tmp_path}/more{k}"
        assert tokenids.read_token_ids(tokenids.write_token_ids(df, base, path), base).count() == n


def test_media(spark, docs, empty, odd):
    got = {r.doc_id: r for r in media.from_media(media.to_media(docs)).collect()}
    for i, t in texts().items():
        t = t.encode()
        payload = t + b" " * (-len(t) % 192 or (0 if t else 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
    assert media.from_media(media.to_media(empty)).count() == 0
    assert media.from_media(media.to_media(odd)).count() == len(odd_documents())
    assert [r.doc_id for r in media.from_media(media.to_media(odd)).where("doc_id is null").collect()] == [None, None]
    long = b"q" * (192 * 16385)
    (file,) = lanes.encode([long])
    assert lanes.decode([file])[0].tobytes() == long
    shown = {r.doc_id: r for r in media.to_pixels(media.to_media(docs)).collect()}
    for i, t in texts().items():
        r = shown[i]
        assert (r.height * 192, r.width) == (got[i].payload_bytes, 64) and bytes(r.pixels) == t.encode().ljust(r.height * 192)
    features = {i: tuple(map(int, r.feature.split(","))) for i, r in got.items()}
    for i in (0, 12, 15):  # mean and spread of each channel and the mean step, from the padded bytes
        p = np.frombuffer(texts()[i].encode().ljust(got[i].payload_bytes), np.uint8).astype(float)
        want = [*(p[k::3].mean() for k in range(3)), *(p[k::3].std() for k in range(3)), np.abs(np.diff(p)).mean()]
        assert np.abs(np.array(features[i]) - 1000 * np.array(want)).max() <= 1
    files = {r.doc_id: bytes(r.media) for r in media.to_media(docs).collect()}
    assert all((got[i].media_bytes, got[i].media_sha256) == (len(f), hashlib.sha256(f).hexdigest()) for i, f in files.items())
    nothing = spark.createDataFrame([(1, None)], "doc_id long, media binary")
    assert tuple(media.to_pixels(nothing).first()) == (1, None, None, None)


def test_files_are_published_again_and_purged(spark, tmp_path):
    import pyarrow.fs as pafs

    from tallyforge.llm import common

    fs = pafs.LocalFileSystem()
    for text in ("first", "second"):
        (tmp_path / "temp").write_text(text)
        common.publish(fs, str(tmp_path / "temp"), str(tmp_path / "name"))
        assert (tmp_path / "name").read_text() == text
    df = common.stored(spark.range(3), "purge-test")
    path = common._made[-1].removeprefix("file://")
    assert df.count() == 3 and fs.get_file_info(path).type == pafs.FileType.Directory
    common.purge(spark)
    assert fs.get_file_info(path).type == pafs.FileType.NotFound and not common._made
