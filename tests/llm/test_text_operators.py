"""WARC archives, PII, SentencePiece and the pipeline."""

import collections
import hashlib
import io
import itertools
import math
import random

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from tallyforge.llm import pieces, pii, quality, warc

from .data import SCHEMA, documents, odd_documents

PAGES = "page_id long, url string, html string, extra string"


def pages():
    long = "<html>" + "é" * 700 + "</html>"
    return [(1, "u1", long, "x"), (2, "u2\r\nX: y", long, "x"), (5, "u5", long, "x"), (3, "u3", "short", "x"), (4, None, "short", "x"), (6, "u6", None, "x"), (7, "u7", "", None), (8, "u8", "z" * 1000, None)]


def test_warc_archives(spark, tmp_path):
    base = f"file://{tmp_path}/w"
    got = {r.page_id: r for r in warc.read_warc(warc.write_warc(spark.createDataFrame(pages(), PAGES).repartition(2), base), base).collect()}
    for page, _, html, _ in pages():
        body = (html or "").encode()
        r = got[page]
        revisit = page in (1, 2)
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", 5 if revisit else None)
    odd = [*pages(), (None, "n", "q" * 2000, None), (9, "u", "q" * 2000, None), (9, "u", "q" * 2000, None)]
    base = f"file://{tmp_path}/odd"
    assert warc.read_warc(warc.write_warc(spark.createDataFrame(odd, PAGES), base), base).count() == len(odd)
    base = f"file://{tmp_path}/none"
    assert warc.read_warc(warc.write_warc(spark.createDataFrame([], PAGES), base), base).count() == 0


def test_warc_dictionary_frame():
    out = io.BytesIO()
    archive = warc.ArchiveWriter(out)
    rng = np.random.default_rng(0)
    payloads = [b"<div class='common words in every page'>" * 30 + bytes(rng.integers(97, 123, 900, np.uint8)) for _ in range(300)]
    for k, p in enumerate(payloads):
        archive.add(warc.record(k, f"http://x/{k}", p, None, False))
    archive.close()
    data = out.getvalue()
    assert int.from_bytes(data[:4], "little") == warc.SKIPPABLE
    found = list(warc.read_archive(io.BytesIO(data)))
    assert [b.partition(b"\r\n\r\n")[2] for _, b in found] == payloads and found[3][0]["WARC-Target-URI"] == "http://x/3"
    whole = sum(len(zstandard.ZstdCompressor(level=warc.LEVEL).compress(warc.record(k, f"http://x/{k}", p, None, False))) for k, p in enumerate(payloads))
    assert len(data) < whole + (warc.DICT_KB << 10)
    with pytest.raises(ValueError):
        list(warc.read_archive(io.BytesIO(data[:-3])))


TEXT = (
    "Mail a.b@mail5.example.com or A.B@mail5.example.com, +1 (743) 555-3824; ip 152.143.123.131### card 4785380592391139$$$ not 9807915762804490. "
    'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"! Dr. Smith met Maria Keller and Mr Иванов; DE89 3704 0044 0532 0130 00 123-45-6789 v2.0.1 00:1B:44:11:3A:B7.'
)


def test_pii_types_and_formats():
    out, used = pii.redact(TEXT)
    by = collections.defaultdict(list)
    for kind, old, new in used:
        by[kind].append((old, new))
        assert old != new and (len(old) == len(new) or kind in ("ip", "first"))
        assert old not in out
    assert set(by) == {"email", "phone", "ip", "card", "secret", "last", "first", "iban", "ssn", "mac"}
    assert pii.is_card(by["card"][0][1]) and pii.is_iban(by["iban"][0][1]) and "9807915762804490" in out and "v2.0.1" in out
    assert by["first"][0][1] in pii.NAMES["female latin"] and by["last"][-1][1].endswith("ов")
    assert all(0 <= int(x) <= 255 for x in by["ip"][0][1].split("."))
    assert set(by["secret"][0][1]) <= set("0123456789abcdef") and by["phone"][0][1].startswith("+1 (")
    assert pii.redact(TEXT)[0] == out and pii.redact(TEXT, b"other")[0] != out


def test_pii_is_one_to_one_without_fixed_points():
    for kind, domain in (("last", [a + b for a in "bcdf" for b in "aeiou"]), ("ssn", [f"{k:03d}-00-0000" for k in range(300)]), ("first", pii.NAMES["male cyrillic"])):
        new = [pii.surrogate(kind, x) for x in domain]
        assert len(set(new)) == len(domain) and all(a != b for a, b in zip(domain, new, strict=True))
    for size in (2, 3, 10, 97):
        assert sorted(pii._cycle(k, size, pii.KEY, "t") for k in range(size)) == list(range(size))


def test_pii_over_a_table(spark):
    rows = [(1, TEXT, "en", "s", 1, None, None), (2, "ask a.b@mail5.example.com", "en", "s", 1, None, None), (3, "clean text of no one, 3 of 4", "en", "s", 1, None, None), (None, None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    key = pii.checked_key(df)
    got = {r.doc_id: r.text for r in pii.replace_pii(df, key).collect()}
    new = next(n for k, o, n in pii.redact(TEXT, key)[1] if o == "a.b@mail5.example.com")
    assert got[2] == f"ask {new}" and got[3] == rows[2][1] and got[None] is None  # the same entity in another document
    found = pii.entity_table(df, key)
    assert pii.collisions(found).count() == 0
    assert pii.collisions(found.unionByName(spark.createDataFrame([("email", "q@x.org", new)], found.schema))).count() == 1
    r = pii.report(df, key).where("doc_id = 1").first()
    assert (r.n_email, r.n_person, r.n_card) == (2, 3, 1) and r.n_entities == r.n_email + r.n_phone + r.n_ip + r.n_mac + r.n_card + r.n_ssn + r.n_iban + r.n_secret + r.n_person
    assert pii.report(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.fixture(scope="module")
def voc():
    import public_tokenizers

    return pieces.vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def all_segmentations(voc, word):
    """Every way to write a word, with its probability."""
    pieces_of = {}
    for h, i in zip(voc.hashes.tolist(), voc.ids.tolist(), strict=True):
        pieces_of[h] = i
    text, out = " " + word, {}

    def go(at, ids, weight):
        if at == len(text):
            out[tuple(ids)] = weight
            return
        for n in range(1, voc.longest + 1):
            if at + n <= len(text):
                v = pieces._values(text[at : at + n])
                i = pieces_of.get(int(pieces.rolling.Hashes(v)(np.array([0]), np.array([n]))[0]))
                if i is not None:
                    go(at + n, [*ids, i], weight + voc.log_prob[i])

    go(0, [], 0.0)
    total = sum(math.exp(v) for v in out.values())
    return {k: math.exp(v) / total for k, v in out.items()}


def test_samples_without_replacement_follow_the_lattice(voc):
    exact, n = all_segmentations(voc, "and"), 20_000
    found = pieces.sample(pieces.Corpus(voc, ["and"] * n), pieces.rolling.mix(np.arange(n, dtype=np.uint64)), 3)
    for f in found:
        keys = [tuple(s[1].tolist()) for s in f]
        assert len(set(keys)) == len(keys) and all(a[3] > b[3] for a, b in zip(f, f[1:], strict=False))
    for s in found[0]:
        assert math.exp(s[2]) == pytest.approx(exact[tuple(s[1].tolist())])
    first = collections.Counter(tuple(f[0][1].tolist()) for f in found)
    second = collections.Counter(tuple(f[1][1].tolist()) for f in found)
    want = collections.Counter()
    for a, p in exact.items():
        for b, q in exact.items():
            if a != b:
                want[b] += p * q / (1 - p)
    for k, p in exact.items():
        assert abs(first[k] / n - p) < 0.015 and abs(second[k] / n - want[k]) < 0.02
    # inclusion scores weigh the samples so that they stand for the whole lattice
    assert np.mean([sum(math.exp(s[2]) / s[4] for s in f) for f in found]) == pytest.approx(1, abs=0.02)


def test_few_segmentations_are_all_given(voc):
    exact = all_segmentations(voc, "a")
    (f,) = pieces.sample(pieces.Corpus(voc, ["a"]), np.array([9], np.uint64), 50)
    assert {tuple(s[1].tolist()) for s in f} == set(exact) and all(s[4] == 1.0 for s in f)


def test_round_trips_and_best(voc):
    texts = [r[1] or "" for r in documents()]
    found = pieces.sample(pieces.Corpus(voc, texts), pieces.rolling.mix(np.arange(len(texts), dtype=np.uint64)), 2)
    for t, f, best in zip(texts, found, pieces.encode_best(voc, texts), strict=True):
        assert voc.decode(best) == t and all(voc.decode(s[1]) == t for s in f)
        assert len(f) == (2 if t.strip() else 1)
    word = "because"
    exact = all_segmentations(voc, word)
    assert tuple(pieces.encode_best(voc, [word])[0].tolist()) == max(exact, key=exact.get)


def test_the_library_decodes_the_same(voc):
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    texts = [r[1] or "" for r in documents()] + ["x².5 m²", "a  b   c", "naïve 日本語 😀 ﬁ"]
    found = pieces.sample(pieces.Corpus(voc, texts), pieces.rolling.mix(np.arange(len(texts), dtype=np.uint64)), 2)
    for f, best in zip(found, pieces.encode_best(voc, texts), strict=True):
        for ids in (best, *(s[1] for s in f)):
            assert library.decode(ids.tolist()) == voc.decode(ids)


def test_samples_hang_on_the_row_alone(spark, voc):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    df = spark.createDataFrame(odd_documents(), SCHEMA)
    a = sorted(map(tuple, pieces.sample_digests(df.repartition(1), path).collect()), key=repr)
    b = sorted(map(tuple, pieces.sample_digests(df.repartition(7), path).collect()), key=repr)
    assert a == b and all(r[-1] for r in a)
    assert pieces.sample_pieces(df.limit(0), path).count() == 0


def test_field_learns_and_decodes():
    rng = np.random.default_rng(3)
    make = lambda junk, n: np.stack([np.ones(n), rng.normal(2.0 * junk, 0.5, n), *rng.normal(0, 1, (10, n))], 1)
    data = [(make(k % 2, int(rng.integers(1, 9))), 1 - k % 2) for k in range(300)]
    field = quality.LineField.fit(data[:200])
    right = [(field.decode(x, np.array([len(x)])).mean() > 0.5) == bool(y) for x, y in data[200:]]
    assert np.mean(right) > 0.95
    # Viterbi against all label sequences
    x = make(1, 6)
    emit = x @ field.weights.T
    best = max(range(64), key=lambda s: sum(emit[k, s >> k & 1] for k in range(6)) + sum(field.moves[s >> k & 1, s >> k + 1 & 1] for k in range(5)))
    assert field.decode(x, np.array([6])).tolist() == [best >> k & 1 for k in range(6)]
    assert (quality.LineField.fit([]).weights == quality.LineField.prior().weights).all()


def mixed_pages(n, rng):
    """Pages of prose and boilerplate in stretches; label: whether prose has most words. Gives (text, line labels, label)."""
    words = ["river", "stone", "walked", "the", "of", "and", "slowly", "evening", "over", "a", "house", "remembered", "light", "under", "they"]
    shared = ["Home | About | Contact | Login", "© ALL RIGHTS RESERVED ***", "SHARE >> TWEET >> PIN", "Menu | Search | Help | Cart"]
    for k in range(n):
        lines, labels, label = [], [], k % 2
        while len(lines) < 14:
            content = rng.random() < (0.7 if label else 0.15)
            for _ in range(int(rng.integers(2, 5))):
                if content:
                    text = " ".join(rng.choice(words, int(rng.integers(8, 16)))).capitalize() + "."
                else:
                    own = " | ".join(w.upper() for w in rng.choice(words, int(rng.integers(3, 9)))) + f" {'*' * int(rng.integers(1, 4))} {rng.integers(10**6)}"
                    text = str(rng.choice(shared)) if rng.random() < 0.4 else own
                lines.append(text)
                labels.append(int(content))
        many = [len(x.split()) for x in lines]
        yield "\n".join(lines), labels, int(2 * np.dot(many, labels) >= sum(many))


def test_lines_of_mixed_documents(spark):
    """Only documents are labelled; most have lines of both kinds, which the field tells apart on held-out pages."""
    rng = np.random.default_rng(11)
    pages = list(mixed_pages(300, rng))
    docs = spark.createDataFrame([(k, t) for k, (t, _, _) in enumerate(pages[:200])], "doc_id long, text string")
    labels = spark.createDataFrame([(k, y) for k, (_, _, y) in enumerate(pages[:200])], "doc_id long, quality int")
    field = quality.train(docs, labels)
    held = pages[200:]
    lines = quality.Lines([t.encode() for t, _, _ in held])
    got, want = field.decode(lines.vectors, lines.counts), np.concatenate([x for _, x, _ in held])
    cuts = np.concatenate([[0], np.cumsum(lines.counts)])
    mixed = [0 < np.mean(got[a:z]) < 1 for a, z in zip(cuts[:-1], cuts[1:], strict=True)]
    assert np.mean(got == want) > 0.95 and np.mean(mixed) > 0.6
    kept = quality.judge([t.encode() for t, _, _ in held], field)["content_share"] >= quality.CONTENT_SHARE
    assert np.mean(kept == [y for _, _, y in held]) > 0.9
    assert field.moves[0, 0] + field.moves[1, 1] > field.moves[0, 1] + field.moves[1, 0]  # stretches are learned


def test_line_labels_under_the_document():
    lean, words, none = np.array([3.0, -1.0, 2.0, -5.0]), np.array([1, 10, 1, 4]), np.zeros(4, bool)
    assert quality.constrained(lean, words, none, 1).tolist() == [1, 1, 1, 0]
    assert quality.constrained(lean, words, none, 0).tolist() == [1, 0, 1, 0]
    assert quality.constrained(lean, words, np.array([True, False, False, False]), 1).tolist() == [0, 1, 1, 0]
    assert quality.constrained(lean, words, np.ones(4, bool), 1).tolist() == [1, 1, 1, 0]
    a, b = np.array([1, 2, 3], np.uint64), np.array([1, 5], np.uint64)
    assert [m.tolist() for m in quality.common_lines([a, a, a, b])] == [[False] * 3] * 3 + [[False] * 2]
    assert [m.tolist() for m in quality.common_lines([a, b, b[:1]])] == [[True, False, False], [True, False], [True]]


def test_held_out_quality(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    field = quality.train(docs, labels.where("doc_id % 2 = 0"))
    rows = quality.score(docs, field).join(labels.where("doc_id % 2 = 1"), "doc_id").where("not base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in rows]) > 0.9


def test_pipeline(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, now = docs.columns, docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
        if name != "pieces":
            assert now.columns == columns
    assert now.columns == ["doc_id", "sample", "ids", "log_prob", "perturbed", "inclusion"] and now.count() > 0


def test_pipeline_stages_on_odd_rows(spark, sf_dir):
    """Null and repeated ids, null texts and clashing columns through all stages, each against what it must do to its input."""
    import corpus_pipeline

    odd = spark.createDataFrame(odd_documents(), SCHEMA).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").unionByName(odd, allowMissingColumns=True).unionByName(odd.where("doc_id is null"), allowMissingColumns=True)
    docs = spark.createDataFrame(docs.collect(), docs.schema).repartition(3)
    of = lambda df: collections.Counter((r.doc_id, r.text, r.source, r["__mix_size"], r.key) for r in df.collect())
    before = of(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns, name
        out = spark.createDataFrame(out.collect(), docs.schema).repartition(3)
        after = of(out)
        if name == "quality_rules":  # a filter: rows of the input, none with fewer than ten words
            assert after <= before and all(len((x[1] or "").split()) >= 10 for x in after) and sum(after.values()) > 100
            rejected = [x for x in before - after if len(set((x[1] or "").split())) > 60]
            assert len(rejected) < 0.8 * sum(before.values())
        elif name == "near_duplicates":  # one row of each text at most, and every text has a near copy that stays
            assert after <= before and max(collections.Counter(x[1] for x in after.elements()).values()) == 1
            kept = [_shingles(x[1]) for x in after]
            assert all(any(_near(_shingles(x[1]), k) for k in kept) for x in before if x not in after)
        elif name == "pii":  # rows stay; texts change in place, and only by their entities
            assert sorted(map(repr, ((x[0], x[2:]) for x in after.elements()))) == sorted(map(repr, ((x[0], x[2:]) for x in before.elements())))
            plain = {x[1] for x in before if not pii.entities(x[1] or "")}
            assert plain <= {x[1] for x in after}
        else:  # whole copies of rows, two at most
            assert set(after) <= set(before) and all(n <= 2 * before[x] for x, n in after.items())
        docs, before = out, after
    name, last = corpus_pipeline.STAGES[-1]
    got = last(spark, docs, sf_dir)
    assert {r.doc_id for r in got.select("doc_id").collect()} == {x[0] for x in before}


def _shingles(text):
    w = (text or "").split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def _near(a, b):
    return len(a & b) >= 0.5 * len(a | b)  # a class may link its ends by others at 0.8


def test_pipeline_of_nothing(spark, sf_dir):
    import corpus_pipeline

    now = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir)
    assert now.count() == 0


def test_pii_collisions_that_no_key_mends(spark):
    texts = ["bob@Example.com and bob@example.com", "bob@example.COM", "Password: ____________", "secret = ============"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    assert pii.checked_key(df) == pii.KEY
    got = [r.text for r in pii.replace_pii(df, pii.KEY).orderBy("doc_id").collect()]
    a, b = got[0].split(" and ")
    assert a != b and a.lower() == b == b.lower() and "example" not in b and got[1].lower() == b and got[1].endswith(".COM")
    assert got[2:] == texts[2:]
    same = spark.createDataFrame([("secret", "abc123abc123", "abc123abc123"), ("secret", "____________", "____________")], "kind string, entity string, surrogate string")
    assert [r.surrogate for r in pii.collisions(same).collect()] == ["abc123abc123"]


def test_pii_long_secrets_and_plain_phones():
    import random

    rng = random.Random(4)
    for n in (500, 800, 5000):
        value = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(n))
        for text in (f"token={value}", f"token: '{value}' end"):
            out, used = pii.redact(text)
            assert [(k, o) for k, o, _ in used] == [("secret", value)] and len(out) == len(text)
            assert not any(value[k : k + 12] in out for k in range(n - 11))
            assert sum(a == b for a, b in zip(value, used[0][2], strict=True)) < 0.2 * n
    last = value[:-1] + ("1" if value[-1] != "1" else "2")
    assert pii.surrogate("secret", last) != pii.surrogate("secret", value)
    for phone in ("+14155552671", "+4930123456", "+12345678"):
        out, used = pii.redact(f"call {phone}, now")
        assert [(k, o) for k, o, _ in used] == [("phone", phone)] and phone not in out and len(out) == len(phone) + 10
    assert pii.redact("a+14155552671 +1234567 +1234567890123456")[1] == []


def test_pipeline_samples_as_the_operator_does(spark, sf_dir):
    import corpus_pipeline

    df = spark.createDataFrame([(1, "several words because of their many segmentations"), (2, "")], "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in dict(corpus_pipeline.STAGES)["pieces"](spark, df, sf_dir).collect():
        got[r.doc_id].add(tuple(r.ids))
    assert len(got[1]) == pieces.SAMPLES > 1 and len(got[2]) == 1


def test_warc_repeated_ids(spark, tmp_path):
    x, y = "x" * 1500, "y" * 1500
    rows = [(5, "a", x, None), (9, "b", x, None), (5, "c", y, None), (5, "d", "short", None), (9, "e", x, None), (None, "f", x, None), (7, "g", y + "z", None)]
    base = f"file://{tmp_path}/repeated"
    got = warc.read_warc(warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), base), base).collect()
    sha = {hashlib.sha1(t.encode()).hexdigest(): t for _, _, t, _ in rows}
    found = sorted(((r.page_id, sha[r.payload_digest], r.record_type, r.refers_to) for r in got), key=repr)
    want = [(5, x, "revisit", 9), (9, x, "response", None), (9, x, "revisit", 9), (5, y, "response", None), (5, "short", "response", None), (None, x, "revisit", 9), (7, y + "z", "response", None)]
    assert found == sorted(want, key=repr)


def test_warc_null_holders_and_record_ids(spark, tmp_path):
    """All but one of equal payloads revisit it, ids or none; no two records share their id."""
    x, y = "x" * 1500, "y" * 1500
    rows = [(None, "a", x, None), (None, "b", x, None), (None, "b", x, None), (4, "c", y, None), (None, "d", y, None), (4, "c", y, None), (4, "e", "short", None), (4, "e", "short", None), (None, None, None, None), (None, None, None, None)]
    base = f"file://{tmp_path}/nulls"
    files = warc.write_warc(spark.createDataFrame(rows, PAGES).repartition(3), base)
    got = collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.read_warc(files, base).collect())
    want = {(None, 1500, "response", None): 1, (None, 1500, "revisit", None): 2, (4, 1500, "response", None): 1, (4, 1500, "revisit", 4): 1, (None, 1500, "revisit", 4): 1, (4, 5, "response", None): 2, (None, 0, "response", None): 2}
    assert got == want
    heads = []
    for r in files.collect():
        with open(r.path, "rb") as f:
            heads += [head for head, _ in warc.read_archive(f)]
    ids = [h["WARC-Record-ID"] for h in heads]
    assert len(set(ids)) == len(rows)
    responses = {h["WARC-Record-ID"] for h in heads if h["WARC-Type"] == "response"}
    assert all(h["WARC-Refers-To"] in responses for h in heads if h["WARC-Type"] == "revisit")


def test_pii_later_mentions_and_scripts():
    text = "Keller wrote. Maria Keller, born in Kiel, met Dr. Yuki Tanaka; Tanaka-San and Keller's friend Maria left. Kellerman and Marian stayed. My name is Ngozi Okafor. Okafor said so."
    out, used = pii.redact(text)
    new = {o: n for _, o, n in used}
    assert set(new) == {"Keller", "Maria", "Yuki", "Tanaka", "Ngozi", "Okafor"} and len(set(new.values())) == 6
    assert out.count(new["Keller"]) >= 3 and out.count(new["Maria"]) == 2 and out.count(new["Okafor"]) == 2
    assert "Kellerman and Marian stayed" in out and "Kiel" in out and "Tanaka-San" in out
    for name in ("Müllerová", "Ångström", "Łukasz", "Ñuñez", "Семьёнов", "Папαδόπουλος", "Αθανασίου", "Արամյան", "田中", "김민준", "כהן", "الخطيب", "Süßmann", "Strauß"):
        out, used = pii.redact(f"Dr {name} came; {name} went.")
        assert [(k, o) for k, o, _ in used] == [("last", name)] * 2, name
        after = used[0][2]
        assert after != name and len(after) == len(name) and sum(a == b for a, b in zip(name, after, strict=True)) < len(name), name
        assert all((a.isupper(), a.islower()) == (b.isupper(), b.islower()) for a, b in zip(name, after, strict=True)), name
    assert pii.redact("The Regards, dear friends. It is called the. Name: x. named after")[1] == []


def test_pii_name_recall():
    """Planted names: of known first names, with titles, after phrases, and their later mentions."""
    import random

    rng = random.Random(12)
    surnames = ["".join(rng.choice("bdfgklmnrstvz") + rng.choice("aeiou") for _ in range(rng.choice([2, 3, 4]))).capitalize() for _ in range(150)]
    given = ["".join(rng.choice("bdfgklmnrstvz") + rng.choice("aeiou") for _ in range(2)).capitalize() for _ in range(80)]
    hit = total = 0
    for k in range(400):
        first, last = rng.choice([*pii._FIRST]), rng.choice(surnames)
        lead = [f"{first} {last}", f"Mrs {last}", f"Prof. {rng.choice(given)} {last}", f"my name is {rng.choice(given)} {last}"][k % 4]
        text = f"It was late, {lead} said, and then {last} went home. Nobody saw {last}."
        out, _ = pii.redact(text)
        total += 3
        hit += 3 - sum(w.strip(".,") == last for w in out.split())
    assert hit / total > 0.97


def test_pii_distinct_by_brute_force():
    """Thousands of entities of each kind: no two share a surrogate, none keeps itself, each is of its kind and format."""
    import random
    import re

    rng = random.Random(13)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    w = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    def card():
        body = "4" + d(14)
        return body + str(-pii._luhn(body + "0") % 10)

    def iban():
        body = d(18)
        return f"DE{98 - pii._iban_rest('DE', body):02d}{body}"

    makers = {
        "email": lambda: f"{w(rng.choice([2, 5]))}.{w(3)}@{rng.choice(['a', 'b', w(2)])}x.org", "phone": lambda: f"+1 ({d(3)}) 555-{d(4)}", "ip": lambda: ".".join(str(rng.randrange(256)) for _ in range(4)),
        "mac": lambda: ":".join(f"{rng.randrange(256):02x}" for _ in range(6)), "card": card, "iban": iban, "ssn": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "secret": lambda: rng.choice([w(12), "".join(rng.choice("0123456789abcdef") for _ in range(16)), w(8) + "-" + d(6)]), "last": lambda: w(rng.choice([2, 3, 5])).capitalize(),
    }
    for kind, make in makers.items():
        own = {make() for _ in range(1500)}
        new = {x: pii.surrogate(kind, x) for x in own}
        assert len(set(new.values())) == len(own) and all(a != b for a, b in new.items()), kind
        shape = lambda x: re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", x)))
        if kind not in ("ip", "secret", "mac"):
            assert all(shape(a) == shape(b) for a, b in new.items()), kind
        if kind not in ("last", "secret"):
            assert all([(k, s) for _, _, k, s in pii.entities(f"x {b} y")] == [(kind, b)] for b in new.values()), kind


def test_pii_alphabets_hold_every_code_point_they_are_given_for():
    every = (*pii.LETTERS, *pii.CAPITALS)
    assert len({c for a in every for c in a}) == sum(map(len, every))  # no letter twice
    for k in range(0x110000):
        c = chr(k)
        a = pii._classes(c)[0]
        assert a is None or c in a and len(set(a)) == len(a)
    for c in "\u1e9e\u03f4\u2126\u212a\u212b\u0130\u0131\u017f\u03c2":
        text = f"password: STRA{c}ENBAHN12x"
        assert c in pii.redact(text)[0] or pii._classes(c)[0]
        assert pii.redact(text)[0] != text and len(pii.redact(text)[0]) == len(text)


@pytest.mark.parametrize("letters", [*pii.CAPITALS[4:], "ΣΩΑΒ", "σςωα"])
def test_pii_capitals_map_one_to_one(letters):
    words = ["".join(w) for w in itertools.product(letters, repeat=2)]
    new = [pii.surrogate("last", w) for w in words]
    assert len(set(new)) == len(words) and (len(words) < 4 or not any(a == b for a, b in zip(words, new, strict=True)))


def test_pii_greek_names_and_odd_letters_over_a_table(spark):
    rng = random.Random(4)
    stems = ["Παπαδόπουλος", "Γεωργίου", "Νικολάου", "Σαββίδης", "Ιωάννου"]
    names = sorted({s[:k] + rng.choice("αεο") + s[k:] for s in stems for k in range(2, len(s))} | {s.upper() for s in stems})
    texts = [f"my name is Maria {n}" for n in names] + [f"password: STRA{c}ENBAHN12x" for c in "\u1e9e\u03f4\u2126\u212a\u212b"] + ["a" * 5 + "\u1e9e@x.org mail \u212a@example.org"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    key = pii.checked_key(docs)
    assert pii.report(docs, key).count() == len(texts) and pii.collisions(pii.entity_table(docs, key)).isEmpty()


def test_pii_leads_are_not_missed():
    """The quick look for names and phrases agrees with the pattern."""
    rng = random.Random(8)
    bits = [*pii._LEADS[:40], *pii._LEADS[-30:], "Mr", "Dr.", "name:", "NAME IS", "\u017figned", "S\u0131ncerely,", "dear", " ", "  ", "\n", "(", "'", "-", ",", "x", "Keller", "é"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        assert pii._announced(text) or not pii.LEAD.search(text)
