"""Near copies against all pairs."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyforge.llm import nearcopies as near

from .data import SCHEMA, documents, odd_documents


def edited(text, share, rng):
    return " ".join(f"w{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


def corpus():
    rng, rows = random.Random(8), []
    for k in range(40):
        base = " ".join(f"v{rng.randrange(4000)}" for _ in range(rng.choice([60, 150, 400])))
        rows += [base, edited(base, 0.004, rng), edited(base, 0.015, rng), edited(base, 0.06, rng)]
    family = " ".join(f"u{rng.randrange(900)}" for _ in range(200))
    rows += [family + f" end {k}" for k in range(150)]
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(k * 2 + 1, rows[o], "en", "s", 1, None, None) for k, o in enumerate(order)]


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set()


def similar(rows):
    sets = [shingles(r[1] or "") for r in rows]
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                yield rows[i][0], rows[j][0]


def test_classes_against_all_pairs(spark):
    rows = corpus()
    got = {r.doc_id: r.component_id for r in near.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    parent = {r[0]: r[0] for r in rows}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = list(similar(rows))
    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    assert np.mean([got[a] == got[b] for a, b in pairs]) > 0.97
    assert all(root(i) == root(c) for i, c in got.items())  # nothing else is joined


def survivors(rows):
    """Of each class the row first by id (none before all), hash and size of its text, then by all columns."""
    import ctypes

    distinct = {}
    for r in rows:
        k = (r[0], r[1] or "")
        low = tuple((x is not None, x) for x in r)
        if k not in distinct or low < distinct[k][0]:
            distinct[k] = (low, r)
    keys = sorted(distinct, key=lambda k: (k[0] is not None, k[0] or 0, ctypes.c_int64(xxhash.xxh64_intdigest(k[1].encode(), 42)).value, len(k[1])))
    sets, parent = [shingles(t) for _, t in keys], list(range(len(keys)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(keys)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [distinct[k][1] for i, k in enumerate(keys) if root(i) == i]


def test_rows_that_stay(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    out = near.deduplicate(df)
    assert out.columns == df.columns
    classes = {r.doc_id: r.component_id for r in near.classes(df).collect()}
    assert sorted(r.doc_id for r in out.collect()) == sorted(i for i, c in classes.items() if i == c)
    texts = {r[0]: r[1] or "" for r in documents()}
    first = {}
    for i in sorted(texts):
        assert classes[i] <= first.setdefault(texts[i], i)
    odd = spark.createDataFrame(odd_documents(), SCHEMA)
    kept = near.deduplicate(odd)
    assert kept.columns == odd.columns
    got, rows = kept.collect(), odd_documents()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr(r) for r in survivors(rows))
    assert near.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize(("limit", "held"), [(2, 50), (64, 10**6)])
def test_dense_postings_stay_connected(limit, held, monkeypatch):
    monkeypatch.setattr(near, "PAIRWISE", limit)
    monkeypatch.setattr(near, "HELD", held)
    rng = random.Random(1)
    base = " ".join(f"a{rng.randrange(500)}" for _ in range(150))
    texts = [edited(base, 0.01, rng).encode() for _ in range(90)]
    prints = near.wide_fingerprints(texts)
    label, total = np.arange(90), 0
    for p in range(0, near.POSITIONS, 2):
        a, b, bits = near.posting_links(np.arange(90), prints, p)
        assert (a < b).all() and len(a) < 90 and (bits <= near.BITS).all()
        total += len(a)
        for _ in range(9):
            for x, y in zip(a, b, strict=True):
                label[label == max(label[x], label[y])] = min(label[x], label[y])
    assert np.bincount(label).max() > 80 and total < 16 * 90


def test_forest_is_the_lightest():
    rng = np.random.default_rng(4)
    n = 40
    u, v = np.triu_indices(n, 1)
    keep = rng.random(len(u)) < 0.15
    u, v = u[keep], v[keep]
    bits = rng.integers(0, 9, len(u))
    got = near.forest(n, u, v, bits)
    label, want = list(range(n)), 0
    for w, x, y in sorted(zip(bits.tolist(), u.tolist(), v.tolist(), strict=True)):
        if label[x] != label[y]:
            want += w
            label = [label[x] if k == label[y] else k for k in label]
    assert got[2].sum() == want and len(got[0]) == n - len(set(label))
    assert len(near.forest(3, u[:0], v[:0], bits[:0])[0]) == 0


def test_dense_postings_are_divided(monkeypatch):
    monkeypatch.setattr(near, "DENSE", 5)
    rng = np.random.default_rng(0)
    prints = rng.integers(0, 3, (200, near.WIDE)).astype(np.uint8)
    key = near._divided(prints[:, 0].astype(np.int32), prints, 0)
    groups = [np.flatnonzero(key == k) for k in np.unique(key)]
    assert max(map(len, groups)) <= 5 and all(len(set(prints[g, 0].tolist())) == 1 for g in groups)
    same = np.zeros((9, near.WIDE), np.uint8)
    assert len(np.unique(near._divided(same[:, 0].astype(np.int32), same, 0))) == 1


def test_verification_in_parts(spark, monkeypatch):
    monkeypatch.setattr(near, "PART", 2)
    text = " ".join(f"x{k}" for k in range(60))
    df = spark.createDataFrame([(k, text + f" y{k}") for k in range(9)] + [(50, "other words")], "doc_id long, text string")
    pairs = spark.createDataFrame([(0, k) for k in [*range(1, 9), 50]], "a long, b long")
    assert {r.b for r in near.verified(df, pairs).collect()} == set(range(1, 9))
    assert near.jaccard(near.shingles(b"", 5), near.shingles(b"", 5)) == 1.0
    assert df.where(F.col("doc_id") < 0).count() == 0


def test_texts_that_share_a_run_stay_apart(spark):
    """A run of one word fixes the fingerprints of multisets; the texts have next to nothing in common."""
    rng = random.Random(5)
    rows = []
    for k in range(6):
        own = [f"r{rng.randrange(10**6)}" for _ in range(1000)]
        rows.append((k, " ".join(own[:500] + ["same"] * 150 + own[500:]), "en", "s", 1, None, None))
    got = {r.doc_id: r.component_id for r in near.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {k: k for k in range(6)}
    prints = near.wide_fingerprints([r[1].encode() for r in rows])
    assert np.bitwise_count(prints[0, near.POSITIONS :] ^ prints[1, near.POSITIONS :]).sum() > near.BITS


def test_appended_passages(spark):
    """Copies that differ in one piece at the end, at 0.8 and just above: all are found."""
    rng, rows = random.Random(6), []
    for k in range(60):
        n = rng.choice([30, 104, 204, 404])
        own = [f"p{rng.randrange(10**6)}" for _ in range(n)]
        more = [f"p{rng.randrange(10**6)}" for _ in range(int((n - 4) * (0.25, 0.24, 0.18)[k % 3]))]
        rows += [(4 * k, " ".join(own), "en", "s", 1, None, None), (4 * k + 1, " ".join(own + more), "en", "s", 1, None, None)]
    pairs = list(similar(rows))
    got = {r.doc_id: r.component_id for r in near.classes(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(pairs) == 60 and all(got[a] == got[b] for a, b in pairs)


def test_prefix_pairs_hold_all_similar_pairs():
    rows = corpus()
    texts = [r[1].encode() for r in rows]
    hashes, size = near._distinct(*near._windows(*near._word_hashes(texts), 5))
    top, n = np.unique(hashes, return_counts=True)
    want = {(min(a, b), max(a, b)) for a, b in similar(rows)}
    for common in ((top[n > 2], n[n > 2]), (top[:0], n[:0]), (top[::3], n[::3])):  # any order will do
        first, many = near.prefixes(hashes, size, common, 0.8)
        posted = np.zeros(len(first), near.POSTING)
        ids = np.array([r[0] for r in rows])
        posted["hash"], posted["id"], posted["root"], posted["size"] = first, np.repeat(ids, many), np.repeat(ids, many), np.repeat(size, many)
        posted["place"] = np.concatenate([np.arange(m) for m in many])
        assert want <= set(map(tuple, near.prefix_pairs(posted, 0.8).tolist()))
        posted["root"] = 1
        assert len(near.prefix_pairs(posted, 0.8)) == 0


def test_a_failed_link_does_not_part_a_class(spark, monkeypatch):
    """x-y is below the threshold and displaces x-z in the forest; x still meets z."""
    rng = random.Random(7)
    own = [f"q{rng.randrange(10**6)}" for _ in range(204)]
    rows = [(1, " ".join(own[:-24])), (2, " ".join(own[24:])), (3, " ".join(own))]  # x, y, z
    links = [(1, 2, 140), (2, 3, 141)]
    monkeypatch.setattr(near, "candidates", lambda reps: spark.createDataFrame(links, "a long, b long, bits long"))
    full = [(*r, "en", "s", 1, None, None) for r in rows]
    assert sorted(tuple(sorted(p)) for p in similar(full)) == [(1, 3), (2, 3)]
    got = {r.doc_id: r.component_id for r in near.classes(spark.createDataFrame(full, SCHEMA)).collect()}
    assert got == {1: 1, 2: 1, 3: 1}


def test_divided_postings_lose_no_link(spark, monkeypatch):
    """Postings divided down to one entry give no fingerprint link at all; the classes stay whole."""
    monkeypatch.setattr(near, "DENSE", 1)
    rng = random.Random(9)
    base = " ".join(f"d{rng.randrange(10**6)}" for _ in range(200))
    rows = [(k, base + f" e{k}" * 1 + " " + " ".join(f"f{rng.randrange(10**6)}" for _ in range(18)), "en", "s", 1, None, None) for k in range(40)]

    def divided(reps):
        got = reps.collect()
        ids, prints = np.array([r.id for r in got]), np.stack([np.frombuffer(r.fp, np.uint8) for r in got])
        links = {x for p in range(0, near.POSITIONS, 2) for x in zip(*(c.tolist() for c in near.posting_links(ids, prints, p)), strict=True)}
        assert not links
        return spark.createDataFrame([], "a long, b long, bits long")

    monkeypatch.setattr(near, "candidates", divided)
    assert len(list(similar(rows))) == 40 * 39 // 2
    assert {r.component_id for r in near.classes(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}


def test_a_posting_lies_in_one_bucket():
    """Every entry goes to a bucket for each two positions; equal values there meet, and one common byte fills no bucket."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    prints = rng.integers(0, 256, (4000, near.WIDE), dtype=np.uint8)
    prints[:3000, 0] = 7
    batch = pa.RecordBatch.from_arrays([pa.array(range(4000), pa.int64()), pa.array([p.tobytes() for p in prints])], names=["id", "fp"])
    where, filled = {}, []
    for out in near._postings(64)(iter([batch, batch.slice(0, 0)])):
        for r in out.to_pylist():
            ids = np.frombuffer(r["ids"], np.int64)
            assert (np.frombuffer(r["fps"], np.uint8).reshape(-1, near.WIDE) == prints[ids]).all()
            filled.append(len(ids))
            for i in ids.tolist():
                p = r["position"]
                assert where.setdefault((p, *prints[i, p : p + 2].tolist()), r["bucket"]) == r["bucket"]
    assert sum(filled) == 4000 * near.POSITIONS // 2 and max(filled) < 250
