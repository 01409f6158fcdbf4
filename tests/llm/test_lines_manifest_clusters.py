"""Line dedup, the Merkle manifest and centroid clustering against brute force."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import kdfilter, linededup, merkle

from .data import SCHEMA, documents, odd_documents


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# line dedup

BLANKS = " \t\n\x0b\x0c\r"


def kept_lines(rows, min_chars=40, min_docs=5):
    """(id, lines, dropped, sha) of (id, text) rows."""
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    key = lambda x: x.strip(BLANKS).translate(low)
    held, last = collections.Counter(), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            held[k] += 1
            last[k] = max(last.get(k, -(2**63)), -(2**63) if i is None else i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < min_chars or held[key(x)] < min_docs or last[key(x)] == (-(2**63) if i is None else i)]
        out.append((i, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return out


def judged_rows(df):
    rows = df.select("row.doc_id", F.size("lines"), F.size(F.filter("dropped", lambda d: d)), F.sha2(linededup.kept_text(), 256))
    return collections.Counter(tuple(r) for r in rows.collect())


def line_rows():
    rng = random.Random(5)
    common = [f"Line number {k} that many documents of this table hold {'é' * k}" for k in range(12)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(rng.randrange(12)):
            x = rng.choice(common) if rng.random() < 0.6 else f"own line {rng.random()} with enough code points to count"
            lines.append(rng.choice(["", " ", "\t\x0b"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "\r", "  "]))
        rows.append((i * 7 - 100, "\n".join(lines)))
    edge = "x" * 39
    rows += [(1000 + k, f"{edge}\n{edge}é\n{edge}É") for k in range(6)]  # 39, 40 and 40 code points; É is not lower-cased
    rows += [(2000 + k, common[0]) for k in range(2)] + [(None, common[1]), (None, common[1]), (None, None), (3000, ""), (3000, common[2]), (3000, common[2] + "\n" + common[2])]
    rows += [(-5 - k, f"{'only null and low ids hold this line, which has forty'}{k // 5}") for k in range(5)] + [(None, "no id holds this line but null ones, all of them ..")] * 5
    return rows


@pytest.mark.parametrize("shape", [{}, {"shard_keys": 3}, {"shard_keys": 2, "cache_mb": 0, "held_lines": 50}])
def test_lines(spark, shape):
    rows = line_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert judged_rows(linededup.judged(df, **shape)) == collections.Counter(kept_lines(rows))


def test_lines_of_the_common_cases(spark):
    for rows in (documents(), odd_documents()):
        df = spark.createDataFrame(rows, SCHEMA).repartition(3)
        assert judged_rows(linededup.judged(df)) == collections.Counter(kept_lines([(r[0], r[1]) for r in rows]))
        out = linededup.deduplicate(df)
        assert out.columns == df.columns and out.count() == len(rows)
    assert linededup.deduplicate(spark.createDataFrame([], SCHEMA)).count() == 0


def test_lines_that_share_names_with_the_operator(spark):
    rows = [(k, "the same line of more than forty code points in all", "a", "b", "c") for k in range(6)]
    out = linededup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string, row string, lines string, dropped string"))
    assert {(r.doc_id, r.text, r.row) for r in out.collect()} == {(k, rows[0][1] if k == 5 else "", "a") for k in range(6)}


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    rng = np.random.default_rng(n)
    a = rng.integers(0, 2**64, n, np.uint64)
    a[: n // 2] = a[:1]  # halves that are equal don't matter
    b = rng.integers(0, 2**64, n, np.uint64)
    mph = linededup.PerfectHash.build(a, b)
    assert sorted(mph.slots(a, b).tolist()) == list(range(n))
    assert mph.sizes.sum() <= 4.5 * n + 64 * len(mph.sizes)
    counts, owners = np.arange(n) % 300 + 5, np.arange(n) - 7
    shard = linededup.Shard.from_bytes(linededup.Shard.build(a, b, counts, owners).to_bytes())
    got = shard.look(a, b)
    assert (got[0] == counts).all() and (got[1] == owners).all()
    assert not shard.look(rng.integers(0, 2**64, 3000, np.uint64), rng.integers(0, 2**64, 3000, np.uint64))[0].any()


def test_index_counts(spark, tmp_path):
    rows = line_rows()
    keys = linededup.repeated_keys(spark.createDataFrame(rows, "doc_id long, text string"), min_docs=2)
    n, shards = linededup.build_index(keys, f"file://{tmp_path}/index", 4)
    found = keys.collect()
    assert n == -(-len(found) // 4) and sum(r.n_keys for r in shards.collect()) == len(found)
    index = linededup.Index(f"file://{tmp_path}/index", n, {r.shard for r in shards.collect()})
    a, b = (np.array([r[c] for r in found], np.int64).view(np.uint64) for c in ("a", "b"))
    counts, owners = index.look(a, b)
    assert counts.tolist() == [r.n_docs for r in found] and owners.tolist() == [r.owner for r in found]


# Merkle manifest


def manifest(rows):
    """Rows of the query for (doc_id, source, lang, n_chars, text) rows."""
    cell = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r, t: sha(*map(cell, (*r[:4], t)))
    sources = collections.defaultdict(list)
    for r in rows:
        sources[r[1]].append(r)

    def levels(leaves):
        out = [leaves]
        while len(out[-1]) > 1:
            out.append([sha(*out[-1][k : k + 3]) for k in range(0, len(out[-1]), 3)])
        return out

    def path(tree, i):
        for level in tree[:-1]:
            at = i // 3 * 3
            yield i - at, [x for k, x in enumerate(level[at : at + 3]) if k != i - at]
            i //= 3

    names = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    for s in names:
        sources[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
    trees = {s: levels([leaf(r, r[4]) for r in sources[s]]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(sources[s]):
            steps = [*path(trees[s], i), *path(top, k)]
            hit = r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0
            node = leaf(r, r[4].replace("\n", "") if hit else r[4])
            for own, others in steps:
                node = sha(*others[:own], node, *others[own:])
            out.append((r[0], trees[s][0][i], trees[s][-1][0], top[-1][0], sha(*[x for _, o in steps for x in o]), node, node == top[-1][0]))
    return collections.Counter(out)


def verified(spark, rows, partitions=4):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string, node string, tree int" if len(rows and rows[0]) == 7 else "doc_id long, source string, lang string, n_chars long, text string").repartition(partitions)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return collections.Counter(tuple(r) for r in merkle.verify(df, F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))).collect())


def test_manifest_of_odd_rows(spark):
    rows = [(r[0], r[3], r[2], r[4], r[1]) for r in odd_documents()]
    assert verified(spark, rows) == manifest(rows)
    assert verified(spark, [(*r, "clash", 3) for r in rows]) == manifest(rows)
    for few in ([(1, None, None, None, None)], [(2, "a", None, 5, "x\ny")] * 2, [(k, "s", "é", -3, "line\n" * k) for k in range(4)], []):
        assert verified(spark, few) == (manifest(few) if few else collections.Counter())


def test_manifest_of_several_blocks(spark):
    """Trees whose nodes lie in several blocks, at and beside the edges of blocks."""
    size = merkle.FANOUT**merkle.LEVELS
    rows = [(k, name, "en", k, f"a{k}\nb") for name, n in (("one", 1), ("whole", size), ("more", size + 1), ("two", 2 * size + 5)) for k in range(n)]
    assert verified(spark, rows) == manifest(rows)


def test_manifest_of_many_sources(spark):
    rows = [(k, f"s{k % 2400}", "en", 1, "x\ny") for k in range(2600)]
    assert verified(spark, rows) == manifest(rows)


def test_paths_fold_to_the_root():
    for n in (1, 2, 3, 4, 9, 10, 28, 81):
        leaves = merkle.matrix([merkle.digest(bytes([k])) for k in range(n)])
        levels = merkle.levels_of(leaves, True)
        paths = merkle.block_paths(levels, b"")
        assert {merkle.climbed(x.tobytes(), p) for x, p in zip(leaves, paths, strict=True)} == {levels[-1].tobytes()}


# clustering


def clustered(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (sha("1:" + ("" if r[0] is None else str(r[0]))), r[1]))
    centroids = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    near = lambda v: min((far(v, c), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[near(v)[1]].append(v)
        centroids = [[sum(x) // len(groups[n]) for x in zip(*groups[n], strict=True)] if n in groups else c for n, c in enumerate(centroids)]
    return collections.Counter((i, near(v)[1], near(v)[0]) for i, v in kept), centroids


def vectors():
    rng = random.Random(9)
    centres = [[rng.uniform(-0.5, 0.5) for _ in range(64)] for _ in range(9)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in centres[i % 9]]) for i in range(300)]
    rows += [(1000 + k, rows[0][1]) for k in range(120)]  # copies
    rows += [(2000 + k, [float(k % 2)] * 64) for k in range(40)]  # ties
    odd = list(rows[3][1])
    rows += [(1, None), (2, []), (3, odd[:63]), (4, [None, *odd[1:]]), (5, [math.nan, *odd[1:]]), (6, [math.inf, *odd[1:]]), (None, odd), (None, rows[7][1]), rows[5], (7, [-x for x in odd])]
    return rows


@pytest.mark.parametrize("block", [7, 100, 1 << 13])
def test_clusters(spark, block):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).withColumn("cluster", F.lit(1)).repartition(3)
    got, centroids = kdfilter.cluster(kdfilter.quantised(df), block=block)
    want, end = clustered(rows)
    assert centroids.tolist() == end and collections.Counter(tuple(r) for r in got.collect()) == want


def test_few_and_no_vectors(spark):
    rows = [(k, [k / 10] * 64) for k in range(5)]
    got, centroids = kdfilter.cluster(kdfilter.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>")))
    assert len(centroids) == 5 and got.count() == 5
    none, centroids = kdfilter.cluster(kdfilter.quantised(spark.createDataFrame([], "vec_id long, embedding array<float>")))
    assert none.count() == 0 and len(centroids) == 0


def test_large_components(spark):
    big = [(k, [(k - 8) * 80000.25] * 64) for k in range(20)]
    got, centroids = kdfilter.cluster(kdfilter.quantised(spark.createDataFrame(big, "vec_id long, embedding array<double>")))
    want, end = clustered(big)
    assert centroids.tolist() == end and collections.Counter(tuple(r) for r in got.collect()) == want
    with pytest.raises(Exception, match="too large"):
        kdfilter.cluster(kdfilter.quantised(spark.createDataFrame([(1, [1e300] * 64)], "vec_id long, embedding array<double>")))


def test_pruning_leaves_few_candidates():
    """Far groups: most nodes go to a centroid whole, and every vector is assigned once."""
    rng = np.random.default_rng(2)
    points = np.concatenate([rng.integers(0, 40, (4000, 64)) + 1000 * k for k in range(4)]).astype(np.int32)
    tree, order = kdfilter.Tree.build(points)
    centroids = np.array([[20 + 1000 * k] * 64 for k in range(4)])
    whole = sum(len(n) for n, _, leaf in tree.parts(centroids) if leaf is None)
    rows = sum(len(n) for n, _, leaf in tree.parts(centroids) if leaf is not None)
    near, far = tree.closest(centroids)
    assert whole <= 16 and rows == 0 and (near == order // 4000).all()
    assert (far == ((tree.points.astype(np.int64) - centroids[near]) ** 2).sum(1)).all()
    counts, sums = tree.totals(centroids)
    assert counts.tolist() == [4000] * 4 and (sums == [points[k * 4000 : (k + 1) * 4000].sum(0) for k in range(4)]).all()
