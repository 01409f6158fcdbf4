"""Centroid clustering of vectors by kd-tree filtering, exact in integers.

Vectors become integers, floor(64 x). Each task cuts its partition into blocks
of at most ``BLOCK`` vectors and builds a kd-tree over each: nodes hold a count,
the integer sum of their vectors and their box. Blocks are stored once and every
round goes over them: all centroids start at a root; at a node those strictly
dominated over the whole box by the one nearest to its middle are pruned; a node
with one centroid left goes to it whole, by its count and sum; at a leaf the
vectors decide. A tie is no domination, so it reaches a leaf, where the smaller
number wins. A task gives one row for each centroid, so a round's shuffle grows
with the tasks, and only sums by centroid reach the driver.

All comparisons are of whole numbers: products of blocks whose values are small
enough run as doubles, which hold them exactly, others as 64-bit integers.

Defined cases: vectors that are null, of another length, or with a null or
non-finite component are left out; repeated vectors and ids are rows of their
own; a null id counts as an empty text in the order of first centroids, and ties
of that order go by the components; with fewer vectors than centroids there are
as many centroids as vectors; a component beyond ``LARGEST`` after quantising
raises, as squared distances would not fit in 64 bits; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches, stored, table

DIM = 64
SCALE = 64
K = 16
ROUNDS = 3
BLOCK = 1 << 13
LEAF = 32
LARGEST = 1 << 26
DOUBLES = 1 << 20  # components up to here keep products of vectors exact in doubles
TREE = "ids binary, nulls binary, points binary, first binary, last binary, child binary, sums binary, low binary, high binary"


# trees


class Tree:
    """A kd-tree over the rows of an integer matrix, nodes level by level; a node holds the rows first to last - 1."""

    def __init__(self, points, first, last, child, sums, low, high):
        self.points, self.first, self.last, self.child, self.sums, self.low, self.high = points, first, last, child, sums, low, high

    @classmethod
    def build(cls, points: np.ndarray, leaf: int = LEAF) -> tuple[Tree, np.ndarray]:
        """The tree, and the order in which it holds the rows."""
        order = np.arange(len(points))
        first, last, child, sums, low, high = [0], [len(points)], [], [], [], []
        at = 0
        while at < len(first):
            a, z = first[at], last[at]
            own = points[order[a:z]]
            lo, hi = own.min(0), own.max(0)
            sums.append(own.sum(0, dtype=np.int64))
            low.append(lo)
            high.append(hi)
            axis = int((hi - lo).argmax())
            if z - a <= leaf or lo[axis] == hi[axis]:
                child.append(-1)
            else:
                mid = (z - a) // 2
                order[a:z] = order[a:z][np.argpartition(own[:, axis], mid)]
                child.append(len(first))
                first += [a, a + mid]
                last += [a + mid, z]
            at += 1
        ints = lambda x: np.array(x, np.int64)
        return cls(points[order], ints(first), ints(last), ints(child), np.stack(sums), np.stack(low), np.stack(high)), order

    def parts(self, centroids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
        """(nodes, candidates, None) of nodes that go to one centroid whole; (rows, closest, distances) of leaves' rows."""
        norm = (centroids * centroids).sum(1)
        nodes, open_ = np.zeros(1, np.int64), np.ones((1, len(centroids)), bool)
        while len(nodes):
            lo, hi = self.low[nodes], self.high[nodes]
            # twice the middle of the box: |2c - m|^2 less |m|^2
            middle = 4 * norm - 4 * products(lo + hi, centroids)
            best = np.where(open_, middle, np.iinfo(np.int64).max).argmin(1)
            # the least over the box of |p - c|^2 - |p - best|^2 takes, by the sign of c - best, either end of each side
            ahead = centroids[None] - centroids[best][:, None]
            least = norm[None] - norm[best][:, None] - 2 * (np.maximum(ahead, 0) * hi[:, None] + np.minimum(ahead, 0) * lo[:, None]).sum(2)
            open_ &= least <= 0
            one = open_.sum(1) == 1
            if one.any():
                yield nodes[one], best[one], None
            leaves = ~one & (self.child[nodes] < 0)
            if leaves.any():
                rows, owner = spread(self.first[nodes[leaves]], self.last[nodes[leaves]])
                far = norm - 2 * products(self.points[rows], centroids)
                far = np.where(open_[leaves][owner], far, np.iinfo(np.int64).max)
                near = far.argmin(1)
                own = self.points[rows].astype(np.int64)
                yield rows, near, far[np.arange(len(rows)), near] + (own * own).sum(1)
            inner = ~one & ~leaves
            below = self.child[nodes[inner]]
            nodes, open_ = np.concatenate([below, below + 1]), np.concatenate([open_[inner]] * 2)

    def totals(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums of the vectors closest to each centroid."""
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for some, near, leaf in self.parts(centroids):
            one = leaf is None
            np.add.at(counts, near, (self.last - self.first)[some] if one else 1)
            np.add.at(sums, near, (self.sums if one else self.points)[some])
        return counts, sums

    def closest(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the number of its closest centroid, and the squared distance."""
        out, far = np.empty(len(self.points), np.int64), np.empty(len(self.points), np.int64)
        for some, near, leaf in self.parts(centroids):
            if leaf is None:
                rows, owner = spread(self.first[some], self.last[some])
                gap = self.points[rows].astype(np.int64) - centroids[near[owner]]
                out[rows], far[rows] = near[owner], (gap * gap).sum(1)
            else:
                out[some], far[some] = near, leaf
        return out, far

    def columns(self) -> list[bytes]:
        return [x.tobytes() for x in (self.points, self.first, self.last, self.child, self.sums, self.low, self.high)]

    @classmethod
    def of(cls, row: dict, dim: int = DIM) -> Tree:
        kind = {"points": np.int32, "low": np.int32, "high": np.int32}
        parts = {k: np.frombuffer(row[k], kind.get(k, np.int64)) for k in ("points", "first", "last", "child", "sums", "low", "high")}
        return cls(*(x.reshape(-1, dim) if k in ("points", "sums", "low", "high") else x for k, x in parts.items()))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a times b transposed, exact."""
    most = max(int(np.abs(x).max(initial=0)) for x in (a, b))
    if most <= DOUBLES:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a.astype(np.int64) @ b.T.astype(np.int64)


def spread(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All rows of ranges, and which range each is of."""
    size = last - first
    owner = np.repeat(np.arange(len(first)), size)
    return np.arange(len(owner)) + (first - (np.cumsum(size) - size))[owner], owner


# jobs


def _kept(vector: Column) -> Column:
    return vector.isNotNull() & (F.size(vector) == DIM) & F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))


def quantised(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that are kept, as integers; stored."""
    whole = F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))
    checked = F.transform(whole, lambda x: F.when(F.abs(x) <= LARGEST, x.cast("int")).otherwise(F.raise_error(F.lit("a component is too large to cluster in 64 bits")).cast("int")))
    return df.where(_kept(F.col(vector))).select(F.col(key).cast("long").alias("id"), checked.alias("v"))


def first_centroids(points: DataFrame, k: int = K, salt: str = "1") -> np.ndarray:
    """The vectors of the k smallest hashes of an id, in the order of the hashes; k rows reach the driver."""
    hashed = points.withColumn("h", F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256))
    return np.array([r.v for r in hashed.orderBy("h", "v").limit(k).select("v").collect()], np.int64).reshape(-1, DIM)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.Array, pa.Array]]:
    held, total = [], 0
    for b in batches:
        at = 0
        while at < b.num_rows:
            some = b.slice(at, size - total)
            held.append(some)
            total, at = total + some.num_rows, at + some.num_rows
            if total == size:
                yield _joined(held)
                held, total = [], 0
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> tuple[pa.Array, pa.Array]:
    one = pa.concat_batches(held)
    return one.column("id"), one.column("v")


def _grow(block: int):
    names = [p.split()[0] for p in TREE.split(", ")]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _blocks(batches, block):
            points = np.asarray(vectors.flatten()).reshape(-1, DIM)
            tree, order = Tree.build(points)
            nulls = np.asarray(ids.is_null())[order]
            own = np.asarray(ids.fill_null(0))[order]
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (own.tobytes(), nulls.tobytes(), *tree.columns())], names=names)

    return grow


def trees(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each block of a partition's vectors, with its kd-tree; stored."""
    return stored(points.mapInArrow(_grow(block), TREE), "kd-trees")


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(len(centroids), np.int64), np.zeros(centroids.shape, np.int64)
        for b in batches:
            for row in b.to_pylist():
                c, s = Tree.of(row).totals(centroids)
                counts += c
                sums += s
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts), pa.array(list(sums))], names=["cluster", "n", "sums"])

    return run


def moved(forest: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after a round: floor of the mean of each one's vectors; those without any stay."""
    got = forest.mapInArrow(_sums(centroids), "cluster long, n long, sums array<long>")
    total = [F.sum(F.get("sums", k)).alias(f"s{k}") for k in range(DIM)]
    out = centroids.copy()
    for r in got.groupBy("cluster").agg(F.sum("n").alias("n"), *total).collect():
        if r.n:
            out[r.cluster] = [r[f"s{k}"] // r.n for k in range(DIM)]
    return out


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                near, far = Tree.of(row).closest(centroids)
                ids = pa.array(np.frombuffer(row["ids"], np.int64), mask=np.frombuffer(row["nulls"], bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(near.astype(np.int32)), pa.array(far)], names=["id", "cluster", "distance"])

    return run


def cluster(points: DataFrame, k: int = K, rounds: int = ROUNDS, salt: str = "1", block: int = BLOCK) -> tuple[DataFrame, np.ndarray]:
    """(id, cluster, distance) of every vector of ``quantised``, and the final centroids."""
    small_batches(points.sparkSession)
    points = stored(points, "kd-points")
    centroids = first_centroids(points, k, salt)
    forest = trees(points, block)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(forest, centroids)
    return stored(forest.mapInArrow(_assigned(centroids), "id long, cluster int, distance long"), "kd-assigned"), centroids


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, centroids = cluster(quantised(table(spark, sf_dir, "embeddings")))
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    # a row for each centroid: K at most
    sums = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    total = sum(int(r.s) for r in sums)
    facts = spark.createDataFrame([(r.cluster, int(r.s), total, names[r.cluster]) for r in sums], "__cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(facts), F.col("cluster") == F.col("__cluster")).select(F.col("id").alias("vec_id"), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = K, rounds: int = ROUNDS) -> str:
    pair = "list_sum(list_transform(list_zip(v, cv), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    near = lambda c: f"(SELECT i, v, min(struct_pack(d := {pair}, c := c)) AS m FROM p, {c} GROUP BY i, v)"
    steps = []
    for n in range(rounds):
        steps.append(f"n{n} AS (SELECT m.c AS c, j, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM (SELECT m, generate_subscripts(v, 1) AS j, unnest(v) AS x FROM {near(f'c{n}')}) GROUP BY ALL)")
        steps.append(f"c{n + 1} AS (SELECT c{n}.c, coalesce(list(x ORDER BY j) FILTER (WHERE x IS NOT NULL), any_value(cv)) AS cv FROM c{n} LEFT JOIN n{n} ON n{n}.c = c{n}.c GROUP BY c{n}.c)")
    return f"""WITH p AS (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
   FROM embeddings WHERE len(embedding) = {DIM} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIM}),
 c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v AS cv FROM (SELECT v, sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM p ORDER BY h, v LIMIT {k})),
 {", ".join(steps)},
 f AS (SELECT vec_id, m.c AS c, m.d AS d FROM {near(f"c{rounds}")} JOIN p USING (i))
SELECT vec_id, CAST(f.c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY f.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(cv, ',')) AS centroid_sha256
FROM f JOIN c{rounds} USING (c)"""


ORACLE_SQL = _oracle()
