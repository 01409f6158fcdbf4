"""Merkle manifest of a dataset: a digest for each row, a tree for each source, one root.

H is the lower-case hex SHA-256 of its inputs joined. Leaves are made on the JVM.
They are numbered in the order of their tree across partitions, without a task
that sees a whole tree, and cut into aligned blocks of ``FANOUT ** LEVELS``
leaves: a block's inner nodes hang on its own leaves alone. A block is one
group: its leaves are a contiguous matrix of 64-byte rows, reshaped by the
fanout and hashed row by row, level after level. Roots of blocks are the leaves
of the next round, so a tree of n leaves takes log(n) / log(2187) rounds and a
hot source costs more blocks, not larger ones. The roots of sources are the
leaves of one more tree, built the same way.

Going down, every block gets the path from its root to the top (the siblings of
each level, a few hundred bytes); siblings within the block follow from the
place of a leaf by index arithmetic. A leaf is verified by folding it with its
siblings up to the root, in both trees.

Defined cases: leaves ascend by id, null ids first; rows that share an id are
ordered by their leaf; a null column is written ``-``; a tree of one leaf is
that leaf, and the digest of no siblings is that of nothing; a row with a null
id is never tampered with; an empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import partitions, small_batches, stored, table

FANOUT = 3
LEVELS = 7  # of a block
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
DIGEST = 64  # bytes of hex text


# digests of bytes and of matrices


def digest(data) -> bytes:
    return hashlib.sha256(data).hexdigest().encode()


def matrix(digests: list[bytes]) -> np.ndarray:
    """Digests as rows of 64 bytes."""
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, DIGEST)


def rows_hashed(rows: np.ndarray) -> list[bytes]:
    return [digest(row) for row in np.ascontiguousarray(rows)]


def next_level(nodes: np.ndarray, fanout: int = FANOUT) -> np.ndarray:
    """The parents of successive nodes: whole runs are one reshaped matrix, what is left is one run more."""
    whole = len(nodes) // fanout * fanout
    up = rows_hashed(nodes[:whole].reshape(-1, fanout * DIGEST))
    if whole < len(nodes):
        up.append(digest(nodes[whole:].tobytes()))
    return matrix(up)


def levels_of(leaves: np.ndarray, alone: bool, levels: int = LEVELS, fanout: int = FANOUT) -> list[np.ndarray]:
    """The levels of a block from its leaves to its root. alone: it is its whole tree, which ends at one node."""
    out = [leaves]
    while len(out[-1]) > 1 or not (alone or len(out) > levels):
        out.append(next_level(out[-1], fanout))
    return out


def siblings_of(level: np.ndarray, at: np.ndarray, fanout: int = FANOUT) -> tuple[np.ndarray, np.ndarray]:
    """For nodes ``at`` of a level: their run's other nodes, (n, fanout - 1, 64), and which of these exist."""
    place = np.arange(fanout - 1)
    other = (at - at % fanout)[:, None] + place + (place >= (at % fanout)[:, None])
    there = other < len(level)
    return level[np.minimum(other, len(level) - 1)], there


def fold_step(nodes: np.ndarray, own: np.ndarray, others: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Parents of nodes, from each one's place in its run and its siblings."""
    n, k = others.shape[:2]
    # a node stands before the siblings from its own place on
    run = np.empty((n, k + 1, DIGEST), np.uint8)
    slot = np.arange(k)[None, :] + (np.arange(k)[None, :] >= own[:, None])
    run[np.arange(n)[:, None], slot] = others
    run[np.arange(n), own] = nodes
    size = (1 + there.sum(1)) * DIGEST
    flat = run.reshape(n, -1)
    return matrix([digest(row[:s]) for row, s in zip(flat, size.tolist(), strict=True)])


# paths: what stands above a node, as bytes: per level the own place, the number of siblings, the siblings


def packed(own: int, others: bytes) -> bytes:
    return bytes([own, len(others) // DIGEST]) + others


def steps(path: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(path):
        own, n = path[at], path[at + 1]
        yield own, path[at + 2 : at + 2 + n * DIGEST]
        at += 2 + n * DIGEST


def climbed(node: bytes, path: bytes) -> bytes:
    """A node folded along a path."""
    for own, others in steps(path):
        node = digest(others[: own * DIGEST] + node + others[own * DIGEST :])
    return node


def block_paths(levels: list[np.ndarray], above: bytes) -> list[bytes]:
    """The path of each leaf of a block, up to the end of ``above``."""
    at = np.arange(len(levels[0]))
    out = [b""] * len(at)
    for level in levels[:-1]:
        others, there = siblings_of(level, at)
        count = there.sum(1)
        out = [o + packed(own, row[:c].tobytes()) for o, own, row, c in zip(out, (at % FANOUT).tolist(), others, count.tolist(), strict=True)]
        at = at // FANOUT
    return [o + above for o in out]


# numbers of leaves


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order, with their partition and their place among its rows of the same tree."""
    part, last, at = TaskContext.get().partitionId(), None, 0
    for b in batches:
        tree = b.column("tree").dictionary_encode()
        code, names = np.asarray(tree.indices), tree.dictionary.to_pylist()
        first = np.flatnonzero(np.diff(code, prepend=-1))
        place = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
        if len(code):
            if names[code[0]] == last:
                place[: first[1] if len(first) > 1 else len(code)] += at
            last, at = names[code[-1]], int(place[-1]) + 1
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, part)), pa.array(place)], names=[*b.schema.names, "__part", "__place"])


def numbered(rows: DataFrame, order: list[str], tag: str) -> DataFrame:
    """``rows`` (tree, ...) with ``pos``, their place in their tree by ``order``, and ``n``, its rows; stored.

    Rows are range partitioned by tree and order; a table of one row per partition and tree in it gives where each begins.
    """
    kind = StructType([*rows.schema.fields, StructField("__part", LongType()), StructField("__place", LongType())])
    ranged = rows.repartitionByRange(partitions(rows.sparkSession), "tree", *order).sortWithinPartitions("tree", *order)
    own = stored(ranged.mapInArrow(_placed, kind), f"{tag}-places")
    counts = own.groupBy(F.col("tree").alias("__tree"), F.col("__part").alias("__own")).agg(F.count("*").alias("__n"))
    so_far = Window.partitionBy("__tree").orderBy("__own")
    counts = counts.withColumns({"__begin": F.sum("__n").over(so_far) - F.col("__n"), "n": F.sum("__n").over(Window.partitionBy("__tree"))})
    out = own.join(counts.drop("__n"), (F.col("tree") == F.col("__tree")) & (F.col("__part") == F.col("__own")))
    return stored(out.select(*rows.columns, (F.col("__begin") + F.col("__place")).alias("pos"), "n"), f"{tag}-leaves")


# trees


def _in_block(rows: pa.Table) -> tuple[pa.Table, np.ndarray, bool]:
    rows = rows.sort_by("pos")
    n = rows.column("n")[0].as_py()
    return rows, matrix([x.encode() for x in rows.column("node").to_pylist()]), n <= FANOUT**LEVELS


def _block_root(rows: pa.Table) -> pa.Table:
    tree = rows.column("tree")[0].as_py()
    rows, leaves, alone = _in_block(rows)
    block = rows.column("pos")[0].as_py() // FANOUT**LEVELS
    root = levels_of(leaves, alone)[-1].tobytes().decode()
    up = -(-rows.column("n")[0].as_py() // FANOUT**LEVELS)
    return pa.table({"tree": [tree], "pos": [block], "n": [up], "node": [root]})


def _above(nodes: pa.Table, tops: pa.Table) -> pa.Table:
    """The path of each node of a block, the block's own path being given."""
    if not nodes.num_rows:
        return pa.table({"tree": pa.array([], pa.string()), "block": pa.array([], pa.int64()), "path": pa.array([], pa.binary())})
    rows, leaves, alone = _in_block(nodes)
    paths = block_paths(levels_of(leaves, alone), tops.column("path")[0].as_py() or b"" if tops.num_rows else b"")
    return pa.table({"tree": rows.column("tree"), "block": rows.column("pos"), "path": pa.array(paths, pa.binary())})


NODES = "tree string, pos long, n long, node string"


def _blocks(nodes: DataFrame):
    return nodes.withColumn("block", F.floor(F.col("pos") / FANOUT**LEVELS).cast("long"))


def rounds_of(leaves: DataFrame) -> list[DataFrame]:
    """The nodes (tree, pos, n, node) of each round: the leaves, the blocks' roots, their blocks' roots; last, one node a tree."""
    out, most = [leaves.select("tree", "pos", "n", "node")], leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        out.append(stored(_blocks(out[-1]).groupBy("tree", "block").applyInArrow(lambda rows: _block_root(rows), NODES), "merkle-round"))
        most = -(-most // FANOUT**LEVELS)
    return out


def tops(rounds: list[DataFrame], above: DataFrame | None = None) -> DataFrame:
    """(tree, block, path): the path of every block of leaves. above: (tree, path) of the trees' own roots."""
    if above is None:
        paths = rounds[-1].select("tree", F.col("pos").alias("block"), F.lit(b"").alias("path"))
    else:
        paths = above.select("tree", F.lit(0).cast("long").alias("block"), "path")
    for nodes in rounds[-2:0:-1]:
        grouped = _blocks(nodes).groupBy("tree", "block").cogroup(paths.groupBy("tree", "block"))
        paths = stored(grouped.applyInArrow(lambda n, t: _above(n, t), "tree string, block long, path binary"), "merkle-paths")
    return paths


def _judge(rows: pa.Table, top: pa.Table, root: bytes) -> pa.Table:
    """What ``verify`` gives for a block of leaves, the path and subroot of its tree being given."""
    rows, leaves, alone = _in_block(rows)
    levels, above = levels_of(leaves, alone), top.column("path")[0].as_py()
    n, at = len(leaves), np.arange(len(leaves))
    cells, marks = [], []
    changed = matrix([x.encode() for x in rows.column("other").to_pylist()])
    for level in levels[:-1]:
        others, there = siblings_of(level, at)
        cells.append(others)
        marks.append(there)
        changed = fold_step(changed, at % FANOUT, others, there)
        at = at // FANOUT
    # siblings above the block are the same for all its leaves
    rest = b"".join(others for _, others in steps(above))
    inner = np.concatenate([np.zeros((n, 0, DIGEST), np.uint8), *cells], axis=1)
    there = np.concatenate([np.zeros((n, 0), bool), *marks], axis=1)
    full = there.all(1).tolist()
    proofs = [digest((row if f else row[t]).tobytes() + rest).decode() for row, t, f in zip(inner, there, full, strict=True)]
    folded: dict[bytes, str] = {}
    ends = []
    for row in changed:
        node = row.tobytes()
        if node not in folded:
            folded[node] = climbed(node, above).decode()
        ends.append(folded[node])
    said = root.decode()
    return pa.table(
        {
            "doc_id": rows.column("doc_id"), "leaf": rows.column("node"), "subroot": pa.array([top.column("subroot")[0].as_py()] * n, pa.string()), "root": pa.array([said] * n, pa.string()),
            "proof_sha256": pa.array(proofs, pa.string()), "folded_root": pa.array(ends, pa.string()), "verified": pa.array([e == said for e in ends], pa.bool_()),
        }
    )


def leaf(*columns: Column) -> Column:
    """H of columns, each ``-`` if null, else its UTF-8 byte count, a colon and itself."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


RESULT = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def verify(docs: DataFrame, tampered: Column) -> DataFrame:
    """A row per document: its leaf, its trees' roots, the digest of its proof, and the root that ``tampered``'s leaf folds to.

    tampered: the text to recompute the leaf from; equal to ``text`` where nothing was done.
    """
    spark = docs.sparkSession
    small_batches(spark)
    tree = F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))
    own = [F.col(c) for c in COLUMNS]
    light = stored(docs.select("doc_id", tree.alias("tree"), leaf(*own).alias("node"), leaf(*own[:-1], tampered).alias("other")), "merkle-digests")
    leaves = numbered(light, ["doc_id", "node"], "merkle")
    rounds = rounds_of(leaves)
    subroots = rounds[-1].select("tree", "node")
    upper = numbered(subroots.select(F.lit("root").alias("tree"), F.col("tree").alias("name"), "node"), ["name"], "merkle-sources")
    upper_rounds = rounds_of(upper)
    first = upper_rounds[-1].select("node").first()
    root = first[0].encode() if first else b""
    over = tops(upper_rounds)
    named = _blocks(upper).groupBy("tree", "block").cogroup(over.groupBy("tree", "block"))
    source_paths = stored(named.applyInArrow(lambda n, t: _named(n, t), "tree string, path binary, subroot string"), "merkle-source-paths")
    paths = tops(rounds, source_paths.select("tree", "path")).join(source_paths.select(F.col("tree").alias("__tree"), "subroot"), F.col("tree") == F.col("__tree")).drop("__tree")
    grouped = _blocks(leaves).groupBy("tree", "block").cogroup(paths.groupBy("tree", "block"))
    return grouped.applyInArrow(lambda rows, top: _judge(rows, top, root), RESULT)


def _named(nodes: pa.Table, top: pa.Table) -> pa.Table:
    """(tree, path, subroot) of the sources in a block of the upper tree."""
    rows, leaves, alone = _in_block(nodes)
    paths = block_paths(levels_of(leaves, alone), top.column("path")[0].as_py())
    return pa.table({"tree": rows.column("name"), "path": pa.array(paths, pa.binary()), "subroot": rows.column("node")})


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    return verify(docs, F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))


def _oracle(levels: int = 16, upper: int = 8) -> str:
    """SQL for up to 3 ** levels rows a source and 3 ** upper sources: a level of the trees after the other."""
    part = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || {c}, '-')"
    leaf_of = lambda text: "sha256(" + " || ".join(map(part, [*COLUMNS[:-1], text])) + ")"
    up = lambda a, b: f"{b} AS (SELECT s, pos // 3 AS pos, (max(n) + 2) // 3 AS n, CASE WHEN max(n) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY pos)) END AS h FROM {a} GROUP BY s, pos // 3)"
    low = [up(f"a{k}", f"a{k + 1}") for k in range(levels)]
    high = [up(f"u{k}", f"u{k + 1}") for k in range(upper)]
    nodes = " UNION ALL ".join([f"SELECT {k} AS level, s, pos, n, h FROM a{k}" for k in range(levels)] + [f"SELECT {levels + k}, s, pos, n, h FROM u{k}" for k in range(upper)])
    return f"""WITH tab AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) r(i))),
 c AS (SELECT d.*, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) % 2 AS odd FROM documents d, tab),
 d AS (SELECT *, {leaf_of("text")} AS leaf, {leaf_of("changed")} AS other, coalesce('s' || source, 'n') AS s FROM (SELECT *, CASE WHEN odd = 0 THEN replace(text, chr(10), '') ELSE text END AS changed FROM c)),
 p AS (SELECT row_number() OVER () AS r, doc_id, s, leaf, other, row_number() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY s) AS n FROM d),
 a0 AS (SELECT s, pos, n, leaf AS h FROM p), {", ".join(low)},
 subs AS (SELECT s AS name, h AS subroot, row_number() OVER (ORDER BY s) - 1 AS pos, count(*) OVER () AS n FROM a{levels}),
 u0 AS (SELECT 'root' AS s, pos, n, subroot AS h FROM subs), {", ".join(high)},
 nodes AS ({nodes}),
 trees AS (SELECT level, s FROM nodes WHERE n > 1 GROUP BY ALL),
 own AS (SELECT r, t.level, p.s, p.pos // CAST(pow(3, t.level) AS BIGINT) AS spot FROM p JOIN trees t ON t.s = p.s AND t.level < {levels}
   UNION ALL SELECT r, t.level, t.s, subs.pos // CAST(pow(3, t.level - {levels}) AS BIGINT) FROM p JOIN subs ON p.s = subs.name JOIN trees t ON t.level >= {levels}),
 sides AS (SELECT r, own.level, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos < spot), '') AS l, coalesce(string_agg(h, '' ORDER BY pos) FILTER (WHERE pos > spot), '') AS g
   FROM own LEFT JOIN nodes x ON x.level = own.level AND x.s = own.s AND x.pos // 3 = spot // 3 AND x.pos <> spot GROUP BY r, own.level),
 proofs AS (SELECT r, string_agg(l || g, '' ORDER BY level) AS proof, list(l || '|' || g ORDER BY level) AS steps FROM sides GROUP BY r),
 done AS (SELECT p.*, subroot, (SELECT h FROM u{upper}) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
   list_reduce(coalesce(steps, []), lambda node, x: sha256(split_part(x, '|', 1) || node || split_part(x, '|', 2)), other) AS folded_root FROM p JOIN subs ON p.s = subs.name LEFT JOIN proofs USING (r))
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM done"""


ORACLE_SQL = _oracle()
