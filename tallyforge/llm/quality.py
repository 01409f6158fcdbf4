"""Quality rules: a linear-chain conditional random field over the lines of a text.

Every line that has a word gets a vector of shares (symbols, capitals, digits,
marks, words that repeat, and so on). Viterbi decoding labels each line content
or boilerplate, over all documents of a batch at once. A document is kept if
the words of its content lines are at least ``CONTENT_SHARE`` of its words and
no base rule fails it.

Labels are given per document only, so those of its lines are latent. The fit
goes back and forth between them and the weights (hard EM): a line that several
different documents of the sample have, or that repeats within its document, is
boilerplate; the others take the label that the field finds likelier given
their neighbours, but for as many of the most likely ones as it takes that half
the words of a good document are content and half of a bad one's are not. So
emission weights and transitions are learned from documents that hold both.

The sample is bounded: at most ``TRAIN_DOCS`` labelled documents in the order
of a hash of their id, and of each at most ``TRAIN_LINES`` successive lines
from a place that a hash gives. Only feature vectors reach the driver.

Defined cases: null, empty and blank texts have no words and fail the base
rule; where no labelled document exists the fixed weights ``PRIOR`` decide;
rows that repeat an id are judged each; extra columns are passed on by
``filter_quality``; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import rolling
from .common import small_batches, table, utf8

TRAIN_DOCS = 2000
TRAIN_LINES = 256
COMMON = 3  # different documents of the sample that have a line of boilerplate
ROUNDS = (150, 60, 60)  # steps of the fit after each labelling of the lines
CONTENT_SHARE = 0.5
CHUNK = 1 << 21
FEATURES = ("one", "log_words", "symbols", "bars", "capitals", "digits", "marks", "repeated", "duplicate", "long_words", "stop_end", "other_bytes")
#: Content minus boilerplate, per feature, where no labelled document exists.
PRIOR = np.array([2.0, 0.2, -12.0, -12.0, -4.0, -3.0, -6.0, -3.0, -1.0, 0.0, 0.5, 0.0])
SYMBOLS = np.isin(np.arange(256), list(b"#*$%&|<>"))
CAPITAL = np.isin(np.arange(256), np.arange(65, 91))
SMALL = np.isin(np.arange(256), np.arange(97, 123))
DIGIT = np.isin(np.arange(256), np.arange(48, 58))
MARK = np.isin(np.arange(256), list(b"!?~^_=+@\\{}[]"))
FOLLOWS = (np.arange(256) & 0xC0) == 0x80
COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, content_share double"


def _sums(flags: np.ndarray, edges: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


class Lines:
    """Counts per document and feature vectors per line of some texts."""

    def __init__(self, texts: list[bytes]):
        buf, docs = rolling.joined(texts)
        n = len(texts)
        start, end = rolling.words_of(buf)
        doc_words = np.searchsorted(start, docs)
        self.n_words = np.diff(doc_words)
        word_doc = np.repeat(np.arange(n), self.n_words)
        inside = ~rolling.SEPARATORS[buf]
        self.word_chars = _sums(inside & ~FOLLOWS[buf], docs)
        symbol = SYMBOLS[buf]
        self.n_symbols = _sums(symbol, docs)
        repeats = self._repeated(rolling.Hashes(rolling.byte_values(buf))(start, end), word_doc)
        word_edges = np.zeros(len(start) + 1, np.int64)
        np.cumsum(repeats, out=word_edges[1:])
        self.n_repeat_words = word_edges[doc_words[1:]] - word_edges[doc_words[:-1]]
        # lines with a word, in order
        edges = np.concatenate([[0], np.flatnonzero(buf == 10) + 1])
        line_words = np.searchsorted(start, edges)
        has = np.flatnonzero(np.diff(line_words))
        first, last = edges[has], edges[has + 1]
        self.line_doc = np.searchsorted(docs, first, "right") - 1
        self.line_words = line_words[has + 1] - line_words[has]
        self.line_hash = rolling.Hashes(rolling.byte_values(buf, 3))(first, np.maximum(first, last - 1))
        duplicate = np.zeros(len(has), bool)
        whole, seen, now = buf.tobytes(), set(), -1
        for k, (d, a, z) in enumerate(zip(self.line_doc.tolist(), first.tolist(), last.tolist(), strict=True)):
            if d != now:
                seen, now = set(), d
            line = whole[a : z - 1]
            if line in seen:
                duplicate[k] = True
            else:
                seen.add(line)
        self.n_dup_lines = np.bincount(self.line_doc[duplicate], minlength=n)

        def share(flags: np.ndarray, of: np.ndarray) -> np.ndarray:
            total = np.zeros(len(flags) + 1, np.int32)
            np.cumsum(flags, out=total[1:])
            return (total[last] - total[first]) / of

        size = np.maximum(1, last - first)
        capital, words = CAPITAL[buf], self.line_words.astype(float)
        letters = np.maximum(1e-9, share(capital | SMALL[buf], 1))
        closing = buf[end[np.maximum(0, line_words[has + 1] - 1)] - 1] if len(has) else np.zeros(0, np.uint8)
        self.vectors = np.stack(
            [
                np.ones(len(has)), np.log1p(words) / 4, np.minimum(1, share(symbol, words) / 3), np.minimum(1, share(buf == 124, words) * 2),
                share(capital, letters), share(DIGIT[buf], size), np.minimum(1, share(MARK[buf], words)),
                (word_edges[line_words[has + 1]] - word_edges[line_words[has]]) / words, duplicate.astype(float),
                np.minimum(1, share(inside, words) / 16), np.isin(closing, list(b".!?:;")).astype(float), share(buf > 127, size),
            ],
            1,
        ) if len(has) else np.zeros((0, len(FEATURES)))
        self.counts = np.bincount(self.line_doc, minlength=n)

    @staticmethod
    def _repeated(word_hash: np.ndarray, word_doc: np.ndarray, n: int = 5) -> np.ndarray:
        """Marks the words in windows of n words that their document has twice or more."""
        mark = np.zeros(len(word_hash) + 1, np.int64)
        if len(word_hash) < n:
            return mark[:-1] > 0
        window = rolling.Hashes(word_hash).fixed(n) + rolling.mix(word_doc[: len(word_hash) - n + 1].astype(np.uint64) + np.uint64(1))
        whole = np.flatnonzero(word_doc[: len(window)] == word_doc[n - 1 :])
        order = whole[np.argsort(window[whole], kind="stable")]
        same = window[order[1:]] == window[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = order[twice]
        mark[at] += 1
        mark[at + n] -= 1
        return np.cumsum(mark)[:-1] > 0


class LineField:
    """The field: ``weights`` per feature and label, ``moves`` between labels (0 boilerplate, 1 content)."""

    def __init__(self, weights: np.ndarray, moves: np.ndarray):
        self.weights, self.moves = weights, moves

    @classmethod
    def prior(cls) -> LineField:
        return cls(np.stack([-PRIOR / 2, PRIOR / 2]), np.array([[0.4, -0.4], [-0.4, 0.4]]))

    @classmethod
    def fit(cls, documents: list[tuple[np.ndarray, np.ndarray | int]], rounds: int = 150, rate: float = 0.08, ridge: float = 1e-3, start: LineField | None = None) -> LineField:
        """By the conditional likelihood. documents: feature vectors of the lines, and the label of each or of all."""
        documents = sorted((d for d in documents if len(d[0])), key=lambda d: -len(d[0]))
        line_label = np.concatenate([np.zeros(0, np.int64), *(np.broadcast_to(y, len(x)) for x, y in documents)]).astype(np.int64)
        if len(set(line_label.tolist())) < 2:
            return cls.prior()
        # long documents would outweigh all others
        size = np.array([len(x) for x, _ in documents])
        rows = np.concatenate([x for x, _ in documents])
        place, end = np.cumsum(size) - size, np.cumsum(size) - 1
        line_weight = np.repeat(1.0 / size, size)
        params = [start.weights.copy(), start.moves.copy()] if start else [np.zeros((2, rows.shape[1])), np.zeros((2, 2))]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        pair = np.ones(len(rows), bool)
        pair[place] = False
        k = np.flatnonzero(pair)
        own = np.zeros((2, 2))
        np.add.at(own, (line_label[k - 1], line_label[k]), line_weight[k])
        wanted = np.eye(2)[line_label]
        for step in range(1, rounds + 1):
            field = cls(*params)
            emit, alpha, beta = field._passes(rows, size)
            total = np.logaddexp(alpha[end, 0], alpha[end, 1])
            near = np.exp(alpha + beta - np.repeat(total, size)[:, None])
            slope = ((wanted - near) * line_weight[:, None]).T @ rows / len(documents) - ridge * params[0]
            joint = alpha[k - 1][:, :, None] + params[1] + (emit[k] + beta[k])[:, None, :]
            joint = np.exp(joint - np.repeat(total, size)[k][:, None, None]) * line_weight[k][:, None, None]
            steep = (own - joint.sum(0)) / len(documents) - ridge * params[1]
            for p, g, m, v in zip(params, (slope, steep), first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        return cls(*params)

    @classmethod
    def fit_latent(cls, documents: list[tuple[np.ndarray, np.ndarray, np.ndarray, int]], rounds: tuple[int, ...] = ROUNDS) -> LineField:
        """documents: vectors, words and marks of weak boilerplate per line, and the document's label."""
        documents = sorted((d for d in documents if len(d[0])), key=lambda d: -len(d[0]))
        field = cls.prior()
        if len({d[3] for d in documents}) < 2:
            return field
        rows, size = np.concatenate([d[0] for d in documents]), np.array([len(d[0]) for d in documents])
        cuts = np.concatenate([[0], np.cumsum(size)])
        # first: the document's label, but for lines that are plainly of the other kind
        lean = np.clip((rows @ (field.weights[1] - field.weights[0])), -4, 4) + np.repeat([6.0 * d[3] - 3.0 for d in documents], size)
        for k in rounds:
            labels = [constrained(lean[a:z], words, weak, y) for (_, words, weak, y), a, z in zip(documents, cuts[:-1], cuts[1:], strict=True)]
            field = cls.fit([(d[0], x) for d, x in zip(documents, labels, strict=True)], k, start=None if k == rounds[0] else field)
            _, alpha, beta = field._passes(rows, size)
            lean = (alpha + beta) @ np.array([-1.0, 1.0])
        return field

    def _passes(self, rows: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Emissions and the forward and backward sums of documents, the longest first."""
        emit = rows @ self.weights.T
        alpha, beta = np.empty((len(rows), 2)), np.zeros((len(rows), 2))
        place, width = np.cumsum(size) - size, int(size[0])
        alpha[place] = emit[place]
        alive = np.searchsorted(-size, -np.arange(1, width + 1), "right")
        for t in range(1, width):
            k = place[: alive[t]] + t
            alpha[k] = emit[k] + np.logaddexp(alpha[k - 1, :1] + self.moves[0], alpha[k - 1, 1:] + self.moves[1])
        for t in range(width - 1, 0, -1):
            k = place[: alive[t]] + t
            ahead = emit[k] + beta[k]
            beta[k - 1] = np.logaddexp(self.moves[:, 0] + ahead[:, :1], self.moves[:, 1] + ahead[:, 1:])
        return emit, alpha, beta

    def decode(self, vectors: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The most likely labels of the lines; ``counts`` lines per document."""
        emit = vectors @ self.weights.T
        order = np.argsort(-counts, kind="stable")
        size = counts[order]
        place = (np.cumsum(counts) - counts)[order]
        best, back = emit.copy(), np.zeros(emit.shape, np.int8)
        label = np.zeros(len(emit), np.int8)
        width = int(size[0]) if len(size) else 0
        alive = np.searchsorted(-size, -np.arange(1, width + 1), "right")
        for t in range(1, width):
            k = place[: alive[t]] + t
            stay, come = best[k - 1, :1] + self.moves[0], best[k - 1, 1:] + self.moves[1]
            back[k] = come > stay
            best[k] += np.maximum(stay, come)
        some = size > 0
        end = place[some] + size[some] - 1
        label[end] = best[end, 1] >= best[end, 0]
        for t in range(width - 1, 0, -1):
            k = place[: alive[t]] + t
            label[k - 1] = back[k, label[k]]
        return label


def constrained(lean: np.ndarray, words: np.ndarray, weak: np.ndarray, label: int) -> np.ndarray:
    """Labels of a document's lines: by ``lean`` (over 0: content), weak boilerplate first, and half the words as the document's label."""
    if 2 * words[weak].sum() > words.sum():
        weak = np.zeros(len(weak), bool)  # a copy of other documents rather than lines that many share
    lean = np.where(weak, -np.inf, lean)
    out = lean > 0
    order = np.argsort(-lean if label else lean, kind="stable")
    need = np.searchsorted(2 * np.cumsum(words[order]), words.sum()) + 1
    out[order[:need]] = bool(label)
    return out.astype(np.int64)


def common_lines(hashes: list[np.ndarray]) -> list[np.ndarray]:
    """Marks the lines that ``COMMON`` different documents have; copies of a document are one."""
    distinct = {x.tobytes(): np.unique(x) for x in hashes}
    lines, many = np.unique(np.concatenate([np.zeros(0, np.uint64), *distinct.values()]), return_counts=True)
    known = lines[many >= COMMON]
    return [np.isin(x, known) for x in hashes]


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = utf8(b.column("text"))
        for at, to in rolling.chunks([len(x) for x in texts], CHUNK):
            lines = Lines(texts[at:to])
            cuts = np.concatenate([[0], np.cumsum(lines.counts)])
            out = []
            for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if z - a > TRAIN_LINES:
                    a += int(lines.line_hash[a] % np.uint64(z - a - TRAIN_LINES + 1))
                    z = a + TRAIN_LINES
                out.append((lines.vectors[a:z].astype("<f4").tobytes(), lines.line_words[a:z].astype("<i8").tobytes(), lines.line_hash[a:z].tobytes()))
            columns = [pa.array(c, pa.binary()) for c in zip(*out, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, b.column("quality").slice(at, to - at)], names=["lines", "words", "hashes", "quality"])


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS) -> LineField:
    """Fit the field on at most ``most`` labelled documents; only feature vectors travel to the driver."""
    spark = docs.sparkSession
    small_batches(spark)
    chosen = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("__label_id")).agg(F.max("quality").cast("int").alias("quality"))
    chosen = chosen.orderBy(F.xxhash64("__label_id")).limit(most)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("__label_id"))
    # of rows that share an id one is taken, so no more rows than labels come to the driver
    sample = sample.groupBy("__label_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "quality")).alias("one")).select("one.text", "one.quality")
    rows = sample.select("text", "quality").mapInArrow(_features, "lines binary, words binary, hashes binary, quality int").collect()
    rows = sorted((bytes(r.hashes), bytes(r.lines), bytes(r.words), int(r.quality > 0)) for r in rows)  # the fit doesn't hang on the order of rows
    hashes = [np.frombuffer(h, np.uint64) for h, _, _, _ in rows]
    again = FEATURES.index("duplicate")
    found = []
    for common, (_, x, words, y) in zip(common_lines(hashes), rows, strict=True):
        vectors = np.frombuffer(x, "<f4").reshape(-1, len(FEATURES)).astype(float)
        found.append((vectors, np.frombuffer(words, "<i8"), common | (vectors[:, again] > 0), y))
    return LineField.fit_latent(found)


def judge(texts: list[bytes], field: LineField) -> dict[str, np.ndarray]:
    lines = Lines(texts)
    label = field.decode(lines.vectors, lines.counts)
    n = len(texts)
    content = np.bincount(lines.line_doc, weights=lines.line_words * label, minlength=n)
    share = content / np.maximum(1, lines.n_words)
    failed = (lines.n_words < 10) | (100 * lines.n_repeat_words > 20 * lines.n_words)
    return {
        "n_words": lines.n_words, "word_chars": lines.word_chars, "n_symbols": lines.n_symbols, "n_dup_lines": lines.n_dup_lines,
        "n_repeat_words": lines.n_repeat_words, "base_failed": failed, "kept": ~failed & (share >= CONTENT_SHARE), "content_share": share,
    }


def _judged(field: LineField, verdict_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = utf8(b.column("text"))
            for at, to in rolling.chunks([len(x) for x in texts], CHUNK):
                got, part = judge(texts[at:to], field), b.slice(at, to - at)
                if verdict_only:
                    yield part.filter(pa.array(got["kept"]))
                else:
                    yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(v) for v in got.values())], names=["doc_id", *got])

    return run


def score(docs: DataFrame, field: LineField) -> DataFrame:
    """doc_id with the counts of the base rules, the verdict and the content share."""
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_judged(field, False), f"doc_id long, {COLUMNS}")


def filter_quality(docs: DataFrame, field: LineField) -> DataFrame:
    """The rows of ``docs`` that are kept, all columns as they are."""
    small_batches(docs.sparkSession)
    return docs.mapInArrow(_judged(field, True), docs.schema)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))
