"""SentencePiece encoding and decoding with sampled segmentations.

A text's lattice has all ways to write it in pieces of the vocabulary; what no
piece covers is written in byte pieces. The model file gives merge ranks, from
which a unigram distribution over pieces follows by the Zipf-Mandelbrot law,
p(rank) proportional to 1 / (rank + SHIFT). Backward sums over the lattice make
every step's choice a conditional probability.

Segmentations are drawn without replacement by Gumbel top-k: each has its log
probability plus a Gumbel noise, and the k largest are wanted. A* search finds
them exactly without listing the lattice: a region (the segmentations that agree
up to a step and differ there) has the log of its mass as location of its own
largest value, truncated at that of the region it came from. The regions that
branch off one sample are held together: their joint mass gives their largest
value, their shares the region that has it. The region with the largest value
is taken next; its sample is drawn step by step, and the rest of the region is
divided by where segmentations leave the sample. The largest
value left after k samples is the threshold of the inclusion scores
1 - exp(-exp(log p - threshold)).

All noise is a hash of the row's key, the sample's rank and the place, so a row
has the same samples wherever it is computed. Lattices are built for distinct
words only, over arrays: a text is cut before spaces and between letters and
other characters, so its lattice is a chain of small ones. The pieces of several
spaces and the few that mix letters with other characters (such as a raised two
and a full stop) lie across cuts and aren't used; every text can be written
without them.

Defined cases: null and empty text have one segmentation, without pieces; a null
id is keyed by the text; rows that repeat id and text get equal samples; texts
with fewer than k segmentations give all they have, with inclusion score 1; an
empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import rolling
from .common import small_batches, table

SHIFT = 50.0
SAMPLES = 2
SEED = 11
CHUNK = 1 << 20  # bytes of text whose lattices are held at once
SLOT_BITS = 18
FINE = 2.0**32  # log probabilities are summed in this fraction
MARKS = ".,;:!?*$%&#|"
LETTERS = "^[A-Za-zÀ-ÖØ-öø-ɏ]+$"
LAST_MARKS = "(?s)(?P<marks>[.,;:!?*$%&#|]*)$"
UNITS = re.compile(r"[^\W\d_]+|[\W\d_]+")
IDS = "doc_id long, sample int, ids array<int>, log_prob double, perturbed double, inclusion double"
DIGEST = "doc_id long, sample int, n_pieces long, ids_crc32 long, log_prob double, perturbed double, inclusion double, round_trip boolean"


def _values(text: str) -> np.ndarray:
    return rolling.mix(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(1))


class Vocabulary:
    """Pieces of a model file, with their log probabilities and a hash table of them."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.size = n = model.vocab_size()
        names = [model.id_to_piece(i) for i in range(n)]
        rank = np.array([-model.get_score(i) for i in range(n)])
        rank[(rank > n) | (rank < 0)] = n
        special = np.array([model.is_control(i) or model.is_unknown(i) or model.is_unused(i) for i in range(n)])
        byte = np.array([model.is_byte(i) for i in range(n)])
        rank[byte] = n
        weight = np.where(special, 0.0, 1 / (rank + SHIFT))
        with np.errstate(divide="ignore"):
            self.log_prob = np.log(weight / weight.sum())
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.byte_log_prob = float(self.log_prob[self.byte_ids[0]])
        plain = [p.replace("▁", " ") for p in names]
        usable = [i for i in range(n) if not special[i] and not byte[i] and " " not in plain[i][1:] and plain[i]]
        self.longest = max(len(plain[i]) for i in usable)
        text = "".join(plain[i] for i in usable)
        ends = np.cumsum([len(plain[i]) for i in usable])
        starts = np.concatenate([[0], ends[:-1]])
        hashes = rolling.Hashes(_values(text))(starts, ends)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(usable, np.int32)[order]
        slot = (self.hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        self.slots = np.searchsorted(slot, np.arange((1 << SLOT_BITS) + 1)).astype(np.int32)
        self.fullest = int(np.diff(self.slots).max())
        raw = [bytes([int(p[3:5], 16)]) if byte[i] else b"" if special[i] else plain[i].encode() for i, p in enumerate(names)]
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_size = np.array([len(x) for x in raw], np.int32)
        self.raw_start = (np.cumsum(self.raw_size) - self.raw_size).astype(np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        """Ids of pieces by hash, -1 where there is none."""
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, end = self.slots[slot], self.slots[slot + 1]
        out = np.full(len(h), -1, np.int32)
        left = np.flatnonzero(at < end)
        for _ in range(self.fullest):
            k = at[left]
            hit = self.hashes[k] == h[left]
            out[left[hit]] = self.ids[k[hit]]
            at[left] += 1
            left = left[~hit]
            left = left[at[left] < end[left]]
            if not len(left):
                break
        return out

    def decode_many(self, ids: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of id sequences, each with a space before it, and where each begins, with the end."""
        size = self.raw_size[ids]
        take = _ragged(self.raw_start[ids], size)
        return self.raw[take], np.concatenate([[0], np.cumsum(size, dtype=np.int64)])[cuts]

    def decode(self, ids) -> str:
        """The text of a sequence of ids."""
        flat, _ = self.decode_many(np.asarray(ids, np.int64), np.array([0, len(ids)]))
        return flat.tobytes()[1:].decode("utf-8", "surrogatepass")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


class Lattices:
    """Lattices of distinct units, as arrays of nodes and of edges in the order of their nodes."""

    def __init__(self, voc: Vocabulary, units: list[str], best: bool = False):
        text = "".join(units)
        size = np.array(list(map(len, units)), np.int64)
        end = np.cumsum(size)
        unit = np.repeat(np.arange(len(units), dtype=np.int32), size)
        left = (end[unit] - np.arange(len(unit))).astype(np.int32)
        self.start = (end - size + np.arange(len(units))).astype(np.int32)  # a unit's first node; its last one is its end
        at, length, piece = self._edges(voc, text, left)
        self.piece = piece
        self.target = at + unit[at]
        self.node = self.target.copy()
        self.target += length
        is_byte = np.flatnonzero(piece >= voc.size)
        weight = voc.log_prob.take(piece, mode="clip")
        code = piece[is_byte] - voc.size
        self.n_bytes = np.ones(len(piece), np.int8)
        self.n_bytes[is_byte] = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        weight[is_byte] = voc.byte_log_prob * self.n_bytes[is_byte]
        nodes = len(unit) + len(units)
        beta = np.zeros(nodes)
        self.first, self.count = np.zeros(nodes, np.int32), np.zeros(nodes, np.int32)
        lead = np.flatnonzero(np.diff(self.node, prepend=-1)).astype(np.int32)
        many = np.diff(np.append(lead, len(at))).astype(np.int32)
        self.first[self.node[lead]], self.count[self.node[lead]] = lead, many
        level = left[at[lead]]
        del at, length, unit, left
        steps = np.searchsorted(level, np.arange(1, (int(level[-1]) if len(level) else 0) + 2))
        for a, z in zip(steps[:-1], steps[1:], strict=True):
            if a == z:
                continue
            lo, hi = lead[a], lead[z] if z < len(lead) else len(weight)
            value = weight[lo:hi] + beta[self.target[lo:hi]]
            cut = lead[a:z] - lo
            total = np.maximum.reduceat(value, cut)
            spread = np.repeat(total, many[a:z])
            if not best:
                total = total + np.log(np.add.reduceat(np.exp(value - spread), cut))
                spread = np.repeat(total, many[a:z])
            beta[self.node[lead[a:z]]] = total
            weight[lo:hi] = value - spread
        self.log_q = weight
        if best:  # the first of the best edges of each node is certain
            self.log_q = np.where(weight == 0, 0.0, -np.inf)
        # sums of whole numbers, so that they don't hang on what else is in the batch
        q = np.round(np.exp(self.log_q) * 2.0**52).astype(np.uint64)
        total = np.cumsum(q)
        total -= np.repeat((total - q)[lead], many)
        self.upto = total * 2.0**-52
        if len(lead):
            self.upto[np.append(lead[1:], len(q)) - 1] = np.inf

    @staticmethod
    def _edges(voc: Vocabulary, text: str, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position, length, piece) of all edges, by what is left of the unit, then position, longer pieces first."""
        hashes = rolling.Hashes(_values(text))
        at, length, piece = [], [], []
        for n in range(min(voc.longest, int(left.max()) if len(left) else 0), 0, -1):
            pos = np.flatnonzero(left >= n).astype(np.int32)
            ids = voc.find(hashes(pos, pos + n))
            if n == 1:  # characters without a piece of their own are written in bytes
                bare = np.flatnonzero(ids < 0)
                codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<i4")
                ids[bare] = voc.size + codes[pos[bare]]
            hit = np.flatnonzero(ids >= 0)
            at.append(pos[hit])
            length.append(np.full(len(hit), n, np.int8))
            piece.append(ids[hit])
        if not at:
            return np.zeros(0, np.int32), np.zeros(0, np.int8), np.zeros(0, np.int32)
        at, length, piece = np.concatenate(at), np.concatenate(length), np.concatenate(piece)
        order = np.argsort((left[at].astype(np.int64) << 40) | (at.astype(np.int64) << 5) | (31 - length))
        return at[order], length[order], piece[order]

    def walk(self, start: np.ndarray, seed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Draw an edge path from each node to its unit's end: (edges in the order of items, number per item)."""
        node, live = start.copy(), np.flatnonzero(self.count[start] > 0)
        count, steps = np.zeros(len(start), np.int64), []
        while len(live):
            u = uniform(seed[live], len(steps))
            e = self.first[node[live]]
            on = np.flatnonzero(self.upto[e] <= u)
            while len(on):
                e[on] += 1
                on = on[self.upto[e[on]] <= u[on]]
            steps.append((live, e))
            count[live] += 1
            to = self.target[e]
            node[live] = to
            live = live[self.count[to] > 0]
        begin = np.cumsum(count) - count
        out = np.empty(int(count.sum()), np.int32)
        for k, (items, e) in enumerate(steps):
            out[begin[items] + k] = e
        return out, count


def uniform(seed: np.ndarray, salt) -> np.ndarray:
    """Numbers in (0, 1) by hash."""
    h = rolling.mix(seed + np.uint64(0x9E3779B97F4A7C15) * np.asarray(salt, np.uint64) + np.uint64(1))
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gumbel(seed: np.ndarray, salt) -> np.ndarray:
    return -np.log(-np.log(uniform(seed, salt)))


def truncated(location: np.ndarray, noise: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """The largest value of a region, given that it stays under ``bound``."""
    return -np.logaddexp(-bound, -(location + noise))


def _ragged(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... size[0] of them, then start[1] and so on."""
    end = np.cumsum(size, dtype=np.int64)
    total = int(end[-1]) if len(end) else 0
    kind = np.int32 if total < 2**31 else np.int64
    out = np.repeat((start - end + size).astype(kind), size)
    out += np.arange(total, dtype=kind)
    return out


class Corpus:
    """Texts as chains of units, and the lattices of the distinct ones."""

    def __init__(self, voc: Vocabulary, texts: list[str], best: bool = False):
        self.voc, self.texts = voc, texts
        lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        words = lists.values.dictionary_encode()
        # most words are letters and marks after them: two links at most, found over arrays
        core = pc.utf8_rtrim(words.dictionary, MARKS)
        plain = pc.match_substring_regex(core, LETTERS)
        core = pc.if_else(plain, core, "").dictionary_encode()
        tail = pc.if_else(plain, pc.struct_field(pc.extract_regex(words.dictionary, LAST_MARKS), 0), "").dictionary_encode()
        chain = [" " + c for c in core.dictionary.to_pylist()]
        first_tail = len(chain)
        marks = tail.dictionary.to_pylist()
        chain += [m or " " for m in marks]
        plain = plain.to_numpy(zero_copy_only=False)
        last = tail.indices.to_numpy()
        marked = np.array([bool(m) for m in marks], bool)[last] if marks else np.zeros(0, bool)
        many = 1 + marked.astype(np.int64)
        odd = np.flatnonzero(~plain)
        known: dict[str, int] = {}
        links = []
        for w in words.dictionary.take(pa.array(odd)).to_pylist():
            parts = UNITS.findall(w) or [""]
            parts[0] = " " + parts[0]
            links.append([known.setdefault(u, len(known)) for u in parts])
        many[odd] = [len(x) for x in links]
        cuts = np.concatenate([[0], np.cumsum(many)])
        flat = np.empty(cuts[-1], np.int32)
        flat[cuts[:-1]] = core.indices.to_numpy()
        flat[cuts[:-1][marked] + 1] = first_tail + last[marked]
        if len(odd):
            flat[_ragged(cuts[:-1][odd], many[odd])] = [len(chain) + u for x in links for u in x]
        chain += known
        index = words.indices.to_numpy()
        size = np.diff(cuts)[index]
        units = flat[_ragged(cuts[:-1][index], size)]
        offsets = lists.offsets.to_numpy()
        place = np.concatenate([[0], np.cumsum(size)])[offsets]
        empty = np.array([not t for t in texts], bool)
        if empty.any():  # split gives one empty word for an empty text
            keep = np.ones(len(units), bool)
            keep[place[:-1][empty]] = False
            units = units[keep]
            place = place - np.concatenate([[0], np.cumsum(empty)])
        self.units, self.place = units, place
        self.lattices = Lattices(voc, chain, best)
        self.node = self.lattices.start[units]

    def ids(self, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a path of edges; and how many each edge gives."""
        piece, many = self.lattices.piece[edges], self.lattices.n_bytes[edges].astype(np.int64)
        byte = np.flatnonzero(piece >= self.voc.size)
        if not len(byte):
            return piece, many
        end = np.cumsum(many)
        out = np.repeat(np.where(piece >= self.voc.size, 0, piece), many)
        raw = "".join(map(chr, (piece[byte] - self.voc.size).tolist())).encode("utf-8", "surrogatepass")
        out[_ragged((end - many)[byte], many[byte])] = self.voc.byte_ids[np.frombuffer(raw, np.uint8)]
        return out, many


class Path:
    """One sample per document: its edges, the units they belong to, and the regions that branch off.

    ``location`` is the log mass of the region at each edge, -inf once it is
    taken; ``start_at`` is where the path left its own region's other samples;
    ``value`` is the largest value of all its open regions, per document.
    """

    def __init__(self, edges: np.ndarray, unit: np.ndarray, cuts: np.ndarray, start_at: np.ndarray | None = None):
        self.edges, self.unit, self.cuts = edges, unit, cuts
        self.start_at = np.full(len(cuts) - 1, -1, np.int64) if start_at is None else start_at
        self.doc = np.repeat(np.arange(len(cuts) - 1, dtype=np.int32), np.diff(cuts))
        self.location = self.value = np.zeros(0)

    def masses(self) -> tuple[np.ndarray, np.ndarray]:
        """The log mass of the open regions per document, and each region's share in whole numbers."""
        n, some = len(self.cuts) - 1, np.flatnonzero(np.diff(self.cuts))
        top, total = np.full(n, -np.inf), np.zeros(n, np.uint64)
        if len(some):
            top[some] = np.maximum.reduceat(self.location, self.cuts[some])
        safe = np.where(np.isfinite(top), top, 0.0)
        share = np.round(np.exp(self.location - safe[self.doc]) * 2.0**40).astype(np.uint64)
        if len(some):
            total[some] = np.add.reduceat(share, self.cuts[some])
        with np.errstate(divide="ignore"):
            return top + np.log(total * 2.0**-40), share

    def offer(self, bound: np.ndarray, noise: np.ndarray) -> None:
        """Draw the largest value of the open regions, under ``bound``."""
        log_mass, self.share = self.masses()
        self.value = np.where(np.isfinite(log_mass), truncated(np.where(np.isfinite(log_mass), log_mass, 0.0), noise, bound), -np.inf)

    def choose(self, docs: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The region that has the largest value, for each of some documents, by its share; it is taken."""
        upto = np.cumsum(self.share)
        before = np.where(self.cuts[docs] > 0, upto[np.maximum(self.cuts[docs], 1) - 1], np.uint64(0))
        whole = upto[self.cuts[docs + 1] - 1] - before
        at = np.searchsorted(upto, before + np.minimum((u * whole).astype(np.uint64), whole - np.uint64(1)), "right")
        self.location[at] = -np.inf
        return at


def sample(corpus: Corpus, seeds: np.ndarray, k: int) -> list[list[tuple[int, np.ndarray, float, float, float]]]:
    """Per document up to k samples (rank, ids, log probability, perturbed, inclusion), largest first."""
    lat, n = corpus.lattices, len(seeds)
    place, units = corpus.place, np.diff(corpus.place)
    unit_seed = rolling.mix(np.repeat(seeds, units) ^ rolling.mix(_ragged(np.zeros(n, np.int64), units).astype(np.uint64)))
    edges, count = lat.walk(corpus.node, unit_seed)
    paths = [Path(edges, np.repeat(np.arange(len(corpus.node), dtype=np.int32), count), np.concatenate([[0], np.cumsum(count)])[place])]
    value = gumbel(seeds, 1 << 40)  # the lattice's whole mass is 1
    live = np.ones(n, bool)
    out: list[list] = [[] for _ in range(n)]
    rest_at, rest = paths[0].cuts[:-1], np.full(n, np.nan)  # where the newest path left its region, and the mass left there
    barred: dict[tuple[int, int], list[int]] = {}
    for r in range(k):
        path = paths[r]
        lq = lat.log_q[path.edges]
        run = np.concatenate([[0], np.cumsum(np.round(lq * FINE).astype(np.int64))])
        begin = run[path.cuts[:-1]]
        log_prob = (run[path.cuts[1:]] - begin) / FINE
        with np.errstate(divide="ignore"):
            path.location = np.log(-np.expm1(lq))
            mended = np.flatnonzero(~np.isnan(rest))
            path.location[rest_at[mended]] = np.log(rest[mended])
        path.location += (run[:-1] - begin[path.doc]) / FINE
        path.location[np.arange(len(lq)) < rest_at[path.doc]] = -np.inf
        path.offer(value, gumbel(seeds, (1 << 42) + r))
        ids, size = corpus.ids(path.edges)
        id_cuts = np.concatenate([[0], np.cumsum(size)])[path.cuts]
        for d in np.flatnonzero(live).tolist():
            out[d].append([r + 1, ids[id_cuts[d] : id_cuts[d + 1]], float(log_prob[d]), float(value[d])])
        # the region with the largest value is searched next
        tops = np.stack([p.value for p in paths])
        value, origin = tops.max(0), tops.argmax(0)
        live = np.isfinite(value)
        if r + 1 == k or not live.any():
            break
        turn, at_unit = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        choice = uniform(seeds, (1 << 41) + 2 * r), uniform(seeds, (1 << 41) + 2 * r + 1)
        for j, p in enumerate(paths):
            mine = np.flatnonzero(live & (origin == j))
            if len(mine):
                turn[mine] = p.choose(mine, choice[0][mine])
                at_unit[mine] = p.unit[turn[mine]]
                bound = p.value.copy()
                p.offer(np.where(np.isfinite(bound), bound, 0.0), gumbel(seeds, (1 << 43) + r * k + j))
                keep = np.ones(n, bool)
                keep[mine] = False
                p.value[keep] = bound[keep]
        chosen = np.flatnonzero(live)
        other, rest = np.zeros(n, np.int64), np.full(n, np.nan)
        for d in chosen.tolist():
            p = paths[origin[d]]
            own = int(p.edges[turn[d]])
            bar = [*barred.get((int(origin[d]), d), []), own] if turn[d] == p.start_at[d] else [own]
            node = lat.node[own]
            free = [e for e in range(lat.first[node], lat.first[node] + lat.count[node]) if e not in bar]
            q = np.exp(lat.log_q[free])
            pick = min(int(np.searchsorted(np.cumsum(q), choice[1][d] * q.sum(), "right")), len(free) - 1)
            other[d] = free[pick]
            rest[d] = float(np.delete(q, pick).sum())
            barred[(r + 1, d)] = bar
        # the rest of each sample: from the other edge to its unit's end, then all later units
        later = np.where(live, place[1:] - at_unit, 0)
        item_unit = _ragged(np.where(live, at_unit, 0), later)
        start = corpus.node[item_unit]
        start[(np.cumsum(later) - later)[chosen]] = lat.target[other[chosen]]
        more, count = lat.walk(start, rolling.mix(unit_seed[item_unit] ^ np.uint64(1000003 * (r + 1))))
        more_unit = np.repeat(item_unit, count)
        more_cuts = np.concatenate([[0], np.cumsum(count)])[np.concatenate([[0], np.cumsum(later)])]
        parts, owners, cuts, rest_at = [more[:0]], [more_unit[:0]], [0], np.zeros(n, np.int64)
        for d in range(n):
            if live[d]:
                p = paths[origin[d]]
                a, t = p.cuts[d], turn[d]
                rest_at[d] = cuts[-1] + t - a
                parts += [p.edges[a:t], other[d : d + 1], more[more_cuts[d] : more_cuts[d + 1]]]
                owners += [p.unit[a:t], at_unit[d : d + 1], more_unit[more_cuts[d] : more_cuts[d + 1]]]
                cuts.append(cuts[-1] + t - a + 1 + more_cuts[d + 1] - more_cuts[d])
            else:
                cuts.append(cuts[-1])
        paths.append(Path(np.concatenate(parts).astype(np.int32), np.concatenate(owners).astype(np.int32), np.array(cuts), rest_at))
    for d, found in enumerate(out):
        for s in found:
            s.append(float(-np.expm1(-np.exp(s[2] - value[d]))) if np.isfinite(value[d]) else 1.0)
    return out


def row_seeds(ids: pa.Array, texts: list[str], seed: int) -> np.ndarray:
    own = np.array([zlib.crc32(t.encode("utf-8", "surrogatepass")) if i is None else i & (2**64 - 1) for i, t in zip(ids.to_pylist(), texts, strict=True)], np.uint64)
    return rolling.mix(own ^ np.uint64((seed * 0x9E3779B97F4A7C15) & rolling.MASK))


def _sampled(path: str, k: int, seed: int, digest: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = vocabulary(path)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for at, to in rolling.chunks([len(t) for t in texts], CHUNK):
                part, ids = texts[at:to], b.column("doc_id").slice(at, to - at)
                found = sample(Corpus(voc, part), row_seeds(ids, part, seed), k)
                rows = [(i, s, t) for i, f, t in zip(ids.to_pylist(), found, part, strict=True) for s in f]
                head = [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1][0] for r in rows], pa.int32())]
                tail = [pa.array([r[1][c] for r in rows], pa.float64()) for c in (2, 3, 4)]
                if not digest:
                    size = np.array([len(r[1][1]) for r in rows], np.int64)
                    flat = np.concatenate([np.zeros(0, np.int32), *(r[1][1] for r in rows)]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([*head, lists, *tail], names=["doc_id", "sample", "ids", "log_prob", "perturbed", "inclusion"])
                    continue
                flat = np.concatenate([np.zeros(0, np.int32), *(r[1][1] for r in rows)])
                cuts = np.concatenate([[0], np.cumsum([len(r[1][1]) for r in rows])]).astype(np.int64)
                raw, edges = voc.decode_many(flat, cuts)
                raw, edges = raw.tobytes(), edges.tolist()
                same = [raw[a + 1 : z] == r[2].encode("utf-8", "surrogatepass") if z > a else not r[2] for a, z, r in zip(edges[:-1], edges[1:], rows, strict=True)]
                crc = [zlib.crc32(r[1][1].astype("<u4")) for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [*head, pa.array(np.diff(cuts)), pa.array(crc, pa.int64()), *tail, pa.array(same, pa.bool_())],
                    names=["doc_id", "sample", "n_pieces", "ids_crc32", "log_prob", "perturbed", "inclusion", "round_trip"],
                )

    return run


def sample_pieces(docs: DataFrame, path: str, k: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """Up to k distinct sampled segmentations per row: doc_id, sample, ids, log_prob, perturbed, inclusion."""
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_sampled(path, k, seed, False), IDS)


def sample_digests(docs: DataFrame, path: str, k: int = SAMPLES, seed: int = SEED) -> DataFrame:
    """The same, with a checksum of the ids and whether decoding them gives the text."""
    small_batches(docs.sparkSession)
    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(_sampled(path, k, seed, True), DIGEST)


def encode_best(voc: Vocabulary, texts: list[str]) -> list[np.ndarray]:
    """The most probable segmentation of each text (Viterbi)."""
    corpus = Corpus(voc, texts, best=True)
    edges, count = corpus.lattices.walk(corpus.node, np.zeros(len(corpus.node), np.uint64))
    ids, size = corpus.ids(edges)
    cuts = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(count)])[corpus.place]]
    return [ids[a:z] for a, z in zip(cuts[:-1], cuts[1:], strict=True)]


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sample_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
