"""Lossless WebP for many images at once: each image is a lane of array arithmetic.

``encode`` takes payloads of whole rows. A row is ``ROW`` bytes, three to a
pixel; rows beyond ``FRAME`` go to further frames of an animated file, so that
texts of any length decode side by side and need bounded memory. Per frame the
encoder compares by their entropies the plain pixels with a palette, with the
subtracted green, with a cross-colour transform and with three predictors, and
takes what is smallest, its header included. What repeats becomes back
references, where three pixels or more occur earlier in the frame; pixels that
the colour cache holds become its codes, where enough do. Prefix codes follow
the frame's counts: Shannon lengths, shortened until the code is complete.

``decode`` reads any lossless file. Container, transforms and their small
images go by ``webp``, one file at a time. The main images are read in lanes:
every step reads one symbol of each image that isn't finished: a literal, a
copy or a cached colour. Images with meta prefix codes are read one by one.
"""

from __future__ import annotations

import struct
from collections import Counter

import numpy as np

from . import rolling, webp

ROW = webp.ROW
WIDTH = ROW // 3
FRAME = 32  # rows of one frame
CHUNK = 8 << 20  # bytes of pixels that are decoded side by side
SOME = 1 << 19  # and encoded: arrays that stay in the processor's cache
CACHE_BITS = 8
CACHE_LEAST = 24  # pixels that the cache must hold
MODES = (1, 2, 11)  # predictors that are tried
GREEN, LENGTHS, DISTANCES = 256, 24, 40
MULTIPLIER = np.uint64(webp.CACHE_MULTIPLIER)
#: The code in which code lengths are written: bits of each of its 19 symbols. It is complete.
LENGTH_CODE = np.array([3, 7, 7, 7, 4, 3, 3, 3, 3, 3, 4, 7, 7, 7, 7, 7, 0, 5, 5])
FAST = 10  # bits looked up at once
WORD = np.uint64(0xFFFFFFFF)
TURNED = {n: np.array([int(f"{k:0{n}b}"[::-1], 2) for k in range(1 << n)], np.uint16) for n in (7, FAST, 15)}


class Items:
    """Bit fields of frames, in order within each frame."""

    def __init__(self, frames: int):
        self.frames, self.sections = frames, []

    def add(self, frame: np.ndarray, value: np.ndarray, bits: np.ndarray) -> None:
        """A section: ``frame`` ascends; up to 56 bits each."""
        self.sections.append((frame, value.astype(np.uint64), bits.astype(np.int64)))

    def packed(self) -> list[bytes]:
        """The bytes of each frame."""
        sizes = [np.bincount(f, b, self.frames).astype(np.int64) for f, _, b in self.sections]
        total = np.sum(sizes, axis=0)
        width = (total + 7) >> 3
        first = np.cumsum(width) - width
        out = np.zeros(int(width.sum()) // 4 + 4, np.uint32)
        at = first * 8
        for (frame, value, bits), size in zip(self.sections, sizes, strict=True):
            ends = np.cumsum(bits)
            before = ends - bits
            begin = np.cumsum(size) - size
            place = at[frame] + before - begin[frame]
            if len(place):  # a field lies in three words at most; fields share words, but no bits
                shift = (place & 31).astype(np.uint64)
                word = (place >> 5) - int(place[0] >> 5)
                low, high = (value & WORD) << shift, (value >> np.uint64(32)) << shift
                for k, part in enumerate((low & WORD, (low >> np.uint64(32)) + (high & WORD), high >> np.uint64(32))):
                    if part.any():
                        some = np.bincount(word, part.astype(float)).astype(np.uint32)
                        a = int(place[0] >> 5) + k
                        out[a : a + len(some)] += some
            at = at + size
        whole = out.astype("<u4").tobytes()
        return [whole[a : a + n] for a, n in zip(first.tolist(), width.tolist(), strict=True)]


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths (frames, symbols) of complete codes for the counts; 0 where a symbol doesn't occur.

    Shannon's lengths leave room in the code; it goes, level by level, to symbols
    that become one bit shorter, until nothing is left. Frequent symbols get the
    short ones. A frame with a single symbol has length 1 there. Counts sum to 2^15 at most, so no length passes 15.
    """
    frames, symbols = counts.shape
    total, used = counts.sum(1), (counts > 0).sum(1)
    row, column = np.nonzero(counts)
    c = counts[row, column]
    need = np.maximum(1, np.ceil(np.log2(total[row] / c) - 1e-9).astype(np.int64))
    levels = np.bincount(row * 16 + need, minlength=frames * 16).reshape(frames, 16)
    room = (1 << 15) - (levels * (1 << (15 - np.arange(16)))).sum(1)
    room[used < 2] = 0
    while room.any():
        for n in range(2, 16):
            k = np.minimum(levels[:, n], room >> (15 - n))
            levels[:, n] -= k
            levels[:, n - 1] += k
            room -= k << (15 - n)
    order = np.lexsort((column, -c, row))
    out = np.zeros((frames, symbols), np.int64)
    out[row[order], column[order]] = np.repeat(np.tile(np.arange(16), frames), levels.ravel())
    return out


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes, as they are written: the first bit lowest."""
    row, column = np.nonzero(lengths)
    n = lengths[row, column]
    order = np.lexsort((column, n, row))
    row, column, n = row[order], column[order], n[order]
    share = 1 << (15 - n)
    before = np.cumsum(share) - share
    first = np.flatnonzero(np.diff(row, prepend=-1))
    left = before - np.repeat(before[first], np.diff(np.append(first, len(row))))
    out = np.zeros(lengths.shape, np.int64)
    out[row, column] = TURNED[15][left]
    return out


LENGTH_CODES = codes_of(LENGTH_CODE[None, :])[0]


def put_codes(items: Items, lengths: np.ndarray) -> np.ndarray:
    """Write the codes of all frames; gives the bits a symbol takes (0 where a frame has a single symbol)."""
    frames, symbols = lengths.shape
    used = (lengths > 0).sum(1)
    single = used < 2
    symbol = np.where(used > 0, lengths.argmax(1), 0)
    one = np.flatnonzero(single)
    many = np.flatnonzero(~single)
    parts = [(one, np.zeros(len(one), np.int64), 0b101 | symbol[one] << 3, np.full(len(one), 11))]
    if len(many):
        head = sum(int(LENGTH_CODE[s]) << (3 * k) for k, s in enumerate(webp.LENGTH_ORDER[:13]))
        rest = sum(int(LENGTH_CODE[s]) << (3 * k) for k, s in enumerate(webp.LENGTH_ORDER[13:]))
        mine = lengths[many]
        flat = mine.ravel()
        # runs of equal lengths; those of zeros are told by their size
        edge = np.ones(len(flat), bool)
        edge[1:] = flat[1:] != flat[:-1]
        edge[::symbols] = True
        start = np.flatnonzero(edge)
        size, value, row = np.diff(np.append(start, len(flat))), flat[start], start // symbols
        last = np.append(np.diff(row) > 0, True) & (value == 0)  # zeros at the end aren't written
        row, size, value = row[~last], size[~last], value[~last]
        zero = value == 0
        full, left = np.where(zero, size // 138, 0), np.where(zero, size % 138, 0)
        some = (left > 2).astype(np.int64)
        plain = np.where(zero, np.where(left > 2, 0, left), size)
        kinds = np.stack([full, some, plain], 1)
        n = kinds.sum(1)
        item = np.repeat(np.arange(len(row)), n)
        nth = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n)
        is_full = nth < full[item]
        is_some = ~is_full & (nth < (full + some)[item])
        eighteen = is_full | (is_some & (left[item] > 10))
        seventeen = is_some & (left[item] <= 10)
        kind = np.where(eighteen, 18, np.where(seventeen, 17, value[item]))
        extra = np.where(is_full, 127, np.where(eighteen, left[item] - 11, np.where(seventeen, left[item] - 3, 0)))
        bits, more = LENGTH_CODE[kind], np.where(eighteen, 7, np.where(seventeen, 3, 0))
        own = many[row[item]]
        count = np.bincount(row[item], minlength=len(many))
        parts += [
            (many, np.full(len(many), 1), np.full(len(many), 15 << 1 | head << 5), np.full(len(many), 44)),
            (many, np.full(len(many), 2), rest | 1 << 18 | 4 << 19 | (count - 2) << 22, np.full(len(many), 32)),
            (own, np.arange(len(own)) + 3, LENGTH_CODES[kind] | extra << bits, bits + more),
        ]
    frame, place, value, bits = (np.concatenate([p[k] for p in parts]) for k in range(4))
    order = np.lexsort((place, frame))
    items.add(frame[order], value[order], bits[order])
    return np.where(single[:, None], 0, lengths)


def spread(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Prefix symbols, extra bits and how many, of lengths or distances from 1 on."""
    v = values - 1
    high = np.where(v < 4, 0, np.floor(np.log2(np.maximum(v, 1))).astype(np.int64))
    more = np.maximum(0, high - 1)
    symbol = np.where(v < 4, v, 2 * high + ((v >> more) & 1))
    return symbol, v & ((1 << more) - 1), more


_near: dict[int, np.ndarray] = {}


def near_codes(width: int) -> np.ndarray:
    """The distance code of each short distance in an image of that width, or 0."""
    if width not in _near:
        out = np.zeros(8 * width + 9, np.int64)
        for k in range(119, -1, -1):
            x, y = webp.NEAR[k]
            if x + y * width >= 1:
                out[x + y * width] = k + 1
        _near[width] = out
    return _near[width]


def _bits(base: np.ndarray, values: np.ndarray, frames: int, size: np.ndarray) -> np.ndarray:
    """Entropy of byte values per frame, in bits. base: 256 times each value's frame."""
    c = np.bincount(base + values, minlength=frames * 256).reshape(frames, 256).astype(float)
    return size * np.log2(np.maximum(size, 1)) - (c * np.log2(np.maximum(c, 1))).sum(1)


def residues(rgb: list[np.ndarray], place: np.ndarray, mode: int) -> list[np.ndarray]:
    """Channels less their predictions. rgb: bytes of each channel of opaque frames of ``WIDTH``; place: of each pixel in its frame."""

    def shifted(c: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros_like(c)
        out[by:] = c[:-by]
        return out

    left = [shifted(c, 1) for c in rgb]
    if mode == 1:
        guess = [p.copy() for p in left]
    else:
        guess = [shifted(c, WIDTH) for c in rgb]
    if mode == 11:
        corner = [shifted(c, WIDTH + 1) for c in rgb]
        gap = lambda p, q: sum((np.maximum(x, y) - np.minimum(x, y)).astype(np.int16) for x, y in zip(p, q, strict=True))
        closer = gap(guess, corner) < gap(left, corner)
        guess = [np.where(closer, p, u) for p, u in zip(left, guess, strict=True)]
    first_row, first_column = place < WIDTH, np.flatnonzero((place % WIDTH == 0) & (place > 0))
    out = []
    for c, p, q in zip(rgb, left, guess, strict=True):
        q[first_row] = p[first_row]
        q[first_column] = c[first_column - WIDTH]
        q[place == 0] = 0
        out.append(c - q)
    return out


def _argb(r: np.ndarray, g: np.ndarray, b: np.ndarray, alpha: int = 0) -> np.ndarray:
    return np.uint32(alpha << 24) | r.astype(np.uint32) << np.uint32(16) | g.astype(np.uint32) << np.uint32(8) | b


def _grid(value: int) -> tuple[int, int]:
    """A transform's image of one pixel: no cache, five codes of one symbol."""
    out, at = 0, 1
    for k in (8, 16, 0, 24, None):
        symbol = 0 if k is None else value >> k & 255
        out |= (0b101 | symbol << 3) << at
        at += 11
    return out, at


def _palette_bits(colours: np.ndarray) -> tuple[int, int]:
    """The palette's image: differences of colours, by even codes."""
    c = webp._channels(colours)
    d = webp._packed(np.diff(c, axis=0, prepend=np.zeros((1, 4), np.int64)))
    w = webp.BitWriter()
    w.put(3, 2)
    w.put(len(colours) - 1, 8)
    w.put(0, 1)  # no cache
    planes = []
    for k in (8, 16, 0, 24):
        v = (d >> k) & 255
        present = np.zeros(256, bool)
        present[v] = True
        symbols, size = webp._even_code(present)
        webp._put_code(w, symbols, size)
        planes.append((np.searchsorted(symbols, v), size))
    webp._put_code(w, np.array([0]), 0)
    for k in range(len(colours)):
        for index, size in planes:
            if size:
                w.put(int(f"{int(index[k]):0{size}b}"[::-1], 2), size)
    return w.value, w.n


def _wide(value: int, n: int) -> list[tuple[int, int]]:
    return [(value >> at & 0xFFFFFFFF, min(32, n - at)) for at in range(0, n, 32)]


def _slots(px: np.ndarray) -> np.ndarray:
    """Each pixel's place in the colour cache."""
    return ((px * np.uint32(webp.CACHE_MULTIPLIER)) >> np.uint32(32 - CACHE_BITS)).astype(np.int64)


def transformed(px: np.ndarray, own: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[tuple[int, int]]], list[str]]:
    """(pixels, their frames, widths, header fields, names) after the transform that makes each frame smallest."""
    frames = len(size)
    start = np.cumsum(size) - size
    place, base = np.arange(len(px)) - start[own], own * 256
    r, g, b = ((px >> np.uint32(k)).astype(np.uint8) for k in (16, 8, 0))
    bits = lambda v: _bits(base, v, frames, size)
    red, green, blue = bits(r), bits(g), bits(b)
    red_green, blue_green, blue_red = bits(r - g), bits(b - g), bits(b - r)
    cost = {"plain": red + green + blue, "green": green + red_green + blue_green + 3}
    cost["cross"] = green + np.minimum(red, red_green) + np.minimum(blue, np.minimum(blue_green, blue_red)) + 62
    # a predictor is tried where it makes the green of some frame smaller, and the one that chooses where another is
    rest, better = {}, np.zeros(frames, bool)
    for mode in MODES:
        if mode == MODES[-1] and not better.any():
            break
        tried = residues([g], place, mode) if mode != MODES[-1] else []
        some = bits(tried[0]) < green if tried else better
        better |= some
        cost[f"predictor {mode}"] = np.full(frames, np.inf)
        if some.any():
            at = np.flatnonzero(some[own])
            part = residues([c[at] for c in (r, g, b)], place[at], mode)
            rest[mode] = at, part
            cost[f"predictor {mode}"][some] = sum(_bits(base[at], c, frames, size) for c in part)[some] + 62
    # colours that share a place in the cache are at least as many as the places
    places = _bits(base, _slots(px), frames, size)
    taken = (np.bincount(base + _slots(px), minlength=256 * frames).reshape(frames, 256) > 0).sum(1)
    low = places + 24 * taken + 90 < np.minimum.reduce([cost[k] for k in cost])
    at = np.flatnonzero(low[own])
    order = at[np.argsort((own[at] << 24) + (px[at] & np.uint32(0xFFFFFF)))]
    new = np.ones(len(order), bool)
    new[1:] = (px[order][1:] != px[order][:-1]) | (own[order][1:] != own[order][:-1])
    colours = np.bincount(own[order][new], minlength=frames)
    group = np.cumsum(new) - 1
    many = np.bincount(group, minlength=1)
    spent = np.bincount(own[order][new], (many * np.log2(np.maximum(many, 1)))[: int(new.sum())], frames)
    index = np.empty(len(px), np.int64)
    index[order] = group - (np.cumsum(colours) - colours)[own[order]]
    cost["palette"] = np.where(low & (colours <= 256), size * np.log2(np.maximum(size, 1)) - spent + 24 * colours + 90, np.inf)
    names = list(cost)
    choice = np.argmin(np.stack([cost[k] for k in names]), 0)
    chosen = [names[k] for k in choice.tolist()]
    out, widths, heads = px.copy(), np.full(frames, WIDTH), [[(0, 1)] for _ in range(frames)]
    if not choice.any():
        return out, own, widths, heads, chosen
    kind = choice[own]
    here = kind == names.index("green")
    out[here] = _argb((r - g)[here], g[here], (b - g)[here], 255)
    for mode, (at, channels) in rest.items():
        mine = kind[at] == names.index(f"predictor {mode}")
        out[at[mine]] = _argb(*(c[mine] for c in channels))  # alpha is what is predicted
    distinct = px[order][new]
    pieces = {}
    for f in np.flatnonzero((choice > 0)).tolist():
        a, z = int(start[f]), int(start[f] + size[f])
        if chosen[f] == "green":
            heads[f] = [(0b101, 3), (0, 1)]
        elif chosen[f] == "cross":
            to_red = 32 if red_green[f] < red[f] else 0
            best = min((blue[f], 0, 0), (blue_green[f], 32, 0), (blue_red[f], 0, 32))
            heads[f] = [(0b011, 3), (7, 3), *_wide(*_grid(best[2] << 16 | best[1] << 8 | to_red)), (0, 1)]
            own_red = r[a:z] - g[a:z] if to_red else r[a:z]
            own_blue = b[a:z] - (g if best[1] else r)[a:z] if best[1] or best[2] else b[a:z]
            out[a:z] = _argb(own_red, g[a:z], own_blue, 255)
        elif chosen[f] == "palette":
            at = int(np.searchsorted(own[order][new], f))
            n = int(colours[f])
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            per = 1 << packed
            v = index[a:z].reshape(-1, WIDTH // per, per) << (8 // per * np.arange(per))
            pieces[f] = (v.sum(2).ravel().astype(np.uint32) << np.uint32(8)) | np.uint32(0xFF000000)
            widths[f] = WIDTH // per
            heads[f] = [(1, 1), *_wide(*_palette_bits(distinct[at : at + n])), (0, 1)]
        else:
            mode = int(chosen[f].split()[1])
            heads[f] = [(0b001, 3), (7, 3), *_wide(*_grid(0xFF000000 | mode << 8)), (0, 1)]
    if pieces:
        parts = [pieces.get(f, out[a : a + n]) for f, (a, n) in enumerate(zip(start.tolist(), size.tolist(), strict=True))]
        size = np.array([len(p) for p in parts])
        out, own = np.concatenate(parts), np.repeat(np.arange(frames), size)
    return out, own, widths, heads, chosen


def copies(px: np.ndarray, own: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first pixel, pixels, distance) of the back references. left: pixels from each to its frame's end.

    A window of three pixels that occurred before in the frame gives a distance;
    windows side by side at one distance are one reference, without what the one before covers.
    """
    nil = np.zeros(0, np.int64)
    if len(px) < 4:
        return nil, nil, nil
    v = rolling.mix(px.astype(np.uint64) + np.uint64(1))
    # 32 bits by halves, which numpy sorts by counting; frames follow each other, so those of a key do, too
    key = rolling.mix(v[:-2] + np.uint64(3) * v[1:-1] + np.uint64(5) * v[2:])
    order = np.flatnonzero(left[:-2] >= 3)
    for half in (0, 16):
        order = order[np.argsort((key[order] >> np.uint64(half)).astype(np.uint16), kind="stable")]
    a, b = order[:-1], order[1:]
    same = (own[a] == own[b]) & (px[a] == px[b]) & (px[a + 1] == px[b + 1]) & (px[a + 2] == px[b + 2])
    back = np.zeros(len(px) + 1, np.int64)
    back[b[same]] = (b - a)[same]
    hit = np.flatnonzero(back)
    if not len(hit):
        return nil, nil, nil
    new = np.ones(len(hit), bool)
    new[1:] = (hit[1:] != hit[:-1] + 1) | (back[hit[1:]] != back[hit[:-1]]) | (own[hit[1:]] != own[hit[:-1]])
    first = np.flatnonzero(new)
    begin, end = hit[first], hit[np.append(first[1:], len(hit)) - 1] + 3
    begin[1:] = np.maximum(begin[1:], end[:-1])  # ends ascend
    keep = end - begin >= 2
    return begin[keep], (end - begin)[keep], back[hit[first]][keep]


def encode_frames(frames: list[np.ndarray]) -> tuple[list[bytes], Counter]:
    """VP8L streams of frames (rows of ``ROW`` bytes, flat), and how often each feature occurs."""
    size = np.array([len(f) // 3 for f in frames])
    flat = np.concatenate(frames).reshape(-1, 3).astype(np.uint32)
    px = np.uint32(0xFF000000) | flat[:, 0] << np.uint32(16) | flat[:, 1] << np.uint32(8) | flat[:, 2]
    n, heights = len(frames), size // WIDTH
    px, own, widths, heads, chosen = transformed(px, np.repeat(np.arange(n), size), size)
    size = np.bincount(own, minlength=n)
    start = np.cumsum(size) - size
    begin, many, back = copies(px, own, (start + size)[own] - np.arange(len(px)))
    covered = np.zeros(len(px) + 1, np.int64)
    covered[begin] += 1
    np.add.at(covered, begin + many, -1)
    free = np.cumsum(covered[:-1]) == 0
    # the cache holds every pixel before; the last in its place counts
    slot = _slots(px)
    order = np.argsort(slot.astype(np.uint8), kind="stable")  # and by frame, as they follow each other
    held = np.zeros(len(px), bool)
    held[order[1:]] = (px[order[1:]] == px[order[:-1]]) & (own[order[1:]] == own[order[:-1]])
    held &= free
    cached = np.bincount(own[held], minlength=n) >= CACHE_LEAST
    held &= cached[own]
    # tokens in order: free pixels and copies
    token = np.zeros(len(px), np.int8)
    token[free] = 1
    token[held] = 2
    token[begin] = 3
    at = np.flatnonzero(token)
    kind, frame = token[at], own[at]
    symbol = (px[at] >> 8 & 255).astype(np.int64)
    symbol[kind == 2] = GREEN + LENGTHS + slot[at[kind == 2]]
    length, length_extra, length_more = spread(many)
    distance = back + 120
    for w in np.unique(widths[own[begin]]).tolist():
        near, mine = near_codes(w), widths[own[begin]] == w
        close = near[np.minimum(back, len(near) - 1)] * (back < len(near))
        distance = np.where(mine & (close > 0), close, distance)
    far, far_extra, far_more = spread(distance)
    symbol[kind == 3] = GREEN + length
    literal, copy = np.flatnonzero(kind == 1), np.flatnonzero(kind == 3)

    def counted(keys: np.ndarray, symbols: int) -> np.ndarray:
        return code_lengths(np.bincount(keys, minlength=n * symbols).reshape(n, symbols))

    # keys: of each token's symbol among all frames' symbols
    alphabet, plain, own_frame = GREEN + LENGTHS + (1 << CACHE_BITS), px[at[literal]], frame[literal] << 8
    keys = [frame * alphabet + symbol, *(own_frame + (plain >> np.uint32(k) & np.uint32(255)) for k in (16, 0, 24)), frame[copy] * DISTANCES + far]
    lengths = [counted(k, symbols) for k, symbols in zip(keys, (alphabet, 256, 256, 256, DISTANCES), strict=True)]
    items, every = Items(n), np.arange(n)
    items.add(every, 0x2F | (WIDTH - 1) << 8 | (heights - 1) << 22, np.full(n, 40))
    fields = [(f, v, b) for f, head in enumerate(heads) for v, b in head]
    items.add(*(np.array(c) for c in zip(*fields, strict=True)))
    items.add(every, np.where(cached, 1 | CACHE_BITS << 1, 0), np.where(cached, 6, 2))  # the cache; no meta codes
    codes = [codes_of(x).ravel() for x in lengths]
    used = [put_codes(items, x).ravel() for x in lengths]
    bits = used[0][keys[0]]
    values = codes[0][keys[0]] * (bits > 0)

    def more(where: np.ndarray, value: np.ndarray, size: np.ndarray) -> None:
        before = bits[where]
        values[where] |= (value & ((1 << size) - 1)) << before
        bits[where] = before + size

    for k in (1, 2, 3):
        more(literal, codes[k][keys[k]], used[k][keys[k]])
    more(copy, length_extra, length_more)
    more(copy, codes[4][keys[4]], used[4][keys[4]])
    more(copy, far_extra, far_more)
    items.add(frame, values, bits)
    seen = Counter(c.split()[0] for c in chosen)
    seen |= Counter({"frames": n, "copies": len(set(frame[copy].tolist())), "near": len(set(frame[copy][distance <= 120].tolist())), "cache": int(cached.sum())})
    return items.packed(), seen


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + bytes(len(body) & 1)


def _three(v: int) -> bytes:
    return v.to_bytes(3, "little")


def encode(payloads: list[bytes], features: Counter | None = None) -> list[bytes]:
    """A lossless WebP file of each payload of whole rows; one of several frames is an animation that never moves on."""
    frames, counts = [], []
    for p in payloads:
        rows = len(p) // ROW
        if not rows or len(p) % ROW or rows > 1 << 24:
            raise ValueError("a payload is not whole rows, or too many")
        frames += [np.frombuffer(p, np.uint8, min(FRAME, rows - at) * ROW, at * ROW) for at in range(0, rows, FRAME)]
        counts.append(-(-rows // FRAME))
    streams = []
    for a, z in rolling.chunks([len(f) for f in frames], SOME):
        some, seen = encode_frames(frames[a:z])
        streams += some
        if features is not None:
            features += seen
    out, at = [], 0
    for p, n in zip(payloads, counts, strict=True):
        own, rows = streams[at : at + n], len(p) // ROW
        at += n
        if n == 1:
            body = _chunk(b"VP8L", own[0])
        else:
            parts = [_chunk(b"VP8X", bytes([2, 0, 0, 0]) + _three(WIDTH - 1) + _three(rows - 1)), _chunk(b"ANIM", bytes([255, 255, 255, 255, 1, 0]))]
            for k, s in enumerate(own):
                high = min(FRAME, rows - k * FRAME)
                parts.append(_chunk(b"ANMF", _three(0) + _three(k * FRAME // 2) + _three(WIDTH - 1) + _three(high - 1) + _three(0) + b"\2" + _chunk(b"VP8L", s)))
            body = b"".join(parts)
        out.append(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WEBP" + body)
    return out


def _chunks(data: bytes, at: int, end: int):
    while at + 8 <= end:
        size = struct.unpack("<I", data[at + 4 : at + 8])[0]
        yield data[at : at + 4], at + 8, min(end, at + 8 + size)
        at += 8 + size + (size & 1)


def frames_of(data: bytes) -> tuple[tuple[int, int] | None, list[tuple[int, int, bytes]]]:
    """((width, height) of an animation or None, [(x, y, VP8L stream)]) of a file."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    canvas, found = None, []
    three = lambda at: int.from_bytes(data[at : at + 3], "little")
    for name, a, z in _chunks(data, 12, len(data)):
        if name == b"VP8X" and data[a] & 2:
            canvas = (three(a + 4) + 1, three(a + 7) + 1)
        elif name == b"VP8L" and not (canvas and found):
            found.append((0, 0, data[a:z]))
        elif name == b"ANMF":
            found += [(2 * three(a), 2 * three(a + 3), data[x:y]) for kind, x, y in _chunks(data, a + 16, z) if kind == b"VP8L"]
    if not found:
        raise ValueError("no lossless image in the file")
    return canvas, found


class _Lanes:
    """The main images of some streams, read side by side."""

    def __init__(self, readers: list[webp.Bits], widths: list[int], heights: list[int]):
        sizes = [len(r.data) for r in readers]
        first = np.cumsum([0, *sizes])
        buf = np.frombuffer(b"".join([*(r.data for r in readers), bytes(16)]), np.uint8)
        self.view = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))
        self.at = 8 * first[:-1] + np.array([r.at for r in readers])
        self.end = 8 * first[:-1] + np.array([r.end for r in readers])
        self.width, self.n = np.array(widths), np.array(widths) * np.array(heights)

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        at = self.at[lanes]
        return self.view[at >> 3] >> (at & 7).view(np.uint64)

    def take(self, lanes: np.ndarray, n) -> np.ndarray:
        """The next n bits, at most 32 and the same for all or one each."""
        out = self.peek(lanes).view(np.int64) & ((1 << n) - 1)
        self.at[lanes] += n
        return out

    def check(self) -> None:
        if (self.at > self.end).any():
            raise ValueError("the image ends too early")

    def lengths(self, alphabet: np.ndarray) -> np.ndarray:
        """Code lengths (lanes, symbols); a single stated symbol has length 1."""
        lanes, most = len(alphabet), int(alphabet.max())
        out = np.zeros((lanes, most), np.int64)
        simple = self.take(np.arange(lanes), 1) == 1
        one = np.flatnonzero(simple)
        if len(one):
            two, eight = self.take(one, 1), self.take(one, 1)
            out[one, self.take(one, np.where(eight, 8, 1))] = 1
            both = one[two == 1]
            out[both, self.take(both, 8)] = 1
        todo = np.flatnonzero(~simple)
        if not len(todo):
            return out
        count = 4 + self.take(todo, 4)
        own = np.zeros((len(todo), 19), np.int64)
        for k, s in enumerate(webp.LENGTH_ORDER):
            some = np.flatnonzero(count > k)
            own[some, s] = self.take(todo[some], 3)
        code = _Codes(own, 7)
        left = alphabet[todo].copy()
        limited = np.flatnonzero(self.take(todo, 1))
        wide = 2 + 2 * self.take(todo[limited], 3)
        left[limited] = 2 + self.take(todo[limited], wide)
        place, last = np.zeros(len(todo), np.int64), np.full(len(todo), 8)
        now = np.arange(len(todo))
        while len(now):
            s, n = code.read(now, self.peek(todo[now]))
            self.at[todo[now]] += n
            left[now] -= 1
            plain = s < 16
            a, v = now[plain], s[plain]
            out[todo[a], place[a]] = v
            place[a] += 1
            last[a] = np.where(v > 0, v, last[a])
            if not plain.all():
                b, kind = now[~plain], s[~plain]
                run = self.take(todo[b], np.where(kind == 16, 2, np.where(kind == 17, 3, 7))) + np.where(kind == 18, 11, 3)
                if (place[b] + run > alphabet[todo[b]]).any():
                    raise ValueError("code lengths pass the alphabet")
                for k in range(6):
                    c = b[(kind == 16) & (run > k)]
                    out[todo[c], place[c] + k] = last[c]
                place[b] += run
            now = now[(place[now] < alphabet[todo[now]]) & (left[now] > 0)]
        self.check()
        return out

    def pixels(self) -> list[np.ndarray]:
        """ARGB pixels of all lanes; the readers stand behind the transforms."""
        every = np.arange(len(self.n))
        has = self.take(every, 1)
        cache_bits = np.zeros(len(every), np.int64)
        cache_bits[has > 0] = self.take(every[has > 0], 4)
        if (cache_bits > 11).any() or self.take(every, 1).any():
            raise ValueError("the colour cache is too large, or there are meta codes")
        sizes = (GREEN + LENGTHS + np.where(cache_bits > 0, 1 << cache_bits, 0), *(np.full(len(every), s) for s in (256, 256, 256, DISTANCES)))
        green, red, blue, alpha, far = (_Codes(self.lengths(s)) for s in sizes)
        cache = np.zeros((len(every), 2 << int(cache_bits.max())), np.uint32)
        begin = np.cumsum(self.n) - self.n
        spot, stop = begin.copy(), begin + self.n
        out = np.zeros(int(self.n.sum()), np.uint32)
        any_cache, short = bool(cache_bits.any()), green.most + red.most + blue.most + alpha.most <= 56
        sizes = np.unique(cache_bits[cache_bits > 0])
        # lanes without a cache write theirs, too, and never read it
        shift = np.uint32(32 - int(sizes[0])) if len(sizes) == 1 else np.where(cache_bits > 0, 32 - cache_bits, 31).astype(np.uint32)

        def remember(lanes: np.ndarray, px: np.ndarray) -> None:
            own = shift if len(sizes) == 1 else shift[lanes]
            cache[lanes, (px * np.uint32(webp.CACHE_MULTIPLIER)) >> own] = px

        now = every
        while len(now):
            bits = self.peek(now)
            s, n = green.read(now, bits)
            self.at[now] += n
            literal = s < GREEN
            whole = bool(literal.all())
            a = now if whole else now[literal]
            if len(a):
                if short:  # all four lie within the bits at hand
                    bits = bits >> n.view(np.uint64)
                    bits = bits if whole else bits[literal]
                else:
                    bits = self.peek(a)
                r, n1 = red.read(a, bits)
                bits = bits >> n1.view(np.uint64)
                b, n2 = blue.read(a, bits)
                n1 += n2
                if alpha.only is None:
                    x, n3 = alpha.read(a, bits >> n2.view(np.uint64))
                    n1 += n3
                else:
                    x = alpha.only[a]
                self.at[a] += n1
                px = ((x << 24) | (r << 16) | ((s if whole else s[literal]) << 8) | b).astype(np.uint32)
                out[spot[a]] = px
                spot[a] += 1
                if any_cache:
                    remember(a, px)
            if not whole:
                held = s >= GREEN + LENGTHS
                c = now[held]
                if len(c):
                    out[spot[c]] = cache[c, s[held] - GREEN - LENGTHS]
                    spot[c] += 1
                copy = ~literal & ~held
                c = now[copy]
                if len(c):
                    length = self._spread(c, s[copy] - GREEN)
                    f, n = far.read(c, self.peek(c))
                    self.at[c] += n
                    back = self._distance(self._spread(c, f), self.width[c])
                    at = spot[c]
                    if (back > at - begin[c]).any() or (at + length > stop[c]).any():
                        raise ValueError("a back reference leaves the image")
                    nth = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
                    place, step = np.repeat(at, length), np.repeat(back, length)
                    px = out[place - step + nth % step]
                    out[place + nth] = px
                    if any_cache:
                        remember(np.repeat(c, length), px)
                    spot[c] += length
            left = spot[now] < stop[now]
            if not left.all():
                now = now[left]
                self.check()
        return [out[a : a + n] for a, n in zip(begin.tolist(), self.n.tolist(), strict=True)]

    def _spread(self, lanes: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        more = np.where(symbol < 4, 0, (symbol - 2) >> 1)
        high = np.where(symbol < 4, symbol, (2 + (symbol & 1)) << more)
        return high + self.take(lanes, more) + 1

    @staticmethod
    def _distance(code: np.ndarray, width: np.ndarray) -> np.ndarray:
        near = np.minimum(code, 120) - 1
        return np.where(code > 120, code - 120, np.maximum(1, NEAR[near, 0] + NEAR[near, 1] * width))


NEAR = np.array(webp.NEAR)


class _Codes:
    """A prefix code per lane, read by a table of the next bits; longer codes by their canonical order."""

    def __init__(self, lengths: np.ndarray, fast: int = FAST):
        lanes, symbols = lengths.shape
        self.fast = fast
        used = (lengths > 0).sum(1)
        self.only, self.most = (lengths.argmax(1) if (used == 1).all() else None), int(lengths.max())
        if self.only is not None:
            return
        share = np.where(lengths > 0, 1 << (15 - lengths), 0).sum(1)
        if ((used > 1) & (share != 1 << 15)).any() or (used == 0).any():
            raise ValueError("a prefix code is not complete")
        row, column = np.nonzero(lengths)
        n = np.where(used[row] == 1, 0, lengths[row, column])
        order = np.lexsort((column, n, row))
        row, self.symbols, n = row[order], column[order].astype(np.int32), n[order]
        many = np.where(n <= fast, 1 << np.maximum(0, fast - n), 0)
        self.table = np.full(lanes << fast, -1, np.int32)
        begin = np.cumsum(many) - many
        first = np.flatnonzero(np.diff(row, prepend=-1))
        left = begin - np.repeat(begin[first], np.diff(np.append(first, len(row))))
        at = np.repeat((row << fast) + left - begin, many) + np.arange(int(many.sum()))
        self.table[at] = np.repeat(self.symbols << 4 | n, many)
        self.long = bool((n > fast).any())
        if self.long:
            levels = np.bincount(row * 16 + n, minlength=lanes * 16).reshape(lanes, 16)
            levels[:, 0] = 0
            code = np.zeros((lanes, 16), np.int64)
            for k in range(1, 16):
                code[:, k] = (code[:, k - 1] + levels[:, k - 1]) << 1
            self.levels, self.code = levels, code
            self.place = np.cumsum(levels, 1) - levels + (np.cumsum(used) - used)[:, None]

    def read(self, lanes: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol, length) from the next bits of some lanes."""
        if self.only is not None:
            return self.only[lanes], np.zeros(len(lanes), np.int64)
        found = self.table[(lanes << self.fast) + TURNED[self.fast][bits.view(np.int64) & ((1 << self.fast) - 1)]].astype(np.int64)
        symbol, n = found >> 4, found & 15
        if self.long and (found < 0).any():
            for k in np.flatnonzero(found < 0).tolist():
                lane, whole = int(lanes[k]), int(TURNED[15][int(bits[k]) & 0x7FFF])
                for size in range(self.fast + 1, 16):
                    nth = (whole >> (15 - size)) - int(self.code[lane, size])
                    if 0 <= nth < self.levels[lane, size]:
                        symbol[k], n[k] = self.symbols[self.place[lane, size] + nth], size
                        break
        return symbol, n


def decode_streams(streams: list[bytes]) -> list[np.ndarray]:
    """ARGB pixels (height, width) of VP8L streams."""
    size = [int.from_bytes(s[1:5], "little") for s in streams]
    pixels = [((v & 0x3FFF) + 1) * ((v >> 14 & 0x3FFF) + 1) for v in size]
    return [p for a, z in rolling.chunks([3 * n for n in pixels], CHUNK) for p in _side_by_side(streams[a:z])]


def _side_by_side(streams: list[bytes]) -> list[np.ndarray]:
    heads, out = [webp.read_head(s) for s in streams], [None] * len(streams)
    # an image with meta codes chooses among codes pixel by pixel: those go one by one
    simple = [k for k, h in enumerate(heads) if not h.meta]
    if simple:
        lanes = _Lanes([heads[k].bits for k in simple], [heads[k].inner for k in simple], [heads[k].height for k in simple])
        for k, px in zip(simple, lanes.pixels(), strict=True):
            out[k] = px
    for k, h in enumerate(heads):
        out[k] = h.finish(webp._read_pixels(h.bits, h.inner, h.height, True) if out[k] is None else out[k])
    return out


def decode(files: list[bytes]) -> list[np.ndarray]:
    """Red, green and blue samples (height, width, 3) of lossless WebP files; the frames of an animation lie where they are drawn."""
    found = [frames_of(f) for f in files]
    images = iter(decode_streams([s for _, frames in found for _, _, s in frames]))
    out = []
    for canvas, frames in found:
        parts = [(x, y, next(images)) for x, y, _ in frames]
        if canvas is None:
            argb = parts[0][2]
        elif all(x == 0 and p.shape[1] == canvas[0] for x, _, p in parts) and [y for _, y, _ in parts] == np.cumsum([0, *(len(p) for _, _, p in parts)])[:-1].tolist():
            argb = np.concatenate([p for _, _, p in parts])
        else:
            argb = np.zeros(canvas[::-1], np.uint32)
            for x, y, p in parts:
                argb[y : y + p.shape[0], x : x + p.shape[1]] = p
        samples = np.empty((*argb.shape, 3), np.uint8)
        for k, s in enumerate((16, 8, 0)):
            samples[..., k] = (argb >> s) & 255
        out.append(samples)
    return out
