"""Lossless WebP, one image at a time: a decoder of the whole format.

It reads any VP8L image: prefix codes, meta prefix codes, back references, the
colour cache, and it inverts the predictor, cross-colour, subtract-green and
palette transforms. Where an image has one group of prefix codes, no cache,
codes of one length per channel and literals alone, all its pixels lie at a
fixed stride; these are unpacked as one array. All else goes symbol by symbol.

``lanes`` reads and writes many images at once and takes containers, transforms
and their small images from here.
"""

from __future__ import annotations

import struct

import numpy as np

ROW = 192
# Fixed values of the format: the order in which code length codes are stored.
LENGTH_ORDER = (17, 18, 0, 1, 2, 3, 4, 5, 16, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15)
#: The 120 near positions, by distance, then by column, right before left.
NEAR = sorted(((x, y) for x in range(-7, 9) for y in range(8) if y or x > 0), key=lambda p: (p[0] ** 2 + p[1] ** 2, abs(p[0]), -p[0]))
CACHE_MULTIPLIER = 0x1E35A7BD


class Bits:
    """Reads little-endian bits."""

    def __init__(self, data: bytes):
        self.data, self.at, self.end = data + bytes(8), 0, 8 * len(data)

    def peek(self) -> int:
        k = self.at >> 3
        return int.from_bytes(self.data[k : k + 8], "little") >> (self.at & 7)

    def take(self, n: int) -> int:
        if self.at + n > self.end:
            raise ValueError("the image ends too early")
        out = self.peek() & ((1 << n) - 1)
        self.at += n
        return out


class Code:
    """A canonical prefix code. ``lengths``: bits per symbol, 0 where it doesn't occur."""

    def __init__(self, lengths: np.ndarray):
        used = np.flatnonzero(lengths)
        self.symbols = used.astype(np.int64)
        if len(used) == 1:
            self.bits = self.even = 0
            return
        sizes = lengths[used].astype(np.int64)
        self.bits = int(sizes.max()) if len(used) else -1
        if not len(used) or int((1 << (self.bits - sizes)).sum()) != 1 << self.bits:
            raise ValueError("a prefix code is not complete")
        self.even = self.bits if int(sizes.min()) == self.bits else None
        self.sizes, self.table = sizes, None

    def lookup(self) -> list[tuple[int, int]]:
        """(symbol, length) for the next ``bits`` bits, read little-endian."""
        if self.table is None:
            order = np.lexsort((self.symbols, self.sizes))
            flat = np.empty((1 << self.bits, 2), np.int64)
            at = 0
            for k in order:
                n = 1 << int(self.bits - self.sizes[k])
                flat[at : at + n] = self.symbols[k], self.sizes[k]
                at += n
            turned = np.zeros(1 << self.bits, np.int64)
            for b in range(self.bits):
                turned |= ((np.arange(1 << self.bits) >> b) & 1) << (self.bits - 1 - b)
            self.table = [tuple(x) for x in flat[turned].tolist()]
        return self.table

    def read(self, bits: Bits) -> int:
        if not self.bits:
            return int(self.symbols[0])
        symbol, n = self.lookup()[bits.peek() & ((1 << self.bits) - 1)]
        bits.at += n
        if bits.at > bits.end:
            raise ValueError("the image ends too early")
        return symbol


def read_code(bits: Bits, alphabet: int) -> Code:
    lengths = np.zeros(alphabet, np.int8)
    if bits.take(1):  # one or two symbols, stated
        two = bits.take(1)
        first = bits.take(8 if bits.take(1) else 1)
        lengths[first] = 1
        if two:
            lengths[bits.take(8)] = 1
        return Code(lengths)
    sizes = np.zeros(19, np.int8)
    for k in LENGTH_ORDER[: 4 + bits.take(4)]:
        sizes[k] = bits.take(3)
    code, left = Code(sizes), alphabet
    if bits.take(1):
        left = 2 + bits.take(2 + 2 * bits.take(3))
    if code.bits == 0 and code.symbols[0] < 16:  # every length is the same
        lengths[: min(left, alphabet)] = code.symbols[0]
        return Code(lengths)
    at, last = 0, 8
    while at < alphabet and left:
        left -= 1
        k = code.read(bits)
        if k < 16:
            lengths[at] = k
            at, last = at + 1, k or last
            continue
        n = 3 + bits.take(2) if k == 16 else 3 + bits.take(3) if k == 17 else 11 + bits.take(7)
        if at + n > alphabet:
            raise ValueError("code lengths pass the alphabet")
        lengths[at : at + n] = last if k == 16 else 0
        at += n
    return Code(lengths)


def _spread(bits: Bits, symbol: int) -> int:
    """A length or distance from its prefix symbol and extra bits."""
    if symbol < 4:
        return symbol + 1
    more = (symbol - 2) >> 1
    return ((2 + (symbol & 1)) << more) + bits.take(more) + 1


def _even_pixels(bits: Bits, codes: list[Code], n: int) -> np.ndarray:
    sizes = [c.even for c in codes[:4]]
    per = sum(sizes)
    out = np.empty((n, 4), np.uint8)
    if bits.at + n * per > bits.end:
        raise ValueError("the image ends too early")
    start = bits.at >> 3
    raw = np.frombuffer(bits.data, np.uint8, ((bits.at & 7) + n * per + 7) >> 3, start)
    flat = np.unpackbits(raw, bitorder="little")[bits.at & 7 : (bits.at & 7) + n * per].reshape(n, per) if per else None
    at = 0
    for k, (code, size) in enumerate(zip(codes, sizes, strict=False)):
        values = code.symbols.astype(np.uint8)
        out[:, k] = values[np.packbits(flat[:, at : at + size], axis=1)[:, 0] >> (8 - size)] if size else values[0]
        at += size
    bits.at += n * per
    return out


def _read_pixels(bits: Bits, width: int, height: int, top: bool) -> np.ndarray:
    """Entropy-coded pixels as ARGB integers, row by row."""
    cache_bits = bits.take(4) if bits.take(1) else 0
    if cache_bits > 11:
        raise ValueError("the colour cache is too large")
    meta, shift, groups = None, 0, 1
    if top and bits.take(1):
        shift = 2 + bits.take(3)
        wide = -(-width >> shift)
        meta = (_read_pixels(bits, wide, -(-height >> shift), False) >> 8) & 0xFFFF
        groups = int(meta.max()) + 1
    sizes = (280 + ((1 << cache_bits) if cache_bits else 0), 256, 256, 256, 40)
    codes = [[read_code(bits, s) for s in sizes] for _ in range(groups)]
    n, one = width * height, codes[0]
    if meta is None and not cache_bits and all(c.even is not None and c.even <= 8 and (not len(c.symbols) or c.symbols[-1] < 256) for c in one[:4]):
        g, r, b, a = _even_pixels(bits, one, n).T.astype(np.uint32)
        return (a << 24) | (r << 16) | (g << 8) | b
    out, cache, at, seen = [0] * n, [0] * (1 << cache_bits), 0, 0

    def remember(upto: int) -> None:
        nonlocal seen
        for k in range(seen, upto):
            cache[((out[k] * CACHE_MULTIPLIER) & 0xFFFFFFFF) >> (32 - cache_bits)] = out[k]
        seen = upto

    while at < n:
        if meta is not None:
            one = codes[meta[(at // width >> shift) * wide + (at % width >> shift)]]
        s = one[0].read(bits)
        if s < 256:
            red, blue = one[1].read(bits), one[2].read(bits)
            out[at] = (one[3].read(bits) << 24) | (red << 16) | (s << 8) | blue
            at += 1
        elif s < 280:
            length = _spread(bits, s - 256)
            back = _spread(bits, one[4].read(bits))
            if back > 120:
                back -= 120
            else:
                x, y = NEAR[back - 1]
                back = max(1, x + y * width)
            if back > at or at + length > n:
                raise ValueError("a back reference leaves the image")
            for k in range(at, at + length):
                out[k] = out[k - back]
            at += length
        else:
            remember(at)
            out[at] = cache[s - 280]
            at += 1
    return np.array(out, np.uint32)


def _channels(argb: np.ndarray) -> np.ndarray:
    """(..., 4) signed a, r, g, b."""
    return np.stack([(argb >> s) & 255 for s in (24, 16, 8, 0)], -1).astype(np.int64)


def _packed(c: np.ndarray) -> np.ndarray:
    c = (c & 255).astype(np.uint32)
    return (c[..., 0] << 24) | (c[..., 1] << 16) | (c[..., 2] << 8) | c[..., 3]


def _predict(mode: np.ndarray, left: np.ndarray, up: np.ndarray, corner: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Predictions (n, 4) of pixels from their neighbours' channels (left, above, above left, above right), by mode."""
    half = lambda p, q: (p + q) >> 1
    out = np.empty_like(left)
    for m in np.unique(mode).tolist():
        k = mode == m
        p, u, c, r = left[k], up[k], corner[k], right[k]
        if m == 11:  # the one that is closer to left + up - corner
            out[k] = np.where((np.abs(u - c).sum(1) < np.abs(p - c).sum(1))[:, None], p, u)
        elif m == 12:
            out[k] = np.clip(p + u - c, 0, 255)
        elif m == 13:
            mean = half(p, u)
            out[k] = np.clip(mean + np.trunc((mean - c) / 2).astype(np.int64), 0, 255)
        elif m in (0, 14, 15):
            out[k] = (255, 0, 0, 0)
        else:
            out[k] = {
                1: lambda p, u, c, r: p, 2: lambda p, u, c, r: u, 3: lambda p, u, c, r: r, 4: lambda p, u, c, r: c, 5: lambda p, u, c, r: half(half(p, r), u),
                6: lambda p, u, c, r: half(p, c), 7: lambda p, u, c, r: half(p, u), 8: lambda p, u, c, r: half(c, u), 9: lambda p, u, c, r: half(u, r),
                10: lambda p, u, c, r: half(half(p, c), half(u, r)),
            }[m](p, u, c, r)
    return out


def _undo_predictor(argb: np.ndarray, width: int, height: int, shift: int, modes: np.ndarray) -> np.ndarray:
    """A pixel hangs on the one before it and on three in the row above, up to one place to the right.

    So row by row, each two places behind the one above, all pixels of a wave are independent.
    """
    wide = -(-width >> shift)
    out = _channels(argb)
    out[0] = (out[0] + (255, 0, 0, 0)) & 255
    out[:width] = np.cumsum(out[:width], 0) & 255  # the first row hangs on the left
    out[::width] = np.cumsum(out[::width], 0) & 255  # the first column on what is above
    every = (modes >> 8).astype(np.int64) & 15
    for wave in range(3, width + 2 * height):
        y = np.arange(max(1, (wave - width + 2) // 2), min(height - 1, (wave - 1) // 2) + 1)
        x = wave - 2 * y
        k = y * width + x
        # right of the last column lies the first pixel of this row
        guess = _predict(every[(y >> shift) * wide + (x >> shift)], out[k - 1], out[k - width], out[k - width - 1], out[k - width + 1])
        out[k] = (out[k] + guess) & 255
    return _packed(out)


def _signed(v: np.ndarray) -> np.ndarray:
    return (v & 255).astype(np.uint8).astype(np.int8).astype(np.int64)


def _undo_cross_colour(argb: np.ndarray, width: int, height: int, shift: int, factors: np.ndarray) -> np.ndarray:
    wide = -(-width >> shift)
    y, x = np.divmod(np.arange(width * height), width)
    f = factors[(y >> shift) * wide + (x >> shift)]
    red_to_blue, green_to_blue, green_to_red = (_signed(f >> s) for s in (16, 8, 0))
    c = _channels(argb)
    green = _signed(c[:, 2])
    c[:, 1] = (c[:, 1] + ((green_to_red * green) >> 5)) & 255
    c[:, 3] += ((green_to_blue * green) >> 5) + ((red_to_blue * _signed(c[:, 1])) >> 5)
    return _packed(c)


def _undo_palette(argb: np.ndarray, width: int, height: int, packed: int, palette: np.ndarray) -> np.ndarray:
    per = 1 << packed
    index = (argb >> 8) & 255
    if packed:
        bits = 8 >> packed
        rows = index.reshape(height, -1)
        parts = [(rows >> (bits * k)) & ((1 << bits) - 1) for k in range(per)]
        index = np.stack(parts, -1).reshape(height, -1)[:, :width].ravel()
    full = np.zeros(256, np.uint32)
    full[: len(palette)] = palette
    return full[index]


class Head:
    """A VP8L stream up to its main image: sizes, transforms, and the reader that stands there."""

    def __init__(self, bits: Bits, width: int, height: int, opaque: bool, inner: int, steps: list):
        self.bits, self.width, self.height, self.opaque, self.inner, self.steps = bits, width, height, opaque, inner, steps

    @property
    def meta(self) -> bool:
        """Whether the main image has more than one group of prefix codes."""
        ahead = self.bits.peek()
        return bool(ahead >> (5 if ahead & 1 else 1) & 1)

    def finish(self, out: np.ndarray) -> np.ndarray:
        """The image (height, width) from the pixels of the main image: the transforms are undone, the last first."""
        for undo, w, shift, extra in reversed(self.steps):
            if undo:
                out = undo(out, w, self.height, shift, extra)
            else:
                c = _channels(out)
                c[:, 1] += c[:, 2]
                c[:, 3] += c[:, 2]
                out = _packed(c)
        return ((out | np.uint32(0xFF000000)) if self.opaque else out).reshape(self.height, self.width)


def read_head(stream: bytes) -> Head:
    bits = Bits(stream)
    if bits.take(8) != 0x2F:
        raise ValueError("not a VP8L stream")
    width, height = bits.take(14) + 1, bits.take(14) + 1
    opaque = not bits.take(1)
    if bits.take(3):
        raise ValueError("an unknown VP8L version")
    steps, wide, seen = [], width, set()
    while bits.take(1):
        kind = bits.take(2)
        if kind in seen:
            raise ValueError("a transform occurs twice")
        seen.add(kind)
        if kind < 2:
            shift = 2 + bits.take(3)
            grid = _read_pixels(bits, -(-wide >> shift), -(-height >> shift), False)
            steps.append((_undo_cross_colour if kind else _undo_predictor, wide, shift, grid))
        elif kind == 2:
            steps.append((None, wide, 0, None))
        else:
            n = bits.take(8) + 1
            palette = _packed(np.cumsum(_channels(_read_pixels(bits, n, 1, False)), axis=0))
            packed = 3 if n <= 2 else 2 if n <= 4 else 1 if n <= 16 else 0
            steps.append((_undo_palette, wide, packed, palette))
            wide = -(-wide >> packed)
    return Head(bits, width, height, opaque, wide, steps)


def decode_argb(data: bytes) -> np.ndarray:
    """ARGB pixels (height, width) of a lossless WebP file of one image."""
    if data[:4] != b"RIFF" or data[8:12] != b"WEBP":
        raise ValueError("not a WebP file")
    at = 12
    while data[at : at + 4] != b"VP8L":
        if at + 8 > len(data):
            raise ValueError("no lossless image in the file")
        size = struct.unpack("<I", data[at + 4 : at + 8])[0]
        at += 8 + size + (size & 1)
    size = struct.unpack("<I", data[at + 4 : at + 8])[0]
    head = read_head(data[at + 8 : at + 8 + size])
    return head.finish(_read_pixels(head.bits, head.inner, head.height, True))


class BitWriter:
    """Writes little-endian bits."""

    def __init__(self):
        self.value, self.n = 0, 0

    def put(self, value: int, n: int) -> None:
        self.value |= value << self.n
        self.n += n


def _even_code(present: np.ndarray) -> tuple[np.ndarray, int]:
    """The symbols of a complete code of one length that holds the present values."""
    used = np.flatnonzero(present)
    size = max(0, int(len(used) - 1).bit_length())
    if len(used) < 1 << size:  # unused values fill the code up
        used = np.sort(np.concatenate([used, np.flatnonzero(~present)[: (1 << size) - len(used)]]))
    return used, size


def _put_code(out: BitWriter, symbols: np.ndarray, size: int) -> None:
    """An even code over values under 256: stated if small, else by code lengths."""
    if size <= 1:
        out.put(1, 1)
        out.put(size, 1)
        out.put(1, 1)
        for s in symbols:
            out.put(int(s), 8)
        return
    out.put(0, 1)
    if len(symbols) == 256:
        # only the length 8 occurs: it takes no bits at all
        kinds, stream, last = {8: 1}, [], 256
    else:
        mark = np.zeros(256, bool)
        mark[symbols] = True
        last = int(symbols[-1]) + 1
        kinds, stream = {0: 1, size: 1}, mark[:last].astype(int).tolist()
    place = {k: LENGTH_ORDER.index(k) for k in kinds}
    count = max(4, max(place.values()) + 1)
    out.put(count - 4, 4)
    for k in LENGTH_ORDER[:count]:
        out.put(kinds.get(k, 0), 3)
    out.put(1, 1)  # so many lengths follow
    out.put(3, 3)
    out.put(last - 2, 8)
    value = 0
    for k, bit in enumerate(stream):
        value |= bit << k  # of the two lengths, the larger has code 1
    out.put(value, len(stream))
