"""A baseline JPEG writer: 4:2:0, with prefix codes made for each image."""

from __future__ import annotations

import heapq
import struct
from collections import Counter

import numpy as np

from .imaging import CHROMINANCE, LUMINANCE, coefficients, luma_and_chroma, quantisers

#: Places of a tile in diagonal order, as indices of its 64 values.
ZIGZAG = np.array([8 * i + j for i, j in sorted(((i, j) for i in range(8) for j in range(8)), key=lambda p: (sum(p), p[0] if sum(p) % 2 else p[1]))])
LONGEST = 16


def code_lengths(counts: Counter) -> dict[int, int]:
    """Prefix code lengths of at most 16 bits; no code consists of ones alone."""
    heap = [(n, k, (s,)) for k, (s, n) in enumerate(sorted(counts.items()))]
    heap.append((0, -1, (-1,)))  # takes the code of ones
    heapq.heapify(heap)
    length = dict.fromkeys([*counts, -1], 0)
    mark = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for s in a[2] + b[2]:
            length[s] += 1
        heapq.heappush(heap, (a[0] + b[0], mark, a[2] + b[2]))
        mark += 1
    sizes = Counter(length.values())
    for n in range(max(sizes), LONGEST, -1):
        while sizes[n]:  # a pair of leaves moves up: one takes its parent's place, the other hangs below a shorter leaf
            shorter = max(k for k in range(1, n - 1) if sizes[k])
            sizes[n] -= 2
            sizes[n - 1] += 1
            sizes[shorter + 1] += 2
            sizes[shorter] -= 1
    order = sorted(length, key=lambda s: (length[s], s < 0, s))
    spread = [n for n in sorted(sizes) for _ in range(sizes[n])]
    order.remove(-1)
    return dict(zip(order, spread, strict=False))


def canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """(code, length) per symbol."""
    out, code, now = {}, 0, 0
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - now
        now = lengths[s]
        out[s] = (code, now)
        code += 1
    return out


def _value(v: int) -> tuple[int, int]:
    """(bits, how many) of a signed value."""
    n = abs(v).bit_length()
    return (v if v >= 0 else v + (1 << n) - 1), n


def _symbols(tile: list[int], before: int) -> list[tuple[int, int, int, int]]:
    """(class, symbol, bits, how many) of a tile's values in diagonal order; class 0 is the mean, 1 the rest."""
    bits, n = _value(tile[0] - before)
    out, run = [(0, n, bits, n)], 0
    last = max((k for k in range(1, 64) if tile[k]), default=0)
    for v in tile[1 : last + 1]:
        if not v:
            run += 1
            continue
        while run > 15:
            out.append((1, 0xF0, 0, 0))
            run -= 16
        bits, n = _value(v)
        out.append((1, run << 4 | n, bits, n))
        run = 0
    if last < 63:
        out.append((1, 0, 0, 0))
    return out


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


def encode(rgb: np.ndarray, quality: int = 85) -> bytes:
    """A JPEG file of an image (height, width, 3)."""
    h, w, _ = rgb.shape
    full = np.pad(rgb, ((0, -h % 16), (0, -w % 16), (0, 0)), mode="edge")
    steps = [quantisers(LUMINANCE, quality), *[quantisers(CHROMINANCE, quality)] * 2]
    planes = [coefficients(p, q).astype(int).reshape(p.shape[0] // 8, p.shape[1] // 8, 64)[..., ZIGZAG] for p, q in zip(luma_and_chroma(full), steps, strict=True)]
    rows, columns = planes[1].shape[:2]
    stream, before = [], [0, 0, 0]
    for y in range(rows):
        for x in range(columns):
            for k, plane in enumerate(planes):
                for tile in plane[2 * y : 2 * y + 2, 2 * x : 2 * x + 2].reshape(-1, 64).tolist() if k == 0 else [plane[y, x].tolist()]:
                    stream += [(k > 0, *s) for s in _symbols(tile, before[k])]
                    before[k] = tile[0]
    counts = {(c, kind): Counter() for c in (False, True) for kind in (0, 1)}
    for c, kind, s, _, _ in stream:
        counts[c, kind][s] += 1
    lengths = {k: code_lengths(n) for k, n in counts.items()}
    codes = {k: canonical(n) for k, n in lengths.items()}
    tables = b""
    for (c, kind), size in lengths.items():
        order = sorted(size, key=lambda s: (size[s], s))
        tables += bytes([kind << 4 | c]) + bytes(sum(1 for n in size.values() if n == k) for k in range(1, 17)) + bytes(order)
    bits = []
    for c, kind, s, value, n in stream:
        code, m = codes[c, kind][s]
        bits.append(format(code << n | value, f"0{m + n}b"))
    text = "".join(bits)
    text += "1" * (-len(text) % 8)
    data = int(text, 2).to_bytes(len(text) // 8, "big").replace(b"\xff", b"\xff\x00")
    quant = b"".join(bytes([k]) + bytes(q.astype(np.uint8).ravel()[ZIGZAG]) for k, q in enumerate(steps[:2]))
    frame = struct.pack(">BHHB", 8, h, w, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])
    return (
        b"\xff\xd8" + _segment(0xE0, b"JFIF\0\x01\x01\0\0\x01\0\x01\0\0") + _segment(0xDB, quant) + _segment(0xC0, frame)
        + _segment(0xC4, tables) + _segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + data + b"\xff\xd9"
    )
