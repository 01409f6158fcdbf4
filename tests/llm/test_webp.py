"""The decoder against images written bit by bit with every feature of the format."""

import random
import struct

import random
from collections import Counter

import numpy as np
import pytest

from tallyforge.llm import lanes, webp


class Writer(webp.BitWriter):
    """Writes prefix codes and what they encode."""

    def code(self, lengths):
        """A code by its lengths, each length with four or five plain bits."""
        used = [k for k, n in enumerate(lengths) if n]
        if len(used) <= 2 and all(k < 256 for k in used) and all(lengths[k] == 1 for k in used):
            self.put(1, 1)
            self.put(len(used) - 1, 1)
            self.put(1, 1)
            for k in used:
                self.put(k, 8)
            return
        self.put(0, 1)
        self.put(15, 4)
        for k in webp.LENGTH_ORDER:
            self.put(4 if k < 16 else 0, 3)
        self.put(0, 1)
        for n in lengths:
            self.turned(n, 4)

    def turned(self, value, n):
        for b in range(n - 1, -1, -1):
            self.put(value >> b & 1, 1)

    def symbol(self, lengths, s):
        if sum(1 for n in lengths if n) == 1:
            return
        at, code = 0, {}
        for n in range(1, 16):
            at <<= 1
            for k, m in enumerate(lengths):
                if m == n:
                    code[k] = at
                    at += 1
        self.turned(code[s], lengths[s])


def lengths_of(symbols, size):
    """A complete code over some symbols, of uneven lengths."""
    used = sorted(set(symbols)) or [0]
    out = [0] * size
    if len(used) == 1:
        out[used[0]] = 1
        return out
    n = (len(used) - 1).bit_length()
    short = (1 << n) - len(used)
    for k, s in enumerate(used):
        out[s] = n - 1 if k < short else n
    return out


def prefix(value):
    """(symbol, extra bits, their number) of a length or distance."""
    if value <= 4:
        return value - 1, 0, 0
    v = value - 1
    top = v.bit_length() - 1
    second = v >> (top - 1) & 1
    more = top - 1
    return 2 * top + second, v & ((1 << more) - 1), more


def put_pixels(w, tokens, cache_bits, top):
    """tokens: ("p", a, r, g, b), ("b", length, distance code) or ("c", cache index)."""
    w.put(1 if cache_bits else 0, 1)
    if cache_bits:
        w.put(cache_bits, 4)
    if top:
        w.put(0, 1)
    green = [t[3] if t[0] == "p" else 256 + prefix(t[1])[0] if t[0] == "b" else 280 + t[1] for t in tokens]
    sizes = [280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40]
    fill = [green, *([t[k] for t in tokens if t[0] == "p"] for k in (2, 4, 1)), [prefix(t[2])[0] for t in tokens if t[0] == "b"]]
    codes = [lengths_of(s, n) for s, n in zip(fill, sizes, strict=True)]
    for c in codes:
        w.code(c)
    for t, g in zip(tokens, green, strict=True):
        w.symbol(codes[0], g)
        if t[0] == "p":
            w.symbol(codes[1], t[2])
            w.symbol(codes[2], t[4])
            w.symbol(codes[3], t[1])
        elif t[0] == "b":
            _, extra, n = prefix(t[1])
            w.put(extra, n)
            s, extra, n = prefix(t[2])
            w.symbol(codes[4], s)
            w.put(extra, n)


def image(width, height, body, alpha=1):
    w = Writer()
    for v, n in ((0x2F, 8), (width - 1, 14), (height - 1, 14), (alpha, 1), (0, 3)):
        w.put(v, n)
    body(w)
    data = w.value.to_bytes((w.n + 7) // 8, "little")
    pad = b"\0" * (len(data) & 1)
    return b"RIFF" + struct.pack("<I", 12 + len(data) + len(pad)) + b"WEBPVP8L" + struct.pack("<I", len(data)) + data + pad


def argb(p):
    return p[1] << 24 | p[2] << 16 | p[3] << 8 | p[4]


def noise(n, seed, most=256):
    rng = random.Random(seed)
    return [("p", rng.randrange(most), rng.randrange(most), rng.randrange(most), rng.randrange(most)) for _ in range(n)]


def literal(tokens):
    return np.array([argb(t) for t in tokens], np.uint32)


def plain(w, tokens, cache=0):
    w.put(0, 1)
    put_pixels(w, tokens, cache, True)


def test_literals_with_uneven_codes():
    t = noise(60, 1, 11)
    assert (webp.decode_argb(image(10, 6, lambda w: plain(w, t))).ravel() == literal(t)).all()


def test_back_references_near_and_far():
    t = noise(20, 2, 5)
    tokens = [*t, ("b", 7, 1), ("b", 13, 120 + 9), ("b", 20, 2)]  # one row up; nine back; one back
    out = literal(t).tolist()
    for length, back in ((7, 10), (13, 9), (20, 1)):
        for _ in range(length):
            out.append(out[-back])
    assert webp.decode_argb(image(10, 6, lambda w: plain(w, tokens))).ravel().tolist() == out


def test_near_distances_are_all_different():
    assert len(set(webp.NEAR)) == 120 and webp.NEAR[:6] == [(0, 1), (1, 0), (1, 1), (-1, 1), (0, 2), (2, 0)] and webp.NEAR[-1] == (8, 7)


def test_colour_cache():
    t, bits = noise(12, 3, 256), 4
    cache, tokens, out = {}, [], []
    for k, p in enumerate(t * 3):
        v = argb(p)
        slot = (v * webp.CACHE_MULTIPLIER & 0xFFFFFFFF) >> (32 - bits)
        tokens.append(("c", slot) if k >= 12 and cache.get(slot) == v else p)
        cache[slot] = v
        out.append(v)
    assert any(x[0] == "c" for x in tokens)
    assert webp.decode_argb(image(9, 4, lambda w: plain(w, tokens, bits))).ravel().tolist() == out


def test_meta_codes_choose_by_block():
    a, b = noise(16, 4, 3), noise(16, 5, 200)
    rows = [x for y in range(4) for x in (*a[4 * y : 4 * y + 4], *b[4 * y : 4 * y + 4])]

    def body(w):
        w.put(0, 1)
        w.put(0, 1)
        w.put(1, 1)
        w.put(0, 3)
        put_pixels(w, [("p", 0, 0, 0, 0), ("p", 0, 0, 1, 0)], 0, False)
        groups = [[lengths_of([t[k] for t in part], n) for k, n in ((3, 280), (2, 256), (4, 256), (1, 256))] + [lengths_of([], 40)] for part in (a, b)]
        for g in groups:
            for c in g:
                w.code(c)
        for k, t in enumerate(rows):
            for c, i in zip(groups[k % 8 // 4], (3, 2, 4, 1), strict=False):
                w.symbol(c, t[i])

    assert (webp.decode_argb(image(8, 4, body)).ravel() == literal(rows)).all()


def channels(p):
    return [p >> s & 255 for s in (24, 16, 8, 0)]


@pytest.mark.parametrize("mode", range(14))
def test_predictor(mode):
    width, height = 6, 5
    want = [channels(int(v)) for v in literal(noise(width * height, 6 + mode))]
    avg = lambda p, q: [(x + y) // 2 for x, y in zip(p, q, strict=True)]

    def guess(k):
        x, y = k % width, k // width
        if not k:
            return [255, 0, 0, 0]
        if not y:
            return want[k - 1]
        if not x:
            return want[k - width]
        lf, t, tl, tr = want[k - 1], want[k - width], want[k - width - 1], want[k - width + 1]
        if mode == 11:
            dl = sum(abs(a + b - c - a) for a, b, c in zip(lf, t, tl, strict=True))
            dt = sum(abs(a + b - c - b) for a, b, c in zip(lf, t, tl, strict=True))
            return lf if dl < dt else t
        if mode == 12:
            return [min(255, max(0, a + b - c)) for a, b, c in zip(lf, t, tl, strict=True)]
        if mode == 13:
            return [min(255, max(0, m + int((m - c) / 2))) for m, c in zip(avg(lf, t), tl, strict=True)]
        return [[255, 0, 0, 0], lf, t, tr, tl, avg(avg(lf, tr), t), avg(lf, tl), avg(lf, t), avg(tl, t), avg(t, tr), avg(avg(lf, tl), avg(t, tr))][mode]

    rest = [("p", *((a - b) & 255 for a, b in zip(want[k], guess(k), strict=True))) for k in range(width * height)]

    def body(w):
        w.put(1, 1)
        w.put(0, 2)
        w.put(1, 3)
        put_pixels(w, [("p", 0, 0, mode, 0)], 0, False)
        plain(w, rest)

    assert [channels(v) for v in webp.decode_argb(image(width, height, body)).ravel().tolist()] == want


def test_cross_colour_green_and_opaque():
    want = noise(24, 40)
    s8 = lambda v: v - 256 if v > 127 else v
    g2r, g2b, r2b = 200, 31, 77
    rest = []
    for _, a, r, g, b in want:
        red = r - (s8(g2r) * s8(g) >> 5) & 255
        blue = b - (s8(g2b) * s8(g) >> 5) - (s8(r2b) * s8(r) >> 5) & 255
        rest.append(("p", a, red - g & 255, g, blue - g & 255))

    def body(w):
        w.put(1, 1)
        w.put(1, 2)
        w.put(3, 3)
        put_pixels(w, [("p", 255, r2b, g2b, g2r)], 0, False)
        w.put(1, 1)
        w.put(2, 2)
        plain(w, rest)

    assert (webp.decode_argb(image(6, 4, body)).ravel() == literal(want)).all()
    assert (webp.decode_argb(image(6, 4, body, alpha=0)).ravel() == literal([("p", 255, *p[2:]) for p in want])).all()


@pytest.mark.parametrize(("colours", "bits"), [(2, 1), (4, 2), (16, 4), (40, 8)])
def test_palette(colours, bits):
    width, height = 11, 3
    palette, rng = [channels(int(v)) for v in literal(noise(colours, 50))], random.Random(7)
    index = [[rng.randrange(colours) for _ in range(width)] for _ in range(height)]
    steps = [("p", *((x - y) & 255 for x, y in zip(p, q, strict=True))) for p, q in zip(palette, [[0] * 4, *palette], strict=False)]
    per, packed = 8 // bits, []
    for row in index:
        for at in range(0, width, per):
            packed.append(("p", 255, 0, sum(v << (bits * k) for k, v in enumerate(row[at : at + per])), 0))

    def body(w):
        w.put(1, 1)
        w.put(3, 2)
        w.put(colours - 1, 8)
        put_pixels(w, steps, 0, False)
        plain(w, packed)

    assert [channels(v) for v in webp.decode_argb(image(width, height, body)).ravel().tolist()] == [palette[k] for row in index for k in row]


def test_length_codes_with_repeats():
    """Lengths written with the run symbols 16, 17 and 18."""
    w = Writer()
    w.put(0, 1)
    w.put(15, 4)
    sizes = {2: 2, 16: 2, 17: 2, 18: 2}
    for k in webp.LENGTH_ORDER:
        w.put(sizes.get(k, 0), 3)
    w.put(0, 1)
    own = [sizes.get(k, 0) for k in range(19)]
    for s, extra, n in ((18, 20 - 11, 7), (2, 0, 0), (16, 0, 2), (17, 3, 3), (18, 127, 7), (18, 256 - 30 - 138 - 11, 7)):
        w.symbol(own, s)
        w.put(extra, n)
    code = webp.read_code(webp.Bits(w.value.to_bytes((w.n + 7) // 8, "little")), 256)
    assert code.symbols.tolist() == [20, 21, 22, 23] and code.even == 2


ROW = lanes.ROW


def payloads():
    rng = random.Random(1)
    same = lambda make: bytes(x for _ in range(64 * 9) for x in make())
    return {
        "spaces": b" " * ROW, "one colour": b"a" * ROW * 3, "period": (b"abcabcabd" * 5000)[: ROW * 40], "letters": bytes(rng.choice(b"abcdefgh ") for _ in range(ROW * 70)),
        "bytes": bytes(rng.randrange(256) for _ in range(ROW * 5)), "ramp": bytes((7 * k + 3 * j + j * j % 3) % 256 for k in range(20) for j in range(ROW)),
        "grey": same(lambda: [rng.randrange(30, 200)] * 3), "red is green": same(lambda: [v := rng.randrange(256), v, rng.randrange(8)]),
        "blue is red": same(lambda: [v := rng.randrange(256), rng.randrange(8), v]), "blue is green": same(lambda: [rng.randrange(8), v := rng.randrange(256), v]),
        "walk": np.cumsum(np.random.default_rng(2).integers(-1, 2, (64 * 16, 3)), 0).astype(np.uint8).tobytes(),
        "rows": np.cumsum(np.random.default_rng(3).integers(-1, 2, (16, ROW)) + np.arange(ROW) * 37 * (np.arange(16) == 0)[:, None], 0).astype(np.uint8).tobytes(),
        "words": b" ".join(rng.choice([b"lorem", b"ipsum", b"dolor", b"sit", b"amet"]) for _ in range(9000))[: ROW * 33],
        "long codes": b"".join(bytes([k]) * (1 << max(0, 11 - k)) for k in range(60))[: ROW * 21],
    }


def test_encoder_features_and_both_decoders():
    """Every feature occurs, and what the lanes read is what the decoder of single images reads."""
    own = payloads()
    features = Counter()
    files = lanes.encode(list(own.values()), features)
    assert {"copies", "near", "cache", "palette", "predictor", "cross", "green", "plain"} <= set(features)
    for (name, payload), data, got in zip(own.items(), files, lanes.decode(files), strict=True):
        assert got.tobytes() == payload, name
        if len(payload) <= lanes.FRAME * ROW:
            argb = webp.decode_argb(data)
            assert np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255], -1).astype(np.uint8).tobytes() == payload, name
    assert [lanes.encode([p])[0] for p in own.values()] == files  # a file hangs on its payload alone


def test_each_transform_is_taken_where_it_shrinks():
    own = payloads()
    for name, feature in (("grey", "green"), ("red is green", "cross"), ("blue is red", "cross"), ("blue is green", "cross"), ("walk", "predictor"), ("rows", "predictor"), ("words", "palette")):
        seen = Counter()
        lanes.encode([own[name][: lanes.FRAME * ROW]], seen)
        assert seen[feature] == 1, name


def test_lanes_read_what_others_write():
    """Files of the writer above: uneven codes, copies, a cache; alone and beside others."""
    rng = np.random.default_rng(5)
    tokens = noise(60, 3, 40)
    first = image(10, 6, lambda w: plain(w, tokens))
    groups = lanes.encode([bytes(rng.integers(97, 123, ROW * 4, np.uint8))])
    got = lanes.decode([first, *groups])
    argb = webp.decode_argb(first)
    assert (got[0] == np.stack([argb >> 16 & 255, argb >> 8 & 255, argb & 255], -1)).all()


def test_codes_are_complete_and_fit_the_counts():
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 100, (50, 300)) * (rng.random((50, 300)) < rng.random((50, 1)))
    counts[0], counts[1, :] = 0, 0
    counts[1, 7] = 5
    lengths = lanes.code_lengths(counts)
    assert ((lengths > 0) == (counts > 0)).all() and lengths[1, 7] == 1
    busy = (counts > 0).sum(1) > 1
    counts, lengths = counts[busy], lengths[busy]
    assert len(counts) > 40 and (np.where(lengths > 0, 0.5**lengths, 0).sum(1) == 1).all() and lengths.max() <= 15
    p = counts / counts.sum(1, keepdims=True)
    entropy = -(p * np.log2(np.maximum(p, 1e-12))).sum(1)
    assert ((lengths * p).sum(1) <= entropy + 1).all()
    assert (0.5 ** lanes.LENGTH_CODE[lanes.LENGTH_CODE > 0].astype(float)).sum() == 1


def test_features_occur_in_documents(sf_dir):
    import pyarrow.parquet as pq

    texts = [(t or "").encode() for t in pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()]
    seen = Counter()
    own = [t + b" " * (-len(t) % ROW or (0 if t else ROW)) for t in texts]
    files = lanes.encode(own, seen)
    assert [x.tobytes() for x in lanes.decode(files)] == own
    assert seen["copies"] > 0.9 * seen["frames"] and seen["near"] > 0 and seen["cache"] > 0.5 * seen["frames"] and seen["palette"] > 0
    assert sum(map(len, files)) < 0.6 * sum(map(len, own))


def test_broken_images():
    good = lanes.encode([b"some text " * 19 + b"  "])[0]
    for bad in (good[:30], good[:-8], b"RIFF" + good[4:8] + b"WAVE" + good[12:], b""):
        with pytest.raises((ValueError, IndexError)):
            lanes.decode([bad[:4] + len(bad).to_bytes(4, "little") + bad[8:] if bad else bad])
    with pytest.raises(ValueError):
        lanes.encode([b"x" * 100])
    with pytest.raises(ValueError):
        webp.Code(np.array([1, 1, 1], np.int8))
