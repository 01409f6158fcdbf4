"""Error level analysis: what a JPEG round trip changes, per image.

Entropy coding is lossless, so saving as JPEG and reading again amounts to
colour conversion, subsampling of the colour planes, and quantisation of the
8 x 8 cosine coefficients; all of it is array arithmetic over whole images.
The statistics are those of the largest channel difference of each pixel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions.text import base64_flat
from ..schema import no_signals, signal

# The quantisation tables of the JPEG standard, Annex K.
LUMINANCE = """
16 11 10 16 24 40 51 61  12 12 14 19 26 58 60 55  14 13 16 24 40 57 69 56  14 17 22 29 51 87 80 62
18 22 37 56 68 109 103 77  24 35 55 64 81 104 113 92  49 64 78 87 103 121 120 101  72 92 95 98 112 100 103 99
"""
CHROMINANCE = """
17 18 24 47 99 99 99 99  18 21 26 66 99 99 99 99  24 26 56 99 99 99 99 99  47 66 99 99 99 99 99 99
99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99  99 99 99 99 99 99 99 99
"""
TOGETHER = 1 << 20  # bytes of pixels that are worked on at once
STATS = "max_intensity int, mean_intensity double, high_intensity_fraction double, heatmap binary"


def quantisers(table: str, quality: int) -> np.ndarray:
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    base = np.array(table.split(), int).reshape(8, 8)
    return np.clip((base * scale + 50) // 100, 1, 255).astype(float)


def _cosines() -> np.ndarray:
    k, n = np.mgrid[:8, :8]
    out = np.cos((2 * n + 1) * k * np.pi / 16) / 2
    out[0] /= np.sqrt(2)
    return out


COSINES = _cosines()


def _padded(planes: np.ndarray, side: int) -> np.ndarray:
    """Planes (..., h, w) whose sides are multiples of ``side``; the edge is repeated."""
    h, w = planes.shape[-2:]
    return np.pad(planes, [(0, 0)] * (planes.ndim - 2) + [(0, -h % side), (0, -w % side)], mode="edge")


def _each_axis(tiles: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """matrix @ tile @ matrix.T for all tiles (..., 8, 8), as two products of long matrices."""
    across = (tiles.reshape(-1, 8) @ matrix.T).reshape(-1, 8, 8).swapaxes(1, 2)
    return (across.reshape(-1, 8) @ matrix.T).reshape(-1, 8, 8).swapaxes(1, 2).reshape(tiles.shape)


def coefficients(planes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    """Quantised cosine coefficients of the tiles of planes (..., h, w), as (..., rows, columns, 8, 8); the edge fills partial tiles."""
    full = _padded(planes, 8) - 128
    h, w = full.shape[-2:]
    tiles = np.ascontiguousarray(full.reshape(*full.shape[:-2], h // 8, 8, w // 8, 8).swapaxes(-3, -2))
    return np.round(_each_axis(tiles, COSINES) / steps)


def _plane(planes: np.ndarray, steps: np.ndarray) -> np.ndarray:
    h, w = planes.shape[-2:]
    tiles = _each_axis(coefficients(planes, steps) * steps, COSINES.T)
    rows, columns = tiles.shape[-4:-2]
    return tiles.swapaxes(-3, -2).reshape(*tiles.shape[:-4], 8 * rows, 8 * columns)[..., :h, :w] + 128


def luma_and_chroma(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Brightness, and blue and red differences at half the size, of images (..., h, w, 3)."""
    r, g, b = (rgb[..., k].astype(float) for k in range(3))
    y = 0.299 * r + 0.587 * g + 0.114 * b
    small = []
    for chroma in (128 + (b - y) * 0.564, 128 + (r - y) * 0.713):
        even = _padded(chroma, 2)
        h, w = even.shape[-2:]
        small.append(even.reshape(*even.shape[:-2], h // 2, 2, w // 2, 2).mean((-3, -1)))
    return y, *small


def jpeg_round_trip(rgb: np.ndarray, quality: int) -> np.ndarray:
    """Images (..., height, width, 3) as they are after saving with this quality."""
    h, w = rgb.shape[-3:-1]
    y, *chroma = luma_and_chroma(rgb)
    planes = [np.clip(np.round(_plane(y, quantisers(LUMINANCE, quality))), 0, 255)]
    for small in chroma:
        small = np.clip(np.round(_plane(small, quantisers(CHROMINANCE, quality))), 0, 255)
        planes.append(small.repeat(2, -2).repeat(2, -1)[..., :h, :w] - 128)
    y, cb, cr = planes
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], -1)
    return np.clip(np.round(out), 0, 255).astype(np.uint8)


def difference(rgb: np.ndarray, quality: int) -> np.ndarray:
    return np.abs(rgb.astype(np.int16) - jpeg_round_trip(rgb, quality)).astype(np.uint8)


def _stats(config: Config, heatmap: bool):
    """Images of one size are one array, as many of them as ``TOGETHER`` bytes of pixels hold."""

    def some(images: list[bytes], h: int, w: int) -> list[tuple]:
        diff = difference(np.frombuffer(b"".join(images), np.uint8).reshape(-1, h, w, 3), config.resave_quality)
        peak = diff.max(-1).reshape(len(images), -1)
        bright = np.minimum(255, diff * config.amplification).astype(np.uint8) if heatmap else [None] * len(images)
        numbers = zip(peak.max(1).tolist(), peak.mean(1).tolist(), (peak >= config.pixel_threshold).mean(1).tolist(), bright, strict=True)
        return [(top, mean, part, None if x is None else x.tobytes()) for top, mean, part, x in numbers]

    def run(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for pixels, heights, widths in frames:
            rows, sizes = [(None,) * 4] * len(pixels), {}
            data = pixels.tolist()
            for k, (d, h, w) in enumerate(zip(data, heights, widths, strict=True)):
                if d is not None and h and w and len(d) == 3 * h * w:
                    sizes.setdefault((int(h), int(w)), []).append(k)
            for (h, w), own in sizes.items():
                step = max(1, TOGETHER // (3 * h * w))
                for at in range(0, len(own), step):
                    part = own[at : at + step]
                    for k, row in zip(part, some([data[k] for k in part], h, w), strict=True):
                        rows[k] = row
            yield pd.DataFrame(rows, columns=[p.split()[0] for p in STATS.split(", ")])

    return run


def ela_stats(df: DataFrame, pixels: str = "pixels", height: str = "height", width: str = "width", out: str = "ela", config: Config = DEFAULT, heatmap: bool = False) -> DataFrame:
    """``df`` with the statistics of each image (RGB bytes, row by row); null where the size doesn't fit."""
    udf = F.pandas_udf(_stats(config, heatmap), STATS)
    return df.withColumn(out, udf(F.col(pixels), F.col(height).cast("int"), F.col(width).cast("int")))


def pixel_stats(pixels: DataFrame, key: str, config: Config = DEFAULT) -> DataFrame:
    """The same statistics from rows (key, r, g, b) of differences."""
    v = F.greatest("r", "g", "b")
    return pixels.groupBy(key).agg(
        F.max(v).alias("max_intensity"), F.avg(v.cast("double")).alias("mean_intensity"), F.avg(F.when(v >= config.pixel_threshold, 1.0).otherwise(0.0)).alias("high_intensity_fraction")
    )


def ela_confidence(fraction: Column, peak: Column, config: Config = DEFAULT) -> Column:
    return F.least(F.lit(0.92), F.lit(0.50) + fraction * 5 + (peak - config.ela_peak) / F.lit(350.0))


def ela_signals(df: DataFrame, stats: str = "ela", out: str = "ela_signals", config: Config = DEFAULT) -> DataFrame:
    """``df`` with one signal where many pixels changed and the peak is high."""
    s = F.col(stats)
    fraction, peak, mean = s["high_intensity_fraction"], s["max_intensity"], s["mean_intensity"]
    text = F.format_string("A region differs after saving again: %.1f %% of the pixels, peak %d of 255", fraction * 100, peak)
    one = signal("ELA_LOCAL_REGION_EDITED", text, 0, ela_confidence(fraction, peak, config), high_intensity_fraction=F.round(fraction, 4), max_intensity=peak, mean_intensity=F.round(mean, 3))
    hit = (fraction >= config.ela_fraction) & (peak >= config.ela_peak)
    return df.withColumn(out, F.when(F.coalesce(hit, F.lit(False)), F.array(one)).otherwise(no_signals()))


def shrunk(width: int, height: int, most: int = 1600) -> tuple[int, int]:
    """The size of an image brought down to ``most`` pixels at its longer side."""
    longest = max(width, height)
    return (width, height) if longest <= most else (int(width * most / longest), int(height * most / longest))


def resized(rgb: np.ndarray, width: int, height: int) -> np.ndarray:
    """The image at another size, by Lanczos weights of three lobes along each axis."""

    def weights(old: int, new: int) -> np.ndarray:
        scale = max(1.0, old / new)
        centre = (np.arange(new) + 0.5) * old / new - 0.5
        x = (np.arange(old)[None, :] - centre[:, None]) / scale
        out = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
        return out / out.sum(1, keepdims=True)

    h, w, _ = rgb.shape
    across = np.einsum("nw,hwc->hnc", weights(w, width), rgb.astype(float))
    return np.clip(np.round(np.einsum("mh,hnc->mnc", weights(h, height), across)), 0, 255).astype(np.uint8)


def data_urls(df: DataFrame, pixels: str = "pixels", height: str = "height", width: str = "width", out: str = "data_url", most: int = 1600, quality: int = 85) -> DataFrame:
    """``df`` with each image as a JPEG data URL, its longer side at most ``most`` pixels; null where the size doesn't fit."""
    from .jpeg import encode

    def run(frames: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for data, heights, widths in frames:
            made = []
            for d, h, w in zip(data, heights, widths, strict=True):
                if d is None or not h or not w or len(d) != 3 * h * w:
                    made.append(None)
                    continue
                image = np.frombuffer(d, np.uint8).reshape(int(h), int(w), 3)
                size = shrunk(int(w), int(h), most)
                made.append(encode(image if size == (w, h) else resized(image, *size), quality))
            yield pd.Series(made, dtype="object")

    jpeg = F.pandas_udf(run, "binary")(F.col(pixels), F.col(height).cast("int"), F.col(width).cast("int"))
    return df.withColumn(out, jpeg).withColumn(out, F.concat(F.lit("data:image/jpeg;base64,"), base64_flat(F.col(out))))
