import numpy as np
import pytest

from tallyforge.operators.imaging import ela_signals, ela_stats, jpeg_round_trip, pixel_stats, quantisers, shrunk
from tallyforge.operators.imaging import CHROMINANCE, LUMINANCE
from tallyforge.operators.vision import vision_findings, vision_signals

ANSWERS = [
    ('{"findings": [{"code": "FONT_INCONSISTENCY", "description": "d", "confidence": 0.9}]}', [("FONT_INCONSISTENCY", 0.9)]),
    ('{"findings": [{"code": "NEW", "description": "d", "confidence": 0.9}]}', []),
    ("not json", []), ("{}", []), ('{"findings": "x"}', []), ('{"findings": {"code": "LOGO_QUALITY"}}', []), ("[1]", []), (None, []),
    ('{"findings": [1, {"code": "LOGO_QUALITY", "description": "d", "confidence": true}, {"code": "LOGO_QUALITY", "description": 1, "confidence": 1}]}', [("LOGO_QUALITY", 1.0)]),
    ('{"findings": [{"code": "PIXEL_ARTIFACTS", "description": "d", "confidence": 7}, {"code": "PIXEL_ARTIFACTS", "description": "d", "confidence": "0.9"}]}', [("PIXEL_ARTIFACTS", 1.0)]),
]


def test_findings(spark):
    df = spark.createDataFrame([(k, a) for k, (a, _) in enumerate(ANSWERS)], "id int, answer string")
    got = {}
    for r in vision_findings(df, "id", "answer").orderBy("id", "pos").collect():
        got.setdefault(r.id, []).append((r.code, r.confidence))
    assert got == {k: want for k, (_, want) in enumerate(ANSWERS) if want}
    rows = {r.id: r.vision_signals for r in vision_signals(df, "id", "answer").collect()}
    assert len(rows) == len(ANSWERS) and rows[1] == [] and rows[0][0].score == pytest.approx(0.85 * 0.9)


def _page():
    page = np.full((80, 64, 3), 255, np.uint8)
    page[4:6], page[20:60:8, 8:50] = 0, 40
    return page


def test_edited_region_stands_out(spark):
    clean = jpeg_round_trip(_page(), 90)
    edited = jpeg_round_trip(_page(), 95)
    edited[30:50, 10:40] = np.random.default_rng(1).integers(0, 256, (20, 30, 3), np.uint8)
    df = spark.createDataFrame([("clean", 80, 64, clean.tobytes()), ("edited", 80, 64, edited.tobytes()), ("broken", 80, 64, b"x"), ("none", None, 64, None)], "id string, height int, width int, pixels binary")
    got = {r.id: r for r in ela_signals(ela_stats(df, heatmap=True)).collect()}
    assert got["edited"].ela.max_intensity > got["clean"].ela.max_intensity
    assert got["clean"].ela_signals == [] and [s.code for s in got["edited"].ela_signals] == ["ELA_LOCAL_REGION_EDITED"]
    assert 0.7 <= got["edited"].ela_signals[0].confidence <= 0.92 and len(got["edited"].ela.heatmap) == 80 * 64 * 3
    assert got["broken"].ela.max_intensity is None and got["none"].ela_signals == []


def test_round_trip_is_near_and_settles():
    page = _page()
    once = jpeg_round_trip(page, 90)
    assert once.shape == page.shape and np.abs(once.astype(int) - page).mean() < 6
    assert np.abs(jpeg_round_trip(once, 90).astype(int) - once).mean() < np.abs(once.astype(int) - page).mean()
    assert jpeg_round_trip(page[:3, :5], 90).shape == (3, 5, 3)
    assert quantisers(LUMINANCE, 50)[0, 0] == 16 and quantisers(CHROMINANCE, 100).max() == 1


def test_relational_pixels(spark):
    df = spark.createDataFrame([("a", 0, 10, 3), ("a", 30, 1, 2)], "k string, r int, g int, b int")
    r = pixel_stats(df, "k").first()
    assert (r.max_intensity, r.mean_intensity, r.high_intensity_fraction) == (30, 20.0, 0.5)


def test_shrunk():
    assert shrunk(3200, 801) == (1600, 400) and shrunk(100, 90) == (100, 90)


def test_jpeg_files_are_read_by_the_image_source(spark, tmp_path):
    """What the JVM's decoder makes of our files is what the array round trip says."""
    from tallyforge.operators.jpeg import encode
    from tallyforge.sources.files import scan_images

    y, x = np.mgrid[:70, :45]
    ramp = np.stack([x * 5 % 256, y * 3, (x + y) * 2], -1).astype(np.uint8)
    noise = np.random.default_rng(3).integers(0, 256, (33, 40, 1)).astype(np.uint8).repeat(3, -1)  # grey: decoders differ in how they widen colour
    for name, image in (("ramp", ramp), ("noise", noise), ("page", _page()), ("dot", ramp[:1, :1])):
        (tmp_path / f"{name}.jpg").write_bytes(encode(image, 90))
        row = scan_images(spark, str(tmp_path / f"{name}.jpg")).first()
        got = np.frombuffer(bytes(row.pixels), np.uint8).reshape(row.height, row.width, 3)
        assert got.shape == image.shape
        assert np.abs(got.astype(int) - jpeg_round_trip(image, 90)).mean() < 4
    (tmp_path / "x.jpg").write_bytes(b"no image")
    assert scan_images(spark, str(tmp_path / "x.jpg")).first().status == "not an image"


def test_code_lengths_stay_within_sixteen_bits():
    from collections import Counter

    from tallyforge.operators.jpeg import canonical, code_lengths

    a, b, counts = 1, 1, Counter()
    for s in range(40):
        counts[s], a, b = a, b, a + b
    size = code_lengths(counts)
    assert max(size.values()) <= 16 and sum(2.0**-n for n in size.values()) < 1
    codes = canonical(size)
    assert len({format(c, f"0{n}b") for c, n in codes.values()}) == 40 and all(c != (1 << n) - 1 for c, n in codes.values())
    assert code_lengths(Counter({7: 3})) == {7: 1}


def test_data_urls(spark):
    import base64

    from tallyforge.operators.imaging import data_urls, resized

    page = _page()
    df = spark.createDataFrame([(80, 64, page.tobytes()), (1, 1, b"")], "height int, width int, pixels binary")
    one, none = (r.data_url for r in data_urls(df, most=40).collect())
    data = base64.b64decode(one.removeprefix("data:image/jpeg;base64,"))
    assert data[:2] == b"\xff\xd8" and b"\x00\x28\x00\x20" in data and none is None
    assert (resized(np.full((9, 7, 3), 80, np.uint8), 3, 4) == 80).all()
