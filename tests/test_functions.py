import difflib
import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import SelectConfig, ablations
from tessera.functions import pixels, scores, text, vectors


def one(spark, **cols):
    return spark.range(1).select(*[c.alias(n) for n, c in cols.items()]).first()


@pytest.mark.parametrize("given", ["", ":", "7:", ":7", "x", "3:y", "4:4:4:4", "-8", "1e3", None])
def test_what_is_no_time(spark, given):
    assert one(spark, x=text.parse_time(F.lit(given).cast("string"))).x is None


def test_times_are_read_as_they_are_written(spark):
    draw = np.random.default_rng(17)
    for seconds in [0, 59, 60, 3599, 3600, *draw.integers(0, 40_000, 6).tolist()]:
        row = one(spark, shown=text.format_time(F.lit(seconds + 0.4)), bare=text.parse_time(F.lit(f" {seconds}.25 ")))
        parts = [int(x) for x in row.shown.split(":")]
        assert sum(x * 60**k for k, x in enumerate(reversed(parts))) == seconds and all(x < 60 for x in parts[1:])
        assert len(parts) == (3 if seconds >= 3600 else 2) and all(len(x) == 2 for x in row.shown.split(":")[1:])
        assert one(spark, x=text.parse_time(F.lit(row.shown))).x == seconds
        assert row.bare == seconds + 0.25


def test_normalize(spark):
    draw = random.Random(23)
    assert text.normalize(None) == text.normalize("") == text.normalize(" .,-!") == ""
    for _ in range(20):
        plain = "".join(draw.choices("ABCXYZ0189", k=9))
        marked = "".join(draw.choice((c, c.lower(), c + "\u0301", " " + c, chr(ord(c) + 0xFEE0))) for c in plain)  # accents, spaces, full width
        assert text.normalize(marked) == plain
        assert one(spark, a=text.normalize_text(F.lit(marked)), b=text.normalize_ascii(F.lit(plain.lower() + "-"))) == (plain, plain)
    block = chr(draw.randint(0xAC00, 0xD7A3))
    assert text.normalize(block) == unicodedata.normalize("NFD", block)  # syllables are compared by their letters
    assert text.normalize("\u3131") == "\u1100"  # and letters that stand alone alike


def test_best_ratio_against_all_windows(spark):
    draw = random.Random(29)
    for _ in range(60):
        alphabet = draw.choice(("AB", "ABCDEFGH", "\u1100\u1161\u11a8A"))
        needle, hay = ("".join(draw.choices(alphabet, k=draw.randint(0, m))) for m in (9, 30))
        ratios = [difflib.SequenceMatcher(None, hay[i : i + len(needle)], needle, autojunk=False).ratio() for i in range(len(hay) - len(needle) + 1)] if needle else []
        assert text.best_ratio(hay, needle) == max(ratios, default=0.0)
        if needle and hay:
            assert one(spark, x=text.is_readable(F.lit(hay), F.lit(needle), 0.7)).x == (max(ratios, default=0.0) >= 0.7) if draw.random() < 0.1 else True


def test_video_ids_and_names(spark):
    draw = random.Random(31)
    for form in ("https://youtu.be/{}", "youtu.be/{}?t=4", "seen at http://m.youtube.com/live/{}.", "www.youtube.com/watch?a=b&v={}&c=d", "youtube.com/embed/{}", "youtube.com/shorts/{}x"):
        key = "".join(draw.choices("abzXYZ059_-", k=11))
        assert one(spark, x=text.youtube_id(F.lit(form.format(key)))).x == key
    for other in ("https://video.example/watch?v=abcdefghijk", "youtu.be/short", "youtube.com/watch?w=abcdefghijk", ""):
        assert one(spark, x=text.youtube_id(F.lit(other))).x is None
    row = one(spark, a=text.is_key(F.lit("k7-x")), b=text.is_key(F.lit("-k7")), c=text.language_code(F.lit("jpn")), d=text.language_code(F.lit("none")), e=text.clip_name(F.lit(3.9), F.lit(40)), f=text.clip_name(F.lit(None), F.lit(40)))
    assert tuple(row) == (True, False, "ja", None, "clip_3-40.mp4", "source.mp4")


def test_guard_gap_and_expectation(spark):
    guard = [one(spark, x=scores.keeps_enhanced(F.lit(c), F.lit(0.5), limit)).x for c, limit in ((0.4, 0.05), (0.46, 0.05), (0.5, 0.0), (0.49, 0.0))]
    assert guard == [False, True, True, False]
    assert [one(spark, x=scores.nms_gap(F.lit(n), budget)).x for n, budget in ((1000, 10), (7, 4), (0, 4))] == [50, 0, 0]
    for n, m, k in ((12, 2, 4), (9, 9, 1), (6, 4, 5), (0, 0, 3)):
        drawn = list(itertools.combinations(range(n), min(k, n)))
        want = sum(any(x < m for x in d) for d in drawn) / len(drawn) if n else 0.0
        assert one(spark, x=scores.random_hit(F.lit(n), F.lit(m), k)).x == pytest.approx(want)


def test_vectors(spark):
    v = F.array(*[F.lit(x) for x in (3.0, 4.0)])
    row = one(spark, n=vectors.l2_normalize(v), z=vectors.l2_normalize(F.array(F.lit(0.0))), w=vectors.weighted_concat([(v, 3.0), (v, 1.0)]))
    assert row.n == pytest.approx([0.6, 0.8]) and row.z == [0.0]
    assert sum(x * x for x in row.w) == pytest.approx(1.0)


def test_config():
    assert set(ablations(SelectConfig())) == {"full", "no-enhance", "no-rescue", "text-det", "no-dedup"}
    with pytest.raises(ValueError, match="selection_strategy"):
        SelectConfig(selection_strategy="x")
    assert SelectConfig().bound_to(0.88, 0.95).scene_similarity_threshold == 0.88


def picture(seed=7, size=(120, 160)):
    rng = np.random.default_rng(seed)
    img = np.full((*size, 3), 110, np.uint8)
    for _ in range(20):
        y, x = rng.integers(0, size[0] - 20), rng.integers(0, size[1] - 30)
        img[y : y + rng.integers(5, 20), x : x + rng.integers(5, 30)] = rng.integers(0, 255, 3)
    return img


def test_pixel_metrics():
    img = picture()
    soft = np.stack([pixels.gaussian(img[..., c], 2) for c in range(3)], axis=-1).astype(np.uint8)
    gray, blur = pixels.to_gray(img), pixels.to_gray(soft)
    assert pixels.sharpness_lapvar(gray) > pixels.sharpness_lapvar(blur)
    assert pixels.sharpness_tenengrad(gray) > pixels.sharpness_tenengrad(blur)
    flat = np.full((60, 80), 128, np.uint8)
    assert pixels.sharpness_lapvar(flat) == pixels.noise_sigma(flat) == pixels.noise_sigma(np.zeros((2, 2), np.uint8)) == 0
    noisy = np.clip(128 + np.random.default_rng(0).normal(0, 10, (200, 200)), 0, 255).astype(np.uint8)
    assert 8 < pixels.noise_sigma(noisy) < 12
    assert pixels.exposure(np.zeros((9, 9), np.uint8))[:3] == (0.0, 1.0, 0.0)
    assert pixels.exposure(np.full((9, 9), 255, np.uint8))[:3] == (1.0, 0.0, 1.0)
    assert pixels.colorfulness(np.full((9, 9, 3), 90, np.uint8)) == 0 < pixels.colorfulness(img)


def test_restoration():
    img = picture()
    cast = np.clip(img * np.array([1.6, 1.0, 0.7]), 0, 255).astype(np.uint8)
    assert np.ptp(pixels.white_balance(cast)[0].reshape(-1, 3).mean(axis=0)) < np.ptp(cast.reshape(-1, 3).mean(axis=0))
    dark = (img * 0.15).astype(np.uint8)
    assert pixels.to_gray(pixels.adaptive_gamma(dark)[0]).mean() > pixels.to_gray(dark).mean()
    out, stages = pixels.rescue(dark)
    assert stages[-1] == "clahe" and out.shape == img.shape and pixels.to_gray(out).mean() > pixels.to_gray(dark).mean()
    noisy = np.clip(img * 0.3 + np.random.default_rng(3).normal(0, 8, img.shape), 0, 255).astype(np.uint8)
    assert "denoise" in pixels.enhance(noisy, 1.0)[1] and "denoise" not in pixels.enhance(img, 1.0)[1]
    assert (pixels.unsharp(img, amount=0) == img).all()


def test_embedding_and_boxes(spark):
    a, b = picture(1), picture(2)
    near = np.roll(a, 1, axis=1)
    ea, eb, en = pixels.embed(a), pixels.embed(b), pixels.embed(near)
    assert ea.shape == (319,) and np.linalg.norm(ea) == pytest.approx(1)
    assert ea @ en > ea @ eb
    assert pixels.hsv_histogram(a).sum() == pytest.approx(1)
    assert pixels.union_area([(0, 0, 4, 4), (2, 2, 4, 4), (10, 0, 1, 1)]) == 29
    rows = spark.createDataFrame([(120, 160, bytearray(a.tobytes()))], "h int, w int, d binary")
    got = rows.select(pixels.frame_metrics("h", "w", "d").alias("m"), pixels.frame_embedding("h", "w", "d").alias("e")).first()
    assert got.m.lapvar == pytest.approx(pixels.metrics(a)["lapvar"]) and len(got.e) == 319
