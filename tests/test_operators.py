import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.config import SelectConfig
from tessera.operators import gate, recall, sequence
from tessera.plans.select import select_keyframes
from tessera.sources import frames as sampling
from tessera.sources import sinks, truth


def chain(cosines):
    angle = np.concatenate([[0], np.cumsum(np.arccos(cosines))])
    return np.stack([np.cos(angle), np.sin(angle)], axis=1)


def frame(spark, vectors, t=None, score=None):
    rows = [(1, i, float(i if t is None else t[i]), [float(x) for x in v], float(0 if score is None else score[i])) for i, v in enumerate(vectors)]
    return spark.createDataFrame(rows, "video_id long, frame_index long, t double, embedding array<float>, score double")


def test_adaptive_threshold(spark):
    rng = np.random.default_rng(41)
    for n in (2, 3, 4, 9, 13):
        sims = rng.uniform(0.1, 0.99, n)
        made = sequence.adaptive_threshold(sequence.adjacent_similarity(frame(spark, chain(sims))), 0.6).first().threshold
        want = min(0.6, sorted(sims)[int((n - 1) * 0.25)]) if n >= 4 else 0.6
        assert made == pytest.approx(want, abs=1e-6)


def shots_of(spark, vectors, gap, thr=0.9):
    rows = sequence.segment(sequence.adjacent_similarity(frame(spark, vectors)), F.lit(thr), gap).orderBy("frame_index").collect()
    return [r.shot_id for r in rows]


def test_segments(spark):
    two = [(1, 0)] * 4 + [(0, 1)] * 4
    assert shots_of(spark, two, 1.0) == [0] * 4 + [1] * 4
    assert shots_of(spark, two, 10.0) == [0] * 8
    flips = [(1, 0), (0, 1)] * 4
    assert shots_of(spark, flips, 2.0) == [0, 0, 1, 1, 2, 2, 3, 3]  # the start moves only at a cut


def test_greedy_and_center_and_spaced():
    a, b = np.array([1.0, 0.0]), np.array([0.0, 1.0])
    assert sequence.greedy_keep(np.stack([a, a, a]), 0.95).tolist() == [0]
    assert sequence.greedy_keep(np.stack([a, b, a]), 0.95).tolist() == [0, 1]
    assert 3 in sequence.k_center(np.stack([a, a, a, b]), np.array([0.9, 0.85, 0.8, 0.2]), 2)
    assert sequence.k_center(np.stack([a, b]), np.zeros(2), 5).tolist() == [0, 1] and sequence.k_center(np.stack([a]), np.zeros(1), 0).tolist() == []
    with pytest.raises(ValueError, match="length"):
        sequence.spaced(np.arange(2), np.ones(1), 1, 0)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.floats(-1, 1), st.floats(-1, 1)), min_size=1, max_size=25), st.floats(-0.9, 0.99), st.integers(0, 8))
def test_sequence_operators_against_naive_models(vectors, threshold, budget):
    m = np.array(vectors)
    kept = []
    for i in range(len(m)):
        if all(float(m[j] @ m[i]) < threshold for j in kept):
            kept.append(i)
    assert sequence.greedy_keep(m, threshold).tolist() == kept
    score = m[:, 0]
    if budget < len(m):
        chosen = [int(np.argmax(score))] if budget else []
        while len(chosen) < budget:
            rest = [i for i in range(len(m)) if i not in chosen]
            chosen.append(min(rest, key=lambda i: (max(float(m[j] @ m[i]) for j in chosen), -score[i], i)))
    else:
        chosen = range(len(m))
    assert sequence.k_center(m, score, budget).tolist() == sorted(chosen)
    taken = []
    for i in sorted(range(len(m)), key=lambda i: (-score[i], i)):
        if len(taken) < budget and all(abs(i - x) > 2 for x in taken):
            taken.append(i)
    assert sequence.spaced(np.arange(len(m)), score, budget, 2).tolist() == sorted(taken)


def frames(spark, rows):
    cols = "video_id long, frame_index long, t double, lapvar double, luma double, clip_low double, clip_high double, rms double, noise double, colorfulness double, textness double, rescued boolean, embedding array<float>, text_boxes int"
    return spark.createDataFrame([(v, i, t, lap, luma, low, high, 0.2, 1.0, 30.0, 0.5, r, [float(x) for x in e], b) for v, i, t, lap, luma, low, high, r, e, b in rows], cols)


def test_gate_order_and_last_resort(spark):
    e = (1, 0)
    rows = [(1, 0, 0.0, 100.0, 0.5, 0.0, 0.0, False, e, 1), (1, 1, 1.0, 100.0, 0.05, 0.0, 0.9, False, e, 1), (1, 2, 2.0, 100.0, 0.5, 0.0, 0.4, False, e, 1), (1, 3, 3.0, 7.0, 0.5, 0.3, 0.3, False, e, 1), (1, 4, 4.0, 40.0, 0.5, 0.0, 0.0, False, e, 1), (2, 0, 0.0, 1.0, 0.5, 0.0, 0.0, False, e, 1), (2, 1, 1.0, 2.0, 0.01, 0.0, 0.0, True, e, 1)]
    made = {(r.video_id, r.frame_index): r.reason for r in gate.gate(frames(spark, rows), SelectConfig()).collect()}
    assert [made[1, i] for i in range(5)] == [None, "underexposed", "overexposed", "blur", "blur"]
    assert (made[2, 0], made[2, 1]) == ("blur", None)
    assert gate.gate(frames(spark, rows), SelectConfig(), last_resort=False).where("video_id = 2 and reason is null").count() == 0


def test_selection_counts(spark):
    rows = []
    for i in range(24):
        angle = (i // 4) * 0.9
        rows.append((1, i, i * 1.0, 100.0 + i % 3, 0.5, 0.0, 0.0, False, (np.cos(angle), np.sin(angle)), i % 5))
    cfg = SelectConfig(max_keyframes=3)
    made = select_keyframes(frames(spark, rows), cfg)
    assert made.shots.select("shot_id").distinct().count() == 6
    assert made.keyframes.count() == 3
    assert made.rejected.where("reason = 'budget'").count() == 3
    total = made.summary.first()
    assert (total.decoded, total.after_gate, total.shots, total.selected) == (24, 24, 6, 3)
    spaced = select_keyframes(frames(spark, rows), SelectConfig(max_keyframes=3, selection_strategy="text_nms"))
    picks = sorted(r.frame_index for r in spaced.keyframes.collect())
    assert len(picks) == 3 and min(np.diff(picks)) > 4


def test_first_place_and_windows(spark):
    f = spark.createDataFrame([(1, i, float(i)) for i in range(6)], "video_id long, frame_index long, t double")
    s = spark.createDataFrame([(1, "b", 2, 0.0, 3.0), (1, "a", 1, 3.0, 4.0)], "video_id long, place_id string, place_order int, start double, end double")
    assert [r.place_id for r in recall.first_place(f, s).orderBy("t").collect()] == ["b", "b", "b", "a", "a", None]
    d = spark.createDataFrame([(1, 100.0)], "video_id long, duration double")
    places = spark.createDataFrame([(1, "x", 10.0, 20.0), (1, "y", 15.0, 25.0), (1, "z", 70.0, 71.0)], "video_id long, place_id string, start double, end double")
    best = recall.best_window(places, d, 10.0, 1.0, 2.0).first()
    assert (best.start, best.end, best.places) == (7.0, 17.0, 2)
    assert recall.overlaps(places, places, 2.0).count() == 4


def test_truth_files(spark, tmp_path):
    old = {"places": [{"place_id": "q", "sign_text": "LIBRARY", "dark": True, "segments": [[3, 8]]}]}
    new = {"places": [{"name": "n", "texts": ["STATION", {"text": "go", "source": "caption"}], "dark": "auto", "segments": [["0:40", "1:20"], ["6:30", 400]]}, {"texts": [], "segments": [["5", "4"]]}]}
    (tmp_path / "a.json").write_text(json.dumps(old))
    (tmp_path / "b.json").write_text(json.dumps(new))
    rows = sorted(truth.read_truth(spark, f"file://{tmp_path}").collect(), key=lambda r: (r.file, r.place_order))
    assert [(r.place_id, r.dark, [t.text for t in r.texts]) for r in rows] == [("q", True, ["LIBRARY"]), ("p1", None, ["STATION", "go"]), ("p2", None, [])]
    assert [tuple(s) for s in rows[1].segments] == [(40.0, 80.0), (390.0, 400.0)]
    found = {(r.place_id, r.problem) for r in truth.problems(truth.read_truth(spark, f"file://{tmp_path}")).collect()}
    assert found == {("p2", "error: no texts"), ("p2", "error: segments are not intervals"), ("p1", "warning: text is short")}
    with pytest.raises(truth.TruthError):
        truth.check(truth.read_truth(spark, f"file://{tmp_path}"))
    inside, outside = truth.shift_places(truth.read_truth(spark, f"file://{tmp_path}/b.json"), 50.0, 395.0)
    assert [tuple(s) for s in inside.first().segments] == [(0.0, 30.0), (340.0, 345.0)]
    assert outside.count() == 1


def test_manifest(spark, tmp_path):
    body = {"defaults": {"ocr_lang": "eng"}, "videos": [{"key": "a-1", "url": "https://x", "clip": ["1:00", 90], "truth": "t"}, {"key": "B", "url": "ftp", "split": "test", "truth": "u", "ocr_lang": "kor"}]}
    (tmp_path / "m.json").write_text(json.dumps(body))
    videos = truth.read_manifest(spark, f"file://{tmp_path}/m.json")
    a, b = sorted(videos.collect(), key=lambda r: r.truth)
    assert (a.clip_start, a.clip_end, a.split, a.ocr_lang, a.judge, b.ocr_lang) == (60.0, 90.0, "dev", "eng", "tesseract", "kor")
    assert [r.problem for r in truth.manifest_problems(videos).collect()] == ["key is not valid"]
    assert truth.select_videos(videos, split="test").count() == 1
    with pytest.raises(truth.TruthError):
        truth.select_videos(videos, only=["none"])


def test_sampling_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(v, i) for v in (1, 2) for i in range(10)], "video long, n int")
    made = sampling.sample_uniform(rows, "video", ["n"], step=3, limit=3, fps=2.0).where("video = 1").orderBy("n").collect()
    assert [(r.n, r.frame_index, r.t) for r in made] == [(0, 0, 0.0), (3, 1, 0.5), (6, 2, 1.0)]
    table = spark.createDataFrame([(1, 10, 4)], "video_id long, decoded int, selected int")
    assert tuple(sinks.token_savings(table).first()) == (1, 2580, 1032, 1548)
    assert sinks.markdown(table) == "| video_id | decoded | selected |\n|---|---|---|\n| 1 | 10 | 4 |\n"
    sinks.write_csv(table, f"file://{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/c").first().decoded == "10"
    (tmp_path / "v" / "x").mkdir(parents=True)
    (tmp_path / "v" / "x" / "2.png").write_bytes(b"b")
    (tmp_path / "v" / "x" / "1.png").write_bytes(b"a")
    assert [(r.video_id, r.frame_index, bytes(r.content)) for r in sampling.read_images(spark, f"file://{tmp_path}/v").orderBy("frame_index").collect()] == [("x", 0, b"a"), ("x", 1, b"b")]


def test_stream_equals_batch(spark, tmp_path):
    from tessera.streaming.shots import stream_shots

    rows = frame(spark, [(1, 0)] * 3 + [(0, 1)] * 3 + [(1, 0)] * 3)
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"file://{tmp_path}/in")
    run = stream_shots(stream, 0.9, 1.0).writeStream.format("memory").queryName("shots").option("checkpointLocation", f"file://{tmp_path}/cp").start()
    run.processAllAvailable()
    run.stop()
    made = [r.shot_id for r in spark.table("shots").orderBy("frame_index").collect()]
    assert made == shots_of(spark, [(1, 0)] * 3 + [(0, 1)] * 3 + [(1, 0)] * 3, 1.0)


def test_regions_against_masks(spark):
    import numpy as np

    from tessera.operators import regions

    rng = np.random.default_rng(5)
    rows = [(int(f), int(x), int(y), int(w), int(h)) for f, x, y, w, h in zip(rng.integers(0, 6, 60), rng.integers(0, 90, 60), rng.integers(0, 70, 60), rng.integers(0, 30, 60), rng.integers(4, 20, 60), strict=True)]
    made = {r.frame: r for r in regions.saliency(spark.createDataFrame(rows, "frame long, x long, y long, w long, h long"), 128, 96).collect()}
    for frame in range(6):
        own = [b[1:] for b in rows if b[0] == frame and b[3] > 0 and 0.08 <= b[3] / b[4] <= 12 and 8 <= b[4] <= 400 and b[3] * b[4] >= 40 and b[3] * b[4] <= 0.2 * 128 * 96]
        mask = np.zeros((96, 128), bool)
        for x, y, w, h in own:
            mask[y : y + h, x : x + w] = True
        bands = [(y + h // 2) // 4 for _, y, _, h in own]
        aligned = 0.0 if len(own) < 2 else min(1.0, (max(bands.count(b) for b in bands) - 1) / 8)
        assert (made[frame].n, made[frame].area) == (len(own), int(mask.sum()))
        assert made[frame].alignment == pytest.approx(aligned)
        assert made[frame].textness == pytest.approx(min(1, 0.5 * min(1, mask.sum() / (128 * 96) / 0.35) + 0.2 * min(1, len(own) / 120) + 0.3 * aligned))
    assert regions.saliency(spark.createDataFrame([], "frame long, x long, y long, w long, h long"), 128, 96).count() == 0


def test_fuzzy_match_against_brute_force(spark, tmp_path):
    import random

    from tessera.functions.text import best_ratio, normalize
    from tessera.plans import queries

    draw = random.Random(3)
    words = ["".join(draw.choices("abcdefghijklmnopqrstuvwxyz", k=draw.randint(3, 8))) for _ in range(300)]
    items = [" ".join(draw.choices(words, k=20)) for _ in range(6)]
    docs = [" ".join(draw.choices(words, k=30)) for _ in range(8)] + ["", None]
    for k, item in enumerate(items):
        edited = item.split()
        for _ in range(k // 2):
            edited[draw.randrange(20)] = draw.choice(words)
        docs.append(" ".join([*draw.choices(words, k=10), *edited, *draw.choices(words, k=10)]))
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = {(r.doc_id, r.item_id) for r in queries.fuzzy_match(spark, str(tmp_path)).collect()}
    want = {(d, i) for d, doc in enumerate(docs) for i, item in enumerate(items) if best_ratio(normalize(doc), normalize(item)) >= 0.8}
    assert made == want and len(want) >= 6
