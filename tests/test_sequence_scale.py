"""Long sequences: the same results as plain models, whatever the blocks, and in time that grows with the rows."""

import random
import statistics
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.config import SelectConfig
from tessera.operators import gate, sequence


@pytest.mark.parametrize("block", [1, 7, 4096])
def test_nearest_against_every_pair(spark, block):
    rng = np.random.default_rng(3)
    rows = [(v, 10 * i, [float(x) for x in rng.integers(-2, 3, 3)]) for v, n in ((1, 40), (2, 1), (3, 3)) for i in range(n)]  # many ties
    made = sequence.nearest(spark.createDataFrame(rows, "video_id long, frame_index int, embedding array<float>"), 4, block)
    want = set()
    for v, i, e in rows:
        others = sorted((-float(np.dot(e, x)), j) for w, j, x in rows if w == v and j != i)
        want |= {(v, i, j, -s, r) for r, (s, j) in enumerate(others[:4], 1)}
    assert {tuple(r) for r in made.select("video_id", "frame_index", "other", "sim", "rank").collect()} == want
    none = spark.createDataFrame([], "video_id long, frame_index int, embedding array<float>")
    assert sequence.nearest(none, 4, block).count() == 0


def test_segment_against_a_loop(spark):
    rnd = random.Random(5)
    rows = [(v, i, None if rnd.random() < 0.1 else i / 3, None if i == 0 or rnd.random() < 0.1 else rnd.random()) for v in ("a", None) for i in range(60)]
    made = sequence.segment(spark.createDataFrame(rows, "video_id string, frame_index int, t double, sim double"), F.lit(0.5), 1.0)
    want = set()
    for v in ("a", None):
        since, shot = None, -1
        for _, i, t, sim in (r for r in rows if r[0] == v):
            if since is None or (sim is not None and sim < 0.5 and t is not None and t - since >= 1.0):
                since, shot = t, shot + 1
            want.add((v, i, shot))
    assert {tuple(r) for r in made.collect()} == want


def test_segment_takes_time_by_rows(spark):
    def seconds(n):
        rows = spark.range(n).select(F.lit(1).cast("long").alias("video_id"), F.col("id").alias("frame_index"), (F.col("id") * 1.0).alias("t"), F.lit(0.1).alias("sim"))
        start = time.monotonic()
        assert sequence.segment(rows, F.lit(0.5), 2.0).agg(F.max("shot_id")).first()[0] == (n - 1) // 2
        return time.monotonic() - start

    seconds(1000)
    assert seconds(320_000) < 20  # a list that is copied at each row takes minutes


def test_cuts_against_medians_of_lists(spark):
    rnd = random.Random(6)
    cfg = SelectConfig()
    w = cfg.blur_neighbor_window_sec
    rows = [(v, i, i * w / 3, rnd.random() < 0.3, None if rnd.random() < 0.1 else rnd.uniform(1, 100)) for v in (1, 2) for i in range(30)]
    made = {(r.video_id, r.frame_index): r.cut for r in gate.blur_cuts(spark.createDataFrame(rows, "video_id long, frame_index long, t double, rescued boolean, lapvar double"), cfg).collect()}
    for v, i, t, rescued, _ in rows:
        mine = [r for r in rows if r[0] == v and r[4] is not None]
        near = [r for r in mine if abs(round(r[2] * 1e6) - round(t * 1e6)) <= round(w * 1e6)]
        own = [r[4] for r in near if r[3] == rescued]
        local = statistics.median(own if len(own) >= 3 else [r[4] for r in near])
        floor = cfg.blur_global_floor_ratio * statistics.median(r[4] for r in mine)
        assert made[v, i] == pytest.approx(max(cfg.blur_neighbor_ratio * local, floor))
