"""The whole selection: frames with metrics and embeddings to keyframes, rejections and a summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.config import EMBEDDER_THRESHOLDS, SelectConfig
from tessera.functions import scores
from tessera.operators import gate, sequence

KEYS = ["video_id", "frame_index"]


@dataclass(frozen=True)
class Selection:
    frames: DataFrame
    shots: DataFrame
    keyframes: DataFrame
    rejected: DataFrame
    summary: DataFrame


def select_keyframes(frames: DataFrame, cfg: SelectConfig | None = None, embedder: str = "perceptual") -> Selection:
    """``frames`` has ``video_id, frame_index, t, rescued, embedding``, the metrics, and ``text_boxes`` for ``text_nms``.

    The gate judges all frames; similarity, shots and duplicates only look at those that it keeps. Frames of a shot that are not
    its representative are neither selected nor rejected.
    """
    cfg = (cfg or SelectConfig()).bound_to(*EMBEDDER_THRESHOLDS[embedder])
    judged = gate.gate(gate.readable(frames, cfg), cfg)
    detail = scores.reject_detail(F.col("reason"), F.col("luma"), F.col("clip_low"), F.col("clip_high"), F.col("lapvar"), F.col("cut"), F.col("rescued"))
    out = judged.where("reason is not null").select(*KEYS, "t", "reason", detail.alias("detail"))
    kept = judged.where("reason is null")
    if cfg.selection_strategy == "text_nms":
        total = frames.groupBy("video_id").agg(scores.nms_gap(F.count("*"), cfg.max_keyframes, cfg.text_nms_gap_ratio).alias("gap"))
        boxed = kept.withColumn("score", F.col("text_boxes").cast("double")).join(total, "video_id")
        picked = sequence.pick_spaced(boxed, cfg.max_keyframes)
        shots = kept.select(*KEYS, F.lit(0).alias("shot_id")).limit(0)
        keyframes = picked.join(boxed.select(*KEYS, "t", "score"), KEYS)
    else:
        similar = sequence.adjacent_similarity(kept)
        threshold = sequence.adaptive_threshold(similar, cfg.scene_similarity_threshold, cfg.max_shot_cut_rate)
        shots = sequence.segment(similar.join(threshold, "video_id"), F.col("threshold"), cfg.min_shot_gap_sec)
        best = sequence.representatives(kept.join(shots, KEYS))
        alone = sequence.drop_near_duplicates(best, cfg.duplicate_shot_threshold)
        left = best.join(alone, KEYS, "left_semi")
        picked = sequence.pick_diverse(left, cfg.max_keyframes)
        keyframes = left.join(picked, KEYS, "left_semi").select(*KEYS, "shot_id", "t", "score")
        dup = best.join(alone, KEYS, "left_anti").select(*KEYS, "t", F.lit("duplicate").alias("reason"), F.format_string("shot=%d", "shot_id").alias("detail"))
        over = left.join(picked, KEYS, "left_anti").select(*KEYS, "t", F.lit("budget").alias("reason"), F.format_string("score=%.3f", "score").alias("detail"))
        out = out.unionByName(dup).unionByName(over)
    return Selection(judged, shots, keyframes, out, gate.funnel(judged, shots, keyframes))
