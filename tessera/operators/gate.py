"""Quality gate: a frame is judged against its neighbours in time and its whole sequence.

All windows share the key ``video_id``, so a sequence is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import SelectConfig
from tessera.functions import scores


def blur_cuts(frames: DataFrame, cfg: SelectConfig) -> DataFrame:
    """Adds ``cut``: the sharpness that a frame must reach.

    It is a share of the median of the frames within the window, of the own stratum if it has three there, or of the floor
    that the whole sequence's median sets, whichever is more. A frame that cannot see its own stratum in a window
    expression gets both strata's medians, and picks.
    """
    w = round(cfg.blur_neighbor_window_sec * 1e6)  # whole microseconds, as frames of ranges are whole
    near = Window.partitionBy("video_id").orderBy(F.round(F.col("t") * 1e6).cast("long")).rangeBetween(-w, w)
    whole = Window.partitionBy("video_id")
    median = lambda c, over: F.percentile(c, F.lit(0.5)).over(over)
    own = lambda r: F.when(F.col("rescued") == F.lit(r), F.col("lapvar"))
    pool = F.when(F.col("rescued"), F.struct(F.count(own(True)).over(near).alias("n"), median(own(True), near).alias("m"))).otherwise(
        F.struct(F.count(own(False)).over(near).alias("n"), median(own(False), near).alias("m"))
    )
    rows = frames.withColumns({"_pool": pool, "_all": median(F.col("lapvar"), near), "_floor": cfg.blur_global_floor_ratio * median(F.col("lapvar"), whole)})
    local = F.when(F.col("_pool.n") >= 3, F.col("_pool.m")).otherwise(F.col("_all"))
    return rows.withColumn("cut", F.greatest(cfg.blur_neighbor_ratio * local, F.col("_floor"))).drop("_pool", "_all", "_floor")


def reference_sharpness(frames: DataFrame, share: float = 0.9, least: int = 4) -> DataFrame:
    """``video_id, rescued, n, reference``: the stratum's percentile, or the sequence's if the stratum has too few frames."""
    whole = frames.groupBy("video_id").agg(F.percentile("lapvar", F.lit(share)).alias("everything"))
    strata = frames.groupBy("video_id", "rescued").agg(F.count("*").alias("n"), F.percentile("lapvar", F.lit(share)).alias("own"))
    met = strata.join(whole, "video_id")
    return met.select("video_id", "rescued", "n", F.when(F.col("n") >= least, F.col("own")).otherwise(F.col("everything")).alias("reference"))


def gate(frames: DataFrame, cfg: SelectConfig, last_resort: bool = True) -> DataFrame:
    """Adds ``cut`` and ``reason`` (null: kept). A sequence of which nothing is left keeps its sharpest frame, the first of equals."""
    rows = blur_cuts(frames, cfg)
    reason = scores.reject_reason(F.col("luma"), F.col("clip_low"), F.col("clip_high"), F.col("lapvar"), F.col("cut"), cfg)
    rows = rows.withColumn("reason", reason)
    if not last_resort:
        return rows
    kept = F.count_if(F.col("reason").isNull()).over(Window.partitionBy("video_id"))
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("lapvar"), "frame_index"))
    rows = rows.withColumns({"_kept": kept, "_rank": rank})
    return rows.withColumn("reason", F.when((F.col("_kept") == 0) & (F.col("_rank") == 1), None).otherwise(F.col("reason"))).drop("_kept", "_rank")


def readable(frames: DataFrame, cfg: SelectConfig) -> DataFrame:
    """Adds ``score``, the readability against the stratum's reference."""
    rows = frames.join(reference_sharpness(frames).select("video_id", "rescued", "reference"), ["video_id", "rescued"])
    names = ("lapvar", "luma", "rms", "colorfulness", "clip_low", "clip_high", "noise", "textness")
    return rows.withColumn("score", scores.readability({n: F.col(n) for n in names}, F.col("reference"), cfg.text_weight)).drop("reference")


STAGES = ("decoded", "rescued", "after_gate", "shots", "selected")


def stages(funnel: DataFrame) -> DataFrame:
    """``video_id, stage, n, share``: a row a stage of the funnel, with its share of the first."""
    rows = funnel.select("video_id", "decoded", F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("long").alias("n")) for s in STAGES])).alias("s"))
    return rows.select("video_id", "s.stage", "s.n", F.when(F.col("decoded") > 0, F.col("s.n") / F.col("decoded")).otherwise(0.0).alias("share"))


def funnel(gated: DataFrame, shots: DataFrame, picked: DataFrame) -> DataFrame:
    """``video_id, decoded, rescued, after_gate, shots, selected, reduction_ratio``."""
    a = gated.groupBy("video_id").agg(F.count("*").alias("decoded"), F.count_if("rescued").alias("rescued"), F.count_if(F.col("reason").isNull()).alias("after_gate"))
    b = shots.groupBy("video_id").agg(F.countDistinct("shot_id").alias("shots"))
    c = picked.groupBy("video_id").agg(F.count("*").alias("selected"))
    out = a.join(b, "video_id", "left").join(c, "video_id", "left").fillna(0, ["shots", "selected"])
    return out.withColumn("reduction_ratio", F.when(F.col("decoded") > 0, 1 - F.col("selected") / F.col("decoded")).otherwise(0.0))
