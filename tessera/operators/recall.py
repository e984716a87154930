"""Recall of a selection against places that are known to be seen in intervals of a sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_place(frames: DataFrame, segments: DataFrame) -> DataFrame:
    """Adds ``place_id``: the first place in order that has a closed interval around ``t``; null without one.

    ``segments`` has ``video_id, place_id, place_order, start, end``. Sequences meet by key, so the range test is a filter
    of that join; a frame keeps the least place only, which is pre-aggregated and not ranked.
    """
    f, s = frames.alias("f"), segments.select("video_id", F.struct("place_order", "place_id").alias("_place"), "start", "end").alias("s")
    met = f.join(s, (F.col("f.video_id") == F.col("s.video_id")) & F.col("f.t").between(F.col("s.start"), F.col("s.end")))
    least = met.groupBy(F.col("f.video_id").alias("video_id"), F.col("f.frame_index").alias("frame_index")).agg(F.min("_place").alias("_place"))
    return frames.join(least, ["video_id", "frame_index"], "left").withColumn("place_id", F.col("_place.place_id")).drop("_place")


def contains(segments: Column, t: Column) -> Column:
    """Whether any closed interval of an array of ``start, end`` holds ``t``."""
    return F.exists(segments, lambda s: t.between(s["start"], s["end"]))


def overlaps(left: DataFrame, right: DataFrame, least: float = 0.0) -> DataFrame:
    """Pairs of intervals of a sequence that share ``least`` at least; columns of ``right`` are prefixed ``r_``."""
    other = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])
    shared = F.least(F.col("end"), F.col("r_end")) - F.greatest(F.col("start"), F.col("r_start"))
    met = left.join(other, (left["video_id"] == F.col("r_video_id")) & (F.col("start") <= F.col("r_end")) & (F.col("end") >= F.col("r_start")))
    return met.withColumn("shared", shared).where(F.col("shared") >= least)


def best_window(segments: DataFrame, durations: DataFrame, width: float, step: float, least: float) -> DataFrame:
    """``video_id, start, end, places``: the window that holds most places (each for ``least``), the earliest of equals.

    A place reaches a range of window starts, so windows are made from places and never crossed with them.
    """
    d = durations.select("video_id", F.greatest(F.lit(0), F.floor((F.col("duration") - width) / step)).cast("long").alias("last"))
    low = F.greatest(F.lit(0), F.ceil((F.col("start") + least - width) / step)).cast("long")
    high = F.least(F.col("last"), F.floor((F.col("end") - least) / step)).cast("long")
    reach = segments.where(F.col("end") - F.col("start") >= least).join(d, "video_id").withColumns({"low": low, "high": high}).where("low <= high")
    counted = reach.select("video_id", "place_id", F.explode(F.sequence("low", "high")).alias("w")).distinct().groupBy("video_id", "w").agg(F.count("*").alias("places"))
    best = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("places"), "w"))
    top = counted.withColumn("_n", best).where("_n = 1")
    return top.select("video_id", (F.col("w") * step).alias("start"), (F.col("w") * step + width).alias("end"), "places")


def loss_reasons(frames: DataFrame, rejected: DataFrame, picked: DataFrame, recovered: DataFrame, places: DataFrame) -> DataFrame:
    """``video_id, place_id, n_samples, n_alive, n_keyframes, reason`` of places that were not recovered.

    ``frames`` has ``place_id``; the others are keyed by frame, ``recovered`` by place.
    """
    keys = ["video_id", "frame_index"]
    state = frames.where("place_id is not null").join(rejected.select(*keys, F.lit(1).alias("_out")).distinct(), keys, "left").join(picked.select(*keys, F.lit(1).alias("_in")).distinct(), keys, "left")
    per = state.groupBy("video_id", "place_id").agg(F.count("*").alias("n_samples"), F.count_if(F.col("_out").isNull()).alias("n_alive"), F.count("_in").alias("n_keyframes"))
    lost = places.join(recovered.select("video_id", "place_id"), ["video_id", "place_id"], "left_anti").join(per, ["video_id", "place_id"], "left").fillna(0)
    reason = F.when(F.col("n_samples") == 0, "no samples").when(F.col("n_alive") == 0, "gate").when(F.col("n_keyframes") == 0, "not selected").otherwise("unreadable")
    return lost.select("video_id", "place_id", "n_samples", "n_alive", "n_keyframes", reason.alias("reason"))


def recall_by_subset(facts: DataFrame) -> DataFrame:
    """``split, video_id, places, recovered, recall, ...`` for sequences, splits and all, and per subset.

    ``facts`` has ``split, video_id, recovered, has_sign, dark`` a place. A subset without places has a null recall.
    """
    subset = {"all": F.lit(True), "sign": F.col("has_sign"), "bright": ~F.col("dark"), "dark": F.col("dark")}
    aggs = []
    for name, member in subset.items():
        aggs += [F.count_if(member).alias(f"{name}_places"), F.count_if(member & F.col("recovered")).alias(f"{name}_recovered")]
    out = facts.rollup("split", "video_id").agg(*aggs)
    for name in subset:
        out = out.withColumn(f"{name}_recall", F.when(F.col(f"{name}_places") > 0, F.col(f"{name}_recovered") / F.col(f"{name}_places")))
    return out


def dark_flags(frames: DataFrame, places: DataFrame, below: float = 0.18) -> DataFrame:
    """``video_id, place_id, dark``: as stated, else whether the median luma of the place's frames is low."""
    seen = frames.where("place_id is not null").groupBy("video_id", "place_id").agg((F.percentile("luma", F.lit(0.5)) < below).alias("_dim"))
    met = places.join(seen, ["video_id", "place_id"], "left")
    return met.select("video_id", "place_id", F.coalesce("dark", "_dim", F.lit(False)).alias("dark"))


def frames_per_place(frames: DataFrame) -> DataFrame:
    """``video_id, mean_frames`` over the places that selected frames show; 0 without any."""
    per = frames.groupBy("video_id", "place_id").agg(F.count("place_id").alias("n"))
    return per.groupBy("video_id").agg(F.coalesce(F.avg(F.when(F.col("n") > 0, F.col("n"))), F.lit(0.0)).alias("mean_frames"))


def needs_more(recovered: Column, has_sign: Column, by_sign: Column) -> Column:
    return ~recovered | (has_sign & ~by_sign)
