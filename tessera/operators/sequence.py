"""Ordered operators over a sequence of embedded rows: segmentation, near-duplicate elimination, diverse and spaced picks.

Those whose state depends on earlier decisions run once per sequence, as a fold of built-in functions or as a grouped Arrow UDF.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.vectors import dot


def adjacent_similarity(rows: DataFrame) -> DataFrame:
    """Adds ``sim``, the product with the row before; null for the first."""
    before = F.lag("embedding").over(Window.partitionBy("video_id").orderBy("frame_index"))
    return rows.withColumn("_before", before).withColumn("sim", F.when(F.col("_before").isNotNull(), dot(F.col("_before"), F.col("embedding")))).drop("_before")


def mean_similarity(similar: DataFrame) -> DataFrame:
    """``video_id, mean_sim``: of adjacent rows; 1 for a sequence without pairs."""
    return similar.groupBy("video_id").agg(F.coalesce(F.avg("sim"), F.lit(1.0)).alias("mean_sim"))


def lower_quantile(values: Column, q: float) -> Column:
    """The largest of the collected values at or below the quantile's place."""
    ordered = F.sort_array(F.collect_list(values))
    return F.get(ordered, F.floor(F.lit(q) * (F.size(ordered) - 1)).cast("int"))


def adaptive_threshold(similar: DataFrame, default: float, rate: float = 0.25) -> DataFrame:
    """``video_id, n_pairs, threshold``: at most a share of the pairs may be cuts; with under four pairs the default."""
    found = similar.where("sim is not null").groupBy("video_id").agg(F.count("*").alias("n_pairs"), lower_quantile(F.col("sim"), rate).alias("q"))
    every = similar.select("video_id").distinct().join(found, "video_id", "left")
    return every.select("video_id", F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), F.when(F.col("n_pairs") >= 4, F.least(F.lit(default), F.col("q"))).otherwise(F.lit(default)).alias("threshold"))


def segment(similar: DataFrame, threshold: Column, min_gap: float) -> DataFrame:
    """``video_id, frame_index, shot_id``: a shot ends where the similarity is below the threshold and it has lasted ``min_gap``.

    The start only moves at a cut, so this is a fold and not a running sum of cuts: one pass over a sequence, of which Python
    only gets the times and what is low. ``similar`` has ``t`` and ``sim``. A null similarity cuts nothing, nor does a row
    without a time; after a cut without a time the next row cuts again.
    """
    key = similar.schema["video_id"].dataType.simpleString()
    low = F.coalesce(F.col("sim") < threshold, F.lit(False)).alias("low")
    rows = similar.select("video_id", F.col("frame_index").cast("long").alias("frame_index"), F.col("t").cast("double").alias("t"), low)

    def one(table: pa.Table) -> pa.Table:
        table = table.sort_by([("frame_index", "ascending"), ("t", "ascending"), ("low", "descending")])
        shots, since, shot = [], None, -1
        for t, is_low in zip(table["t"].to_pylist(), table["low"].to_pylist(), strict=True):
            if since is None or (is_low and t is not None and not t - since < min_gap):
                since, shot = t, shot + 1
            shots.append(shot)
        return table.select(["video_id", "frame_index"]).append_column("shot_id", pa.array(shots, pa.int32()))

    return rows.groupBy("video_id").applyInArrow(one, f"video_id {key}, frame_index long, shot_id int")


def representatives(scored: DataFrame) -> DataFrame:
    """The best row of each shot, the earliest of equals."""
    best = F.row_number().over(Window.partitionBy("video_id", "shot_id").orderBy(F.desc("score"), "frame_index"))
    return scored.withColumn("_n", best).where("_n = 1").drop("_n")


def greedy_keep(vectors: np.ndarray, threshold: float) -> np.ndarray:
    """Places of the rows that are not as similar as the threshold to an earlier kept one; a dropped row suppresses none."""
    kept: list[int] = []
    for i in range(len(vectors)):
        if not kept or float(np.max(vectors[kept] @ vectors[i])) < threshold:
            kept.append(i)
    return np.array(kept, dtype=np.int64)


def k_center(vectors: np.ndarray, score: np.ndarray, budget: int) -> np.ndarray:
    """Places of ``budget`` rows: the best score first, then always the least similar to those chosen (by score, then place)."""
    n = len(score)
    if budget <= 0 or n == 0:
        return np.empty(0, dtype=np.int64)
    if budget >= n:
        return np.arange(n)
    chosen = [int(np.argmax(score))]
    close = vectors @ vectors[chosen[0]]
    while len(chosen) < budget:
        free = np.setdiff1d(np.arange(n), chosen)
        chosen.append(int(free[np.lexsort((free, -score[free], close[free]))[0]]))
        close = np.maximum(close, vectors @ vectors[chosen[-1]])
    return np.sort(np.array(chosen))


def spaced(index: np.ndarray, score: np.ndarray, budget: int, gap: int) -> np.ndarray:
    """Indices by falling score, each over ``gap`` away from those taken, until the budget; ascending."""
    if len(index) != len(score):
        raise ValueError("index and score differ in length")
    taken: list[int] = []
    for i in np.lexsort((index, -np.asarray(score, dtype=float))):
        if len(taken) >= budget:
            break
        if all(abs(int(index[i]) - x) > gap for x in taken):
            taken.append(int(index[i]))
    return np.array(sorted(taken), dtype=np.int64)


def _matrix(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(e, dtype=np.float64) for e in pdf["embedding"]]) if len(pdf) else np.empty((0, 0))


def drop_near_duplicates(rows: DataFrame, threshold: float) -> DataFrame:
    """``video_id, frame_index`` of the rows that stay, in order of ``frame_index``."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_index")
        return pdf.iloc[greedy_keep(_matrix(pdf), threshold)][["video_id", "frame_index"]]

    return rows.select("video_id", F.col("frame_index").cast("long").alias("frame_index"), "embedding").groupBy("video_id").applyInPandas(one, "video_id long, frame_index long")


def pick_diverse(rows: DataFrame, budget: int) -> DataFrame:
    """``video_id, frame_index`` of at most ``budget`` rows a sequence that cover its embeddings."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_index")
        return pdf.iloc[k_center(_matrix(pdf), pdf["score"].to_numpy(dtype=float), budget)][["video_id", "frame_index"]]

    wanted = rows.select("video_id", F.col("frame_index").cast("long").alias("frame_index"), "embedding", F.col("score").cast("double").alias("score"))
    return wanted.groupBy("video_id").applyInPandas(one, "video_id long, frame_index long")


def pick_spaced(rows: DataFrame, budget: int) -> DataFrame:
    """``video_id, frame_index`` of at most ``budget`` best rows a sequence, over ``gap`` (a column) apart."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        taken = spaced(pdf["frame_index"].to_numpy(), pdf["score"].to_numpy(dtype=float), budget, int(pdf["gap"].iloc[0]))
        return pd.DataFrame({"video_id": pdf["video_id"].iloc[0], "frame_index": taken})

    wanted = rows.select("video_id", F.col("frame_index").cast("long").alias("frame_index"), F.col("score").cast("double").alias("score"), F.col("gap").cast("long").alias("gap"))
    return wanted.groupBy("video_id").applyInPandas(one, "video_id long, frame_index long")


def _most_similar(left: pd.DataFrame, right: pd.DataFrame, k: int, same: bool) -> pd.DataFrame:
    """``frame_index, other, sim``: the ``k`` rows of ``right`` most similar to each of ``left``; if they are the same rows, none is its own."""
    index, others = left["frame_index"].to_numpy(), right["frame_index"].to_numpy()
    a, b = _matrix(left), _matrix(right)
    k = min(k, len(others) - same)
    out = []
    for at in range(0, len(index) if k > 0 else 0, 512):
        sim = np.round(a[at : at + 512] @ b.T, 6)
        if same:
            sim[np.arange(len(sim)), at + np.arange(len(sim))] = -np.inf
        least = -np.partition(-sim, k - 1, axis=1)[:, k - 1]
        row, col = np.nonzero(sim >= least[:, None])  # more than k where the last ones tie
        order = np.lexsort((others[col], -sim[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[place < k], col[place < k]
        out.append(pd.DataFrame({"frame_index": index[at + row], "other": others[col], "sim": sim[row, col]}))
    return pd.concat(out) if out else pd.DataFrame({"frame_index": [], "other": [], "sim": []})


def nearest(rows: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """``video_id, frame_index, other, sim, rank``: each row's ``k`` most similar ones in its sequence, by place if equal.

    A long sequence is dealt into blocks of about ``block`` rows, and each pair of blocks is a group of its own that
    multiplies two small matrices; only the ``k`` best of a row and block go on. So no task holds a sequence, however
    long, and no pair but those becomes a row. ``frame_index`` is a key of its sequence.
    """

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame_index", kind="stable")
        sides = [pdf[pdf["side"] == s] for s in (0, 1)]
        made = _most_similar(*sides, k, bool(pdf["i"].iloc[0] == pdf["j"].iloc[0]))
        return made.assign(video_id=pdf["video_id"].iloc[0])[["video_id", "frame_index", "other", "sim"]]

    wanted = rows.select("video_id", F.col("frame_index").cast("long").alias("frame_index"), "embedding")
    blocks = wanted.groupBy(F.col("video_id").alias("_video")).agg(F.ceil(F.count("*") / block).cast("int").alias("_n"))
    dealt = wanted.join(blocks, F.col("video_id").eqNullSafe(F.col("_video"))).withColumn("_at", F.pmod(F.xxhash64("frame_index"), F.col("_n")).cast("int"))
    places = F.sequence(F.lit(0), F.col("_n") - 1)
    pair = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    copies = F.concat(F.transform(places, lambda x: pair(F.col("_at"), x, 0)), F.transform(places, lambda x: pair(x, F.col("_at"), 1)))
    met = dealt.select("video_id", "frame_index", "embedding", F.explode(copies).alias("_c")).select("video_id", "frame_index", "embedding", "_c.*")
    best = met.groupBy("video_id", "i", "j").applyInPandas(one, "video_id long, frame_index long, other long, sim double")
    rank = F.row_number().over(Window.partitionBy("video_id", "frame_index").orderBy(F.desc("sim"), "other"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)
