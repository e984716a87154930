"""Shot segmentation of a stream: one state a sequence, so rows are cut as they arrive in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "video_id long, frame_index long, t double, shot_id int"
STATE = "since double, shot int, last array<double>"


def stream_shots(frames: DataFrame, threshold: float, min_gap: float) -> DataFrame:
    """``video_id, frame_index, t, shot_id`` as the batch operator gives them, for rows that come in order of ``frame_index``
    within a sequence (within a micro-batch they are sorted). ``frames`` has ``video_id, frame_index, t, embedding``."""

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        since, shot, last = state.get if state.exists else (None, -1, None)
        rows = pd.concat(list(batches)).sort_values("frame_index")
        shots = []
        for t, e in zip(rows["t"], rows["embedding"], strict=True):
            e = [float(x) for x in e]
            cut = since is None or (sum(a * b for a, b in zip(last, e, strict=True)) < threshold and t - since >= min_gap)
            if cut:
                since, shot = float(t), shot + 1
            last = e
            shots.append(shot)
        state.update((since, shot, last))
        yield pd.DataFrame({"video_id": rows["video_id"], "frame_index": rows["frame_index"], "t": rows["t"], "shot_id": shots})

    return frames.groupBy("video_id").applyInPandasWithState(one, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
