"""Sinks: frame tables as CSV and JSON, and Markdown reports of small aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Metrics of a frame and their decimals in a CSV table.
DECIMALS = {"lapvar": 3, "tenengrad": 3, "luma": 4, "clip_low": 4, "clip_high": 4, "rms": 4, "noise": 3, "colorfulness": 3, "textness": 4}
TOKENS_PER_IMAGE = 258


def csv_rows(frames: DataFrame, picked: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row a frame with fixed decimals, whether it was selected, and why it was rejected."""
    keys = ["video_id", "frame_index"]
    rows = frames.join(picked.select(*keys, F.lit(True).alias("_in")), keys, "left").join(rejected.select(*keys, "reason"), keys, "left")
    shown = [F.format_string(f"%.{d}f", F.col(c)).alias(c) for c, d in DECIMALS.items() if c in frames.columns]
    return rows.select(*keys, F.format_string("%.3f", "t").alias("t"), *shown, F.coalesce("_in", F.lit(False)).cast("int").alias("selected"), F.coalesce("reason", F.lit("")).alias("reject_reason"))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def token_savings(funnel: DataFrame, tokens: int = TOKENS_PER_IMAGE) -> DataFrame:
    """Image tokens of a sequence before and after selection."""
    return funnel.select("video_id", (F.col("decoded") * tokens).alias("tokens_before"), (F.col("selected") * tokens).alias("tokens_after"), ((F.col("decoded") - F.col("selected")) * tokens).alias("tokens_saved"))


def sheets(frames: DataFrame, per_sheet: int = 16) -> DataFrame:
    """``video_id, sheet, first_t, last_t, n``: frames in order, a number to a contact sheet."""
    return frames.groupBy("video_id", F.floor(F.col("frame_index") / per_sheet).alias("sheet")).agg(F.min("t").alias("first_t"), F.max("t").alias("last_t"), F.count("*").alias("n"))


def markdown(table: DataFrame, limit: int = 1000) -> str:
    """A small table as Markdown; a report, so it is limited."""
    rows = table.limit(limit).collect()
    show = lambda v: "—" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v)
    lines = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return "\n".join([*lines, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)]) + "\n"


def cached(work: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Work whose result a cache holds, joined with it, and work that is left."""
    return work.join(cache, key), work.join(cache, key, "left_anti")
