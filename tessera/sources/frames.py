"""Sampled sequences: systematic sampling of ordered rows, and frames read from files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sample_uniform(rows: DataFrame, key: str, order: list[str], step: int, limit: int = 900, fps: float = 1.0) -> DataFrame:
    """Every ``step``-th row of each sequence, at most ``limit``, with ``frame_index`` and ``t``.

    The limit is a bound of the operator's own (a sequence is decoded up to it). It is a rank filter, which Spark applies
    before the shuffle as well.
    """
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    taken = rows.withColumn("_place", place).where((F.pmod("_place", F.lit(step)) == 0) & (F.col("_place") < step * limit))
    index = (F.col("_place") / step).cast("int")
    return taken.withColumn("frame_index", index).withColumn("t", F.col("frame_index") / F.lit(float(fps))).drop("_place")


def read_images(spark: SparkSession, path: str, fps: float = 1.0) -> DataFrame:
    """``video_id, frame_index, t, path, content`` of image files in a folder per sequence, in order of their names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{png,jpg,jpeg}").load(path)
    video = F.element_at(F.split("path", "/"), -2)
    place = F.row_number().over(Window.partitionBy("video_id").orderBy("path")) - 1
    return files.select(video.alias("video_id"), "path", "content").withColumn("frame_index", place).withColumn("t", F.col("frame_index") / F.lit(float(fps)))


def decode_step(fps: F.Column, sample_fps: float = 1.0) -> F.Column:
    """Every how many frames one is decoded: the ratio rounded half to even, at least 1; 30 where the rate is not known."""
    rate = F.when(fps > 0, fps).otherwise(30.0)
    return F.greatest(F.bround(rate / F.lit(float(sample_fps))).cast("int"), F.lit(1))


def content_hash(content: str) -> F.Column:
    return F.sha2(F.col(content), 256)


def duration(text: str) -> F.Column:
    """A probed duration; 0 where it cannot be read."""
    return F.coalesce(F.col(text).try_cast("double"), F.lit(0.0))


def within_cap(duration_col: str, fps: float, limit: int = 900) -> F.Column:
    """Whether a sequence can be decoded whole."""
    return F.col(duration_col) * fps <= limit


def cut_clip(rows: DataFrame, start: float, end: float) -> DataFrame:
    """Rows within a closed clip, timed from its start."""
    return rows.where(F.col("t").between(start, end)).withColumn("t", F.col("t") - start)
