"""The driver's tables as sequences: ``events`` as frames of a sequence per user, ``embeddings`` as one per label.

Each adapter is stated twice, as DataFrame operations and as SQL, so that queries and their oracles start alike.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Factor and divisor of each metric that is derived from an event's integer property.
METRICS = {"clip_low": (37, 200), "clip_high": (53, 250), "rms": (17, 400), "colorfulness": (29, 1), "noise": (13, 8), "textness": (71, 100)}
DAY = 86400.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("video_id"), (F.row_number().over(order) - 1).cast("long").alias("frame_index"),
        (F.timestamp_diff("MICROSECOND", F.first("ts").over(order), F.col("ts")) / 1e6).alias("t"), F.col("value").alias("lapvar"), (F.col("event_type") == "error").alias("rescued"),
        "event_type", "event_id", F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    made = {n: (F.col("k") * a % 101) / F.lit(float(b)) for n, (a, b) in METRICS.items()}
    return rows.withColumns({"luma": F.col("k") / F.lit(100.0), **made})


FRAMES_SQL = f"""
e0 AS (SELECT user_id AS video_id, row_number() OVER o - 1 AS frame_index, (epoch_us(ts) - epoch_us(first_value(ts) OVER o)) / 1e6 AS t, value AS lapvar,
              event_type = 'error' AS rescued, event_type, event_id, (props::JSON->>'k')::INT AS k FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)),
f AS (SELECT *, k / 100.0::DOUBLE AS luma, {", ".join(f"(k * {a} % 101) / {b}.0::DOUBLE AS {n}" for n, (a, b) in METRICS.items())} FROM e0)"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("video_id"), F.col("vec_id").alias("frame_index"), F.col("vec_id").cast("double").alias("t"), "embedding")


VECTORS_SQL = """
v AS (SELECT label::BIGINT AS video_id, vec_id AS frame_index, vec_id::DOUBLE AS t, embedding::DOUBLE[] AS e FROM embeddings),
s AS (SELECT *, list_inner_product(lag(e) OVER (PARTITION BY video_id ORDER BY frame_index), e) AS sim, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS i FROM v)"""


def segments(spark: SparkSession, sf_dir: str, event_type: str) -> DataFrame:
    """A place for each event of a type, seen for a day from it."""
    rows = frames(spark, sf_dir).where(F.col("event_type") == event_type)
    order = F.row_number().over(Window.partitionBy("video_id").orderBy("frame_index")).alias("place_order")
    return rows.select("video_id", order, F.concat(F.lit("p"), F.col("frame_index")).alias("place_id"), F.col("t").alias("start"), (F.col("t") + DAY).alias("end"))


def segments_sql(event_type: str) -> str:
    return f"SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY frame_index) AS place_order, 'p' || frame_index AS place_id, t AS a, t + {DAY} AS b FROM f WHERE event_type = '{event_type}'"
