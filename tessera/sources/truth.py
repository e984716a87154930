"""Ground truth and manifests: JSON with declared schemas, clip shift, and integrity as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import format_time, is_key, normalize_text, parse_time

MANIFEST = (
    "defaults struct<format: string, ocr_lang: string, judge: string>, "
    "videos array<struct<key: string, url: string, role: string, clip: array<variant>, truth: string, split: string, format: string, ocr_lang: string, judge: string, sha256: string>>"
)
#: Defaults of a manifest that states none.
DEFAULTS = {"format": "best", "ocr_lang": "kor+eng", "judge": "tesseract"}


class TruthError(ValueError):
    """A truth file or manifest breaks a rule."""


def _schema() -> str:
    fields = "place_id: string, name: string, texts: array<variant>, sign_text: string, dark: variant, segments: array<array<variant>>"
    return f"places array<struct<{fields}>>"


def _seconds(v: Column) -> Column:
    """A time given as a number or a string; null if it is neither."""
    kind = F.schema_of_variant(v)
    number = F.try_variant_get(v, "$", "double")
    return F.when(kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL"), F.when(number >= 0, number)).when(kind == "STRING", parse_time(F.try_variant_get(v, "$", "string")))


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """``file, place_order, place_id, name, texts, dark, segments`` of the truth files below a path.

    ``texts`` is an array of ``text, source``; a place without an id is named by its order; ``dark`` is null for auto.
    """
    places = spark.read.schema(_schema()).option("multiLine", "true").json(path).select(F.input_file_name().alias("file"), F.posexplode("places").alias("place_order", "p"))
    text = lambda v: F.coalesce(F.try_variant_get(v, "$.text", "string"), F.try_variant_get(v, "$", "string"))
    given = F.transform("p.texts", lambda v: F.struct(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(text(v)).alias("text"), F.coalesce(F.try_variant_get(v, "$.source", "string"), F.lit("sign")).alias("source")))
    old = F.when(F.col("p.sign_text").isNotNull(), F.array(F.struct(F.col("p.sign_text").alias("text"), F.lit("sign").alias("source"))))
    return places.select(
        "file", "place_order", F.coalesce("p.place_id", F.concat(F.lit("p"), F.col("place_order") + 1)).alias("place_id"), "p.name", F.coalesce(given, old, F.array().cast("array<struct<text:string,source:string>>")).alias("texts"),
        F.try_variant_get("p.dark", "$", "boolean").alias("dark"), F.transform("p.segments", lambda s: F.struct(_seconds(s[0]).alias("start"), _seconds(s[1]).alias("end"))).alias("segments"),
    )


def shift_segments(segments: Column, clip_start: Column, clip_end: Column) -> Column:
    """Segments clamped to a clip and timed from its start; those that it leaves nothing of are dropped. A null clip is the whole."""
    moved = F.transform(segments, lambda s: F.struct((F.greatest(s["start"], clip_start) - clip_start).alias("start"), (F.least(s["end"], clip_end) - clip_start).alias("end")))
    return F.when(clip_start.isNull(), segments).otherwise(F.filter(moved, lambda s: s["end"] > s["start"]))


def shift_places(places: DataFrame, clip_start: float, clip_end: float) -> tuple[DataFrame, DataFrame]:
    """Places within a clip, and the warnings for those that are not."""
    rows = places.withColumn("segments", shift_segments(F.col("segments"), F.lit(float(clip_start)), F.lit(float(clip_end))))
    return rows.where(F.size("segments") > 0), rows.where(F.size("segments") == 0).select("file", "place_id", F.lit("outside the clip").alias("warning"))


def problems(places: DataFrame) -> DataFrame:
    """``file, place_id, problem``: what breaks a rule or deserves a warning."""
    twice = places.groupBy("file", "place_id").count().where("count > 1").select("file", "place_id", F.lit("error: id is not unique").alias("problem"))
    bare = places.where(F.size("texts") == 0).select("file", "place_id", F.lit("error: no texts").alias("problem"))
    timed = places.where((F.size("segments") == 0) | F.exists("segments", lambda s: s["start"].isNull() | s["end"].isNull() | (s["end"] <= s["start"]))).select("file", "place_id", F.lit("error: segments are not intervals").alias("problem"))
    texts = places.select("file", "place_id", F.explode("texts").alias("t"))
    kinds = texts.where(~F.col("t.source").isin("sign", "caption", "other")).select("file", "place_id", F.lit("error: source is not known").alias("problem"))
    short = texts.where(F.length(normalize_text(F.col("t.text"))) < 4).select("file", "place_id", F.lit("warning: text is short").alias("problem"))
    return twice.union(bare).union(timed).union(kinds).union(short)


def check(places: DataFrame) -> DataFrame:
    """The places, if no rule is broken."""
    found = problems(places).where("problem like 'error%'").limit(5).collect()
    if found:
        raise TruthError("; ".join(f"{r.file} {r.place_id}: {r.problem}" for r in found))
    return places


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a video; what it leaves open comes from the file's defaults."""
    rows = spark.read.schema(MANIFEST).option("multiLine", "true").json(path).select("defaults", F.explode("videos").alias("v"))
    filled = [F.coalesce(F.col(f"v.{n}"), F.col(f"defaults.{n}"), F.lit(d)).alias(n) for n, d in DEFAULTS.items()]
    clip = [F.when(F.col("v.clip").isNotNull(), _seconds(F.col("v.clip")[i])).alias(n) for i, n in ((0, "clip_start"), (1, "clip_end"))]
    return rows.select("v.key", "v.url", "v.role", F.coalesce("v.split", F.lit("dev")).alias("split"), "v.truth", "v.sha256", *clip, *filled)


def manifest_problems(videos: DataFrame) -> DataFrame:
    """``key, problem``."""
    bad = F.when(~is_key(F.col("key")), "key is not valid").when(~F.col("url").rlike("^https?://"), "url is not valid").when(F.col("clip_end") <= F.col("clip_start"), "clip does not rise").when(~F.col("split").isin("dev", "test"), "split is not known")
    one = videos.select("key", bad.alias("problem")).where("problem is not null")
    return one.union(videos.groupBy("key").count().where("count > 1").select("key", F.lit("key is not unique")))


def select_videos(videos: DataFrame, only: list[str] | None = None, split: str | None = None) -> DataFrame:
    rows = videos
    if only:
        rows = rows.where(F.col("key").isin(only))
    if split:
        rows = rows.where(F.col("split") == split)
    if not rows.take(1):
        raise TruthError("no video is selected")
    return rows


def template(chapters: DataFrame) -> DataFrame:
    """A truth draft from ``video_id, chapter_order, title, start, end``: a place a chapter, its text still empty."""
    return chapters.select(
        "video_id", F.format_string("c%02d", F.col("chapter_order") + 1).alias("place_id"), F.col("title").alias("name"), F.lit("").alias("text"), F.array(format_time(F.col("start")), format_time(F.col("end"))).alias("segment")
    )
