"""Registered queries of the feature, region, naming and report operators, each over whole tables, with SQL that checks it.

Importing this module adds them to ``tessera.plans.queries``. Regions and pixels are made from ``lineitem``, a frame or image
per order, or per return flag.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.config import ablations
from tessera.functions import scores, text, vectors
from tessera.operators import gate, recall, regions, sequence
from tessera.plans import adapters as ad
from tessera.plans.queries import CFG, FIRST_SQL, GATE_SQL, SQL, _placed, _with, funnel, query
from tessera.sources import frames as sampling
from tessera.sources.truth import template

WIDTH, HEIGHT = 640, 360
REGIONS_SQL = "b AS (SELECT l_orderkey AS frame, l_partkey % 560 AS x, l_suppkey * 3 % 300 AS y, l_quantity::BIGINT AS w, l_linenumber * 4 AS h FROM lineitem)"
LETTERS_SQL = f"g AS (SELECT * FROM b WHERE w > 0 AND h > 0 AND w / h BETWEEN 0.08 AND 12 AND h BETWEEN 8 AND 400 AND w * h >= 40 AND w * h <= 0.2 * {WIDTH * HEIGHT})"
ALIGN_SQL = f"""
bands AS (SELECT frame, (y + h // 2) // {max(HEIGHT // 40, 4)} AS band, count(*) AS n FROM g GROUP BY ALL),
al AS (SELECT frame, sum(n) AS n, CASE WHEN sum(n) < 2 THEN 0 ELSE least(1, (max(n) - 1) / 8) END AS alignment FROM bands GROUP BY frame)"""
AREA_SQL = """
ys AS (SELECT frame, x, w, unnest(range(y, y + h)) AS py FROM g), cells AS (SELECT DISTINCT frame, py, unnest(range(x, x + w)) AS px FROM ys),
ar AS (SELECT frame, count(*) AS area FROM cells GROUP BY frame)"""


def _regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_orderkey").alias("frame"), (F.col("l_partkey") % 560).alias("x"), (F.col("l_suppkey") * 3 % 300).alias("y"), F.col("l_quantity").cast("long").alias("w"), (F.col("l_linenumber") * 4).alias("h")
    )


@query(_with(REGIONS_SQL, LETTERS_SQL) + " SELECT frame, count(*) AS letters, sum(w * h)::BIGINT AS boxed FROM g GROUP BY frame")
def letter_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.letters(_regions(spark, sf_dir), WIDTH, HEIGHT).groupBy("frame").agg(F.count("*").alias("letters"), F.sum(F.col("w") * F.col("h")).alias("boxed"))


@query(_with(REGIONS_SQL, LETTERS_SQL, ALIGN_SQL) + " SELECT frame, n::BIGINT AS n, round(alignment, 6) AS alignment FROM al")
def row_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions.alignment(regions.letters(_regions(spark, sf_dir), WIDTH, HEIGHT), HEIGHT)
    return rows.select("frame", "n", F.round("alignment", 6).alias("alignment"))


@query(
    _with(REGIONS_SQL, LETTERS_SQL, ALIGN_SQL, AREA_SQL)
    + f" SELECT frame, n::BIGINT AS n, area, round(alignment, 6) AS alignment, round(greatest(0, least(1, 0.5 * least(1, area / {WIDTH * HEIGHT} / 0.35) + 0.2 * least(1, n / 120) + 0.3 * alignment)), 6) AS textness FROM al JOIN ar USING (frame)"
)
def text_saliency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = regions.saliency(_regions(spark, sf_dir), WIDTH, HEIGHT)
    return rows.select("frame", "n", "area", F.round("alignment", 6).alias("alignment"), F.round("textness", 6).alias("textness"))


@query(
    "WITH r AS (SELECT l_orderkey AS frame, l_quantity AS w, l_linenumber * 2.0::DOUBLE AS h, 1 - l_discount * 10 AS p, l_quantity * l_linenumber * 2.0::DOUBLE * 1.6::DOUBLE / (l_quantity + l_linenumber * 2.0::DOUBLE) AS d FROM lineitem)"
    " SELECT frame, count(*) AS n, round(sum((w + d) * (h + d) * 2.25::DOUBLE), 4) AS area FROM r WHERE least(w, h) >= 3 AND p >= 0.5 AND least(w, h) + d >= 5 AND (least(w, h) + d) * 1.5 > 3 GROUP BY frame"
)
def detected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame"), F.col("l_quantity").alias("w"), (F.col("l_linenumber") * 2.0).alias("h"), (1 - F.col("l_discount") * 10).alias("p"))
    return regions.detected(rows, 1.5).withColumn("area", F.round("area", 4))


@query(
    "WITH b AS (SELECT l_returnflag, least(7, floor(l_quantity * 8 / 51)) * 32 + least(7, floor(l_discount * 8 / 0.11)) * 4 + least(3, floor(l_tax * 4 / 0.09)) AS bin FROM lineitem)"
    " SELECT l_returnflag, bin::INT AS bin, round(count(*) / sum(count(*)) OVER (PARTITION BY l_returnflag), 9) AS share FROM b GROUP BY l_returnflag, bin"
)
def joint_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity", "l_discount", "l_tax")
    shares = regions.histogram(rows, "l_returnflag", {"l_quantity": (51.0, 8), "l_discount": (0.11, 8), "l_tax": (0.09, 4)})
    return shares.select("l_returnflag", "bin", F.round("share", 9).alias("share"))


@query(
    "WITH p AS (SELECT l_returnflag, l_quantity * 5 AS gray, (l_partkey % 256)::DOUBLE AS r, (l_suppkey * 7 % 256)::DOUBLE AS g, (l_orderkey % 256)::DOUBLE AS b FROM lineitem)"
    " SELECT l_returnflag, round(avg(gray) / 255, 6) AS luma, round(avg((gray <= 8)::INT), 6) AS clip_low, round(avg((gray >= 247)::INT), 6) AS clip_high, round(stddev_pop(gray) / 255, 6) AS rms,"
    " round(sqrt(var_pop(r - g) + var_pop(0.5 * (r + g) - b)) + 0.3 * sqrt(power(avg(r - g), 2) + power(avg(0.5 * (r + g) - b), 2)), 6) AS colorfulness FROM p GROUP BY l_returnflag"
)
def pixel_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = lambda e: (e % 256).cast("double")
    pixels = ad.table(spark, sf_dir, "lineitem").select("l_returnflag", (F.col("l_quantity") * 5).alias("gray"), c(F.col("l_partkey")).alias("r"), c(F.col("l_suppkey") * 7).alias("g"), c(F.col("l_orderkey")).alias("b"))
    found = regions.pixel_stats(pixels, "l_returnflag")
    return found.select("l_returnflag", *[F.round(n, 6).alias(n) for n in found.columns[1:]])


@query(
    _with(ad.FRAMES_SQL)
    + ", x AS (SELECT *, CASE WHEN luma > 0 AND luma < 1 THEN greatest(0.45, least(2.2, ln(0.48) / ln(luma))) END AS g FROM f) SELECT video_id, frame_index, round(CASE WHEN luma <= 1e-4 OR luma >= 1 - 1e-4 OR abs(g - 1) < 0.02 THEN 1 ELSE g END, 6) AS gamma FROM x"
)
def adaptive_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.frames(spark, sf_dir).select("video_id", "frame_index", F.round(scores.gamma_for(F.col("luma")), 6).alias("gamma"))


_unit = lambda v: f"list_transform({v}, lambda x: x / greatest(sqrt(list_inner_product({v}, {v})), 1e-8))"


@query(
    f"WITH v AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings), u AS (SELECT vec_id, {_unit('a')} AS a, {_unit('b')} AS b FROM v),"
    f" c AS (SELECT vec_id, list_concat(list_transform(a, lambda x: x * sqrt(0.6)), list_transform(b, lambda x: x * sqrt(0.4))) AS c FROM u), n AS (SELECT vec_id, {_unit('c')} AS n FROM c)"
    " SELECT vec_id, len(n)::INT AS size, round(n[1], 6) AS first, round(n[40], 6) AS later, round(list_inner_product(n, n), 6) AS length FROM n"
)
def weighted_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("embedding")
    rows = ad.table(spark, sf_dir, "embeddings").select("vec_id", vectors.weighted_concat([(F.slice(e, 1, 32), 0.6), (F.slice(e, 33, 32), 0.4)]).alias("n"))
    return rows.select("vec_id", F.size("n").alias("size"), F.round(F.col("n")[0], 6).alias("first"), F.round(F.col("n")[39], 6).alias("later"), F.round(vectors.dot(F.col("n"), F.col("n")), 6).alias("length"))


@query(
    "WITH v AS (SELECT vec_id, embedding[2:]::DOUBLE[] AS e, list_median(embedding[2:]::DOUBLE[]) AS m FROM embeddings)"
    " SELECT vec_id, array_to_string(list_transform(e, lambda x: CASE WHEN x > m THEN '+' ELSE '-' END), '') AS bits FROM v"
)
def hash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "embeddings").select("vec_id", vectors.median_signs(F.col("embedding")).alias("s"))
    return rows.select("vec_id", F.array_join(F.transform("s", lambda x: F.when(x > 0, "+").otherwise("-")), "").alias("bits"))


@query(
    _with(ad.FRAMES_SQL, GATE_SQL)
    + """ SELECT video_id, frame_index, CASE reason WHEN 'underexposed' THEN printf('luma=%.3f clip_low=%.3f', luma, clip_low) WHEN 'overexposed' THEN printf('luma=%.3f clip_high=%.3f', luma, clip_high)
     ELSE 'lapvar=' || lapvar::DECIMAL(18,4)::DECIMAL(18,2) || ' cut=' || round(cut, 4)::DECIMAL(18,4)::DECIMAL(18,2) || CASE WHEN rescued THEN ' (rescued)' ELSE ' (normal)' END END AS detail FROM g WHERE reason IS NOT NULL"""
)
def reject_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = gate.gate(ad.frames(spark, sf_dir), CFG).where("reason is not null")
    detail = scores.reject_detail(*[F.col(c) for c in ("reason", "luma", "clip_low", "clip_high", "lapvar")], F.round("cut", 4), F.col("rescued"))
    return judged.select("video_id", "frame_index", detail.alias("detail"))


@query(
    f"WITH fn AS ({SQL['funnel']}) SELECT video_id, stage, n, round(n / decoded, 6) AS share FROM (SELECT video_id, decoded, unnest(['decoded', 'rescued', 'after_gate', 'shots', 'selected']) AS stage,"
    " unnest([decoded, rescued, after_gate, CASE WHEN after_gate > 0 THEN 1 ELSE 0 END, selected]) AS n FROM fn)"
)
def funnel_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = funnel(spark, sf_dir).withColumn("shots", F.when(F.col("after_gate") > 0, 1).otherwise(0))
    return gate.stages(made).withColumn("share", F.round("share", 6))


@query(_with(ad.FRAMES_SQL, FIRST_SQL) + ", n AS (SELECT video_id, place_id, count(place_id) AS n FROM pl GROUP BY ALL) SELECT video_id, round(coalesce(avg(n) FILTER (n > 0), 0), 6) AS mean_frames FROM n GROUP BY video_id")
def frames_per_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.frames_per_place(_placed(spark, sf_dir)).select("video_id", F.round("mean_frames", 6).alias("mean_frames"))


@query(_with(ad.VECTORS_SQL) + " SELECT video_id, round(coalesce(avg(sim), 1), 6) AS mean_sim FROM s GROUP BY video_id")
def mean_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.mean_similarity(sequence.adjacent_similarity(ad.vectors(spark, sf_dir)))
    return rows.select("video_id", F.round("mean_sim", 6).alias("mean_sim"))


@query(_with(ad.FRAMES_SQL) + f", sg AS ({ad.segments_sql('purchase')}) SELECT video_id, frame_index, EXISTS (SELECT 1 FROM sg WHERE sg.video_id = f.video_id AND f.t BETWEEN a AND b) AS inside FROM f")
def segment_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = ad.segments(spark, sf_dir, "purchase").groupBy("video_id").agg(F.collect_list(F.struct("start", "end")).alias("segments"))
    met = ad.frames(spark, sf_dir).join(held, "video_id", "left")
    return met.select("video_id", "frame_index", F.coalesce(recall.contains(F.col("segments"), F.col("t")), F.lit(False)).alias("inside"))


@query("SELECT conv_id, turn, length(regexp_replace(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z0-9]', '', 'g')) < 4 AS short FROM conversations")
def short_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    upper = F.translate(F.coalesce("text", F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return ad.table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.length(text.normalize_ascii(upper)) < 4).alias("short"))


@query("SELECT o_orderkey, o_totalprice / 100 * 2 <= 900 AS whole, o_totalprice / 100 AS seconds FROM orders")
def decoding_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).cast("string").alias("probed"))
    return rows.withColumn("seconds", sampling.duration("probed")).select("o_orderkey", sampling.within_cap("seconds", 2.0).alias("whole"), "seconds")


@query("SELECT doc_id, NOT (quality = 1) OR (n_chars > 500 AND NOT (toxic = 0)) AS more FROM labels JOIN documents USING (doc_id)")
def needs_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    rows = ad.table(spark, sf_dir, "labels").join(docs, "doc_id")
    return rows.select("doc_id", recall.needs_more(F.col("quality") == 1, F.col("n_chars") > 500, F.col("toxic") == 0).alias("more"))


@query("SELECT p_partkey, concat_ws(' ', p_name, nullif(p_brand, 'Brand#11'), p_type) AS read FROM part")
def page_modes_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", F.nullif("p_brand", F.lit("Brand#11")), "p_type").alias("read"))


@query("SELECT page_id, sha256(html) AS sha256 FROM pages")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ad.table(spark, sf_dir, "pages").select("page_id", sampling.content_hash("html").alias("sha256"))


_TIME_SQL = lambda s: f"CASE WHEN {s} >= 3600 THEN ({s} // 3600) || ':' || lpad(({s} // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad(({s} % 60)::VARCHAR, 2, '0') ELSE ({s} // 60) || ':' || lpad(({s} % 60)::VARCHAR, 2, '0') END"


@query(
    "WITH c AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_partkey AS a, l_partkey + l_quantity::BIGINT AS b FROM lineitem)"
    f" SELECT l_orderkey AS video_id, 'c' || lpad(l_linenumber::VARCHAR, 2, '0') AS place_id, l_returnflag AS name, '' AS text, ({_TIME_SQL('a')}) || '-' || ({_TIME_SQL('b')}) AS segment FROM c"
)
def chapter_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "lineitem")
    chapters = rows.select(
        F.col("l_orderkey").alias("video_id"), (F.col("l_linenumber") - 1).alias("chapter_order"), F.col("l_returnflag").alias("title"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.col("l_quantity").cast("long")).alias("end")
    )
    return template(chapters).withColumn("segment", F.array_join("segment", "-"))


@query(
    "WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 900 END AS a, o_orderkey % 1000 / 4 AS s FROM orders)"
    " SELECT o_orderkey, CASE WHEN a IS NULL THEN 'source.mp4' ELSE printf('clip_%d-%d.mp4', a, a + 60) END AS clip, printf('frame_%05d_%07.2fs.jpg', o_orderkey % 100000, s) AS frame FROM c"
)
def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    start = F.when(key % 3 > 0, key % 900)
    return ad.table(spark, sf_dir, "orders").select("o_orderkey", text.clip_name(start, start + 60).alias("clip"), text.keyframe_name(key % 100000, key % 1000 / 4).alias("frame"))


@query(
    _with(ad.FRAMES_SQL)
    + ", d AS (SELECT *, greatest(1, round_even(CASE WHEN video_id % 20 > 0 THEN video_id % 20 / 2 ELSE 30 END, 0))::INT AS step FROM f) SELECT video_id, frame_index, step FROM d WHERE frame_index % step = 0"
)
def direct_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.frames(spark, sf_dir).withColumn("step", sampling.decode_step(F.col("video_id") % 20 / F.lit(2.0)))
    return rows.where(F.pmod("frame_index", F.col("step")) == 0).select("video_id", "frame_index", "step")


@query(
    "SELECT count(*) FILTER (s.o_custkey IS NOT NULL AND t.o_custkey IS NOT NULL) = 0 AS disjoint_sets, count(s.o_custkey) AS dev, count(t.o_custkey) AS test"
    " FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') s FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority LIKE '5%') t ON s.o_custkey = t.o_custkey"
)
def split_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = ad.table(spark, sf_dir, "orders").select("o_custkey", F.substring("o_orderpriority", 1, 1).alias("p"))
    sides = orders.groupBy("o_custkey").agg(F.bool_or(F.col("p") == "1").alias("dev"), F.bool_or(F.col("p") == "5").alias("test"))
    return sides.agg((F.count_if(F.col("dev") & F.col("test")) == 0).alias("disjoint_sets"), F.count_if("dev").alias("dev"), F.count_if("test").alias("test"))


_RUNS = {"full": "", "no-enhance": "", "no-rescue": "false AND ", "text-det": "", "no-dedup": ""}


@query(
    _with(ad.FRAMES_SQL)
    + " "
    + " UNION ALL ".join(
        f"SELECT '{label}' AS label, video_id, count(*) AS n, count(*) FILTER ({off}NOT (luma < 0.015 OR clip_low > 0.65) AND (luma < 0.18 OR clip_low >= 0.12)) AS to_rescue FROM f GROUP BY video_id" for label, off in _RUNS.items()
    )
)
def ablation_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.frames(spark, sf_dir).select("video_id", "luma", "clip_low")
    needs = {label: scores.needs_rescue(F.col("luma"), F.col("clip_low"), cfg) for label, cfg in ablations(CFG).items()}
    runs = rows.groupBy("video_id").agg(F.count("*").alias("n"), *[F.count_if(c).alias(label) for label, c in needs.items()])
    return runs.select("video_id", "n", F.explode(F.array(*[F.struct(F.lit(label).alias("label"), F.col(f"`{label}`").alias("to_rescue")) for label in needs])).alias("r")).select("r.label", "video_id", "n", "r.to_rescue")
