"""Registered queries of the selection and recall operators, each over whole tables, with SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.config import SelectConfig
from tessera.functions import scores, text, vectors
from tessera.operators import fuzzy, gate, recall, sequence
from tessera.plans import adapters as ad
from tessera.plans.select import select_keyframes
from tessera.sources import frames as sampling
from tessera.sources import sinks
from tessera.sources.truth import shift_segments

CFG = SelectConfig(blur_neighbor_window_sec=ad.DAY, max_keyframes=8)
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

GATE_SQL = f"""
g0 AS (SELECT *, quantile_cont(lapvar, 0.5) OVER n AS near, count(*) FILTER (rescued) OVER n AS nr, quantile_cont(lapvar, 0.5) FILTER (rescued) OVER n AS mr,
              count(*) FILTER (NOT rescued) OVER n AS nn, quantile_cont(lapvar, 0.5) FILTER (NOT rescued) OVER n AS mn, quantile_cont(lapvar, 0.5) OVER (PARTITION BY video_id) AS whole
       FROM f WINDOW n AS (PARTITION BY video_id ORDER BY t RANGE BETWEEN {ad.DAY} PRECEDING AND {ad.DAY} FOLLOWING)),
g1 AS (SELECT *, greatest(0.6 * CASE WHEN rescued AND nr >= 3 THEN mr WHEN NOT rescued AND nn >= 3 THEN mn ELSE near END, 0.05 * whole) AS cut FROM g0),
g2 AS (SELECT *, CASE WHEN clip_low > 0.3 OR luma < 0.06 THEN 'underexposed' WHEN clip_high > 0.3 OR luma > 0.94 THEN 'overexposed' WHEN lapvar < 8 OR lapvar < cut THEN 'blur' END AS first FROM g1),
g AS (SELECT *, CASE WHEN count(*) FILTER (first IS NULL) OVER (PARTITION BY video_id) = 0 AND row_number() OVER (PARTITION BY video_id ORDER BY lapvar DESC, frame_index) = 1 THEN NULL ELSE first END AS reason FROM g2)"""
REFERENCE_SQL = """
w9 AS (SELECT video_id, quantile_cont(lapvar, 0.9) AS everything FROM f GROUP BY 1),
r9 AS (SELECT video_id, rescued, count(*) AS n, CASE WHEN count(*) >= 4 THEN quantile_cont(lapvar, 0.9) ELSE any_value(everything) END AS reference FROM f JOIN w9 USING (video_id) GROUP BY 1, 2)"""
_c = lambda x: f"greatest(0, least(1, {x}))"
SCORE_SQL = f"""
sc AS (SELECT f.*, {_c(f"0.65 * (0.4 * {_c('lapvar / greatest(reference, 1e-6)')} + 0.2 * {_c('1 - 2 * abs(luma - 0.5)')} + 0.15 * {_c('rms / 0.25')} + 0.1 * {_c('colorfulness / 60')} - 0.15 * {_c('clip_low + clip_high')} - 0.1 * {_c('noise / 12')}) + 0.35 * textness")} AS score
       FROM f JOIN r9 USING (video_id, rescued))"""


def query(sql: str = "") -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def _with(*parts: str) -> str:
    return "WITH " + ",".join(parts)


@query(_with(ad.FRAMES_SQL, GATE_SQL) + " SELECT video_id, coalesce(reason, 'kept') AS reason, count(*) AS n FROM g GROUP BY ALL")
def gate_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.gate(ad.frames(spark, sf_dir), CFG).groupBy("video_id", F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query(_with(ad.FRAMES_SQL, GATE_SQL) + " SELECT video_id, frame_index, round(cut, 6) AS cut FROM g1")
def neighbour_blur_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.blur_cuts(ad.frames(spark, sf_dir), CFG).select("video_id", "frame_index", F.round("cut", 6).alias("cut"))


@query(_with(ad.FRAMES_SQL, REFERENCE_SQL) + " SELECT video_id, rescued, n, round(reference, 6) AS reference FROM r9")
def stratified_p90(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.reference_sharpness(ad.frames(spark, sf_dir)).select("video_id", "rescued", "n", F.round("reference", 6).alias("reference"))


@query(_with(ad.FRAMES_SQL, REFERENCE_SQL, SCORE_SQL) + " SELECT video_id, frame_index, round(score, 6) AS score FROM sc QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY round(score, 9) DESC, frame_index) = 1")
def readability_top_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gate.readable(ad.frames(spark, sf_dir), CFG).withColumns({"score": F.round("score", 9), "shot_id": F.lit(0)})
    return sequence.representatives(rows).select("video_id", "frame_index", F.round("score", 6).alias("score"))


@query(
    _with(ad.FRAMES_SQL, GATE_SQL)
    + ", p AS (SELECT video_id, count(*) AS selected FROM (SELECT video_id FROM g WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY lapvar DESC, frame_index) <= 8) GROUP BY 1)"
    " SELECT video_id, count(*) AS decoded, count(*) FILTER (rescued) AS rescued, count(*) FILTER (reason IS NULL) AS after_gate, any_value(coalesce(selected, 0)) AS selected,"
    " round(1 - any_value(coalesce(selected, 0)) / count(*), 6) AS reduction_ratio FROM g LEFT JOIN p USING (video_id) GROUP BY video_id"
)
def funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = gate.gate(ad.frames(spark, sf_dir), CFG)
    kept = judged.where("reason is null")
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy(F.desc("lapvar"), "frame_index"))
    picked = kept.withColumn("_n", rank).where("_n <= 8")
    rows = gate.funnel(judged, kept.select("video_id", "frame_index", F.lit(0).alias("shot_id")), picked)
    return rows.select("video_id", "decoded", "rescued", "after_gate", "selected", F.round("reduction_ratio", 6).alias("reduction_ratio"))


@query(
    "WITH p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)"
    " SELECT user_id, event_id, (i // 5)::INT AS frame_index, (i // 5) / 2.0::DOUBLE AS t FROM p WHERE i % 5 = 0 AND i < 5 * 900"
)
def systematic_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sampling.sample_uniform(ad.table(spark, sf_dir, "events").select("user_id", "event_id", "ts"), "user_id", ["ts", "event_id"], step=5, fps=2.0)
    return rows.select("user_id", "event_id", "frame_index", "t")


@query(_with(ad.VECTORS_SQL) + " SELECT video_id, frame_index, round(sim, 6) AS sim FROM s")
def adjacent_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.adjacent_similarity(ad.vectors(spark, sf_dir)).select("video_id", "frame_index", F.round("sim", 6).alias("sim"))


@query(_with(ad.VECTORS_SQL) + " SELECT video_id, count(sim) AS n_pairs, round(CASE WHEN count(sim) >= 4 THEN least(0.05, quantile_disc(sim, 0.25)) ELSE 0.05 END, 6) AS threshold FROM s GROUP BY video_id")
def adaptive_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sequence.adaptive_threshold(sequence.adjacent_similarity(ad.vectors(spark, sf_dir)), 0.05)
    return rows.select("video_id", "n_pairs", F.round("threshold", 6).alias("threshold"))


SHOTS_SQL = """
sh(video_id, i, frame_index, shot_id, since, e1) AS (
  SELECT video_id, i, frame_index, 0, t, e[1] FROM s WHERE i = 1
  UNION ALL SELECT s.video_id, s.i, s.frame_index, CASE WHEN s.sim < 0.05 AND s.t - sh.since >= 20 THEN sh.shot_id + 1 ELSE sh.shot_id END,
                   CASE WHEN s.sim < 0.05 AND s.t - sh.since >= 20 THEN s.t ELSE sh.since END, s.e[1] FROM s JOIN sh ON s.video_id = sh.video_id AND s.i = sh.i + 1)"""


def _shots(rows: DataFrame) -> DataFrame:
    return sequence.segment(sequence.adjacent_similarity(rows), F.lit(0.05), 20.0)


@query("WITH RECURSIVE " + ad.VECTORS_SQL + "," + SHOTS_SQL + " SELECT video_id, frame_index, shot_id FROM sh")
def shot_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shots(ad.vectors(spark, sf_dir))


@query("WITH RECURSIVE " + ad.VECTORS_SQL + "," + SHOTS_SQL + " SELECT video_id, shot_id, frame_index FROM sh QUALIFY row_number() OVER (PARTITION BY video_id, shot_id ORDER BY e1 DESC, frame_index) = 1")
def shot_representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.vectors(spark, sf_dir)
    scored = rows.join(_shots(rows), ["video_id", "frame_index"]).withColumn("score", F.col("embedding")[0])
    return sequence.representatives(scored).select("video_id", "shot_id", "frame_index")


@query(
    "WITH RECURSIVE "
    + ad.VECTORS_SQL
    + """, k(video_id, i, frame_index, kept, own) AS (
  SELECT video_id, i, frame_index, [e], true FROM s WHERE i = 1
  UNION ALL SELECT s.video_id, s.i, s.frame_index,
     CASE WHEN list_max(list_transform(k.kept, lambda x: list_inner_product(x, s.e))) < 0.3 THEN list_append(k.kept, s.e) ELSE k.kept END,
     list_max(list_transform(k.kept, lambda x: list_inner_product(x, s.e))) < 0.3 FROM s JOIN k ON s.video_id = k.video_id AND s.i = k.i + 1)
SELECT video_id, frame_index FROM k WHERE own"""
)
def greedy_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.drop_near_duplicates(ad.vectors(spark, sf_dir), 0.3)


@query(
    "WITH RECURSIVE "
    + ad.VECTORS_SQL
    + """, k(video_id, step, frame_index, taken, chosen) AS (
  SELECT video_id, 1, frame_index, [frame_index], [e] FROM v QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY e[1] DESC, frame_index) = 1
  UNION ALL SELECT v.video_id, step + 1, v.frame_index, list_append(taken, v.frame_index), list_append(chosen, v.e) FROM v JOIN k ON v.video_id = k.video_id
  WHERE step < 8 AND NOT list_contains(taken, v.frame_index)
  QUALIFY row_number() OVER (PARTITION BY v.video_id ORDER BY list_max(list_transform(chosen, lambda x: list_inner_product(x, v.e))), v.e[1] DESC, v.frame_index) = 1)
SELECT video_id, frame_index FROM k"""
)
def kcenter_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.pick_diverse(ad.vectors(spark, sf_dir).withColumn("score", F.col("embedding")[0]), 8)


@query(
    "WITH RECURSIVE "
    + ad.FRAMES_SQL
    + """, q AS (SELECT video_id, frame_index, row_number() OVER (PARTITION BY video_id ORDER BY lapvar DESC, frame_index) AS i, floor(0.5 * count(*) OVER (PARTITION BY video_id) / 8)::INT AS gap FROM f),
k(video_id, i, frame_index, kept, own) AS (SELECT video_id, i, frame_index, [frame_index], true FROM q WHERE i = 1
  UNION ALL SELECT q.video_id, q.i, q.frame_index, CASE WHEN ok THEN list_append(kept, q.frame_index) ELSE kept END, ok
  FROM (SELECT q.*, k.kept, len(k.kept) < 8 AND len(list_filter(k.kept, lambda x: abs(x - q.frame_index) <= q.gap)) = 0 AS ok FROM q JOIN k ON q.video_id = k.video_id AND q.i = k.i + 1) q)
SELECT video_id, frame_index FROM k WHERE own"""
)
def temporal_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.frames(spark, sf_dir).select("video_id", "frame_index", F.col("lapvar").alias("score"))
    gaps = rows.groupBy("video_id").agg(scores.nms_gap(F.count("*"), 8).alias("gap"))
    return sequence.pick_spaced(rows.join(gaps, "video_id"), 8)


@query(
    _with(ad.VECTORS_SQL)
    + " SELECT a.video_id, a.frame_index, b.frame_index AS other, round(list_inner_product(a.e, b.e), 6) AS sim, row_number() OVER (PARTITION BY a.video_id, a.frame_index ORDER BY round(list_inner_product(a.e, b.e), 6) DESC, b.frame_index)::INT AS rank"
    " FROM v a JOIN v b ON a.video_id = b.video_id AND a.frame_index <> b.frame_index QUALIFY rank <= 3"
)
def allpairs_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.nearest(ad.vectors(spark, sf_dir), 3)


@query("WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT *, greatest(sqrt(list_inner_product(e, e)), 1e-8) AS n FROM v) SELECT vec_id, round(e[1] / n, 6) AS first, round(e[64] / n, 6) AS last, round(list_inner_product(e, e) / n / n, 6) AS length FROM n")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "embeddings").select("vec_id", vectors.l2_normalize(F.col("embedding")).alias("u"))
    return rows.select("vec_id", F.round(F.col("u")[0], 6).alias("first"), F.round(F.col("u")[63], 6).alias("last"), F.round(vectors.dot(F.col("u"), F.col("u")), 6).alias("length"))


FIRST_SQL = f"""
sg AS ({ad.segments_sql("signup")}),
pl AS (SELECT f.*, (SELECT arg_min(place_id, place_order) FROM sg WHERE sg.video_id = f.video_id AND f.t BETWEEN sg.a AND sg.b) AS place_id FROM f)"""


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recall.first_place(ad.frames(spark, sf_dir), ad.segments(spark, sf_dir, "signup"))


@query(_with(ad.FRAMES_SQL, FIRST_SQL) + " SELECT video_id, frame_index, place_id FROM pl")
def interval_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir).select("video_id", "frame_index", "place_id")


@query(
    _with(ad.FRAMES_SQL, FIRST_SQL)
    + ", sh AS (SELECT video_id, frame_index // 16 AS sheet, min(t) AS a, max(t) AS b FROM f GROUP BY ALL) SELECT sh.video_id, sheet, count(*) AS chapters, string_agg(place_id, ',' ORDER BY place_order) AS names FROM sg JOIN sh ON sg.video_id = sh.video_id AND sg.a <= sh.b AND sg.b >= sh.a GROUP BY ALL"
)
def interval_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = sinks.sheets(ad.frames(spark, sf_dir)).select("video_id", "sheet", F.col("first_t").alias("start"), F.col("last_t").alias("end"))
    met = recall.overlaps(ad.segments(spark, sf_dir, "signup"), sheets)
    names = F.array_sort(F.collect_list(F.struct("place_order", "place_id")))
    return met.groupBy("video_id", F.col("r_sheet").alias("sheet")).agg(F.count("*").alias("chapters"), F.array_join(F.transform(names, lambda x: x["place_id"]), ",").alias("names"))


@query(
    _with(ad.FRAMES_SQL)
    + f""", sg AS ({ad.segments_sql("purchase")}), d AS (SELECT video_id, unnest(range(0, greatest(0, floor((max(t) - 864000) / 86400))::BIGINT + 1)) AS w FROM f GROUP BY video_id),
n AS (SELECT d.video_id, w, count(DISTINCT place_id) AS places FROM d JOIN sg ON d.video_id = sg.video_id AND least(b, w * 86400.0 + 864000) - greatest(a, w * 86400.0) >= 43200 GROUP BY ALL)
SELECT video_id, w * 86400.0::DOUBLE AS start, w * 86400.0::DOUBLE + 864000 AS "end", places FROM n QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY places DESC, w) = 1"""
)
def best_coverage_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    durations = ad.frames(spark, sf_dir).groupBy("video_id").agg(F.max("t").alias("duration"))
    return recall.best_window(ad.segments(spark, sf_dir, "purchase"), durations, 10 * ad.DAY, ad.DAY, ad.DAY / 2)


@query(
    _with(ad.FRAMES_SQL, GATE_SQL, FIRST_SQL)
    + """, st AS (SELECT pl.video_id, pl.place_id, count(*) AS n_samples, count(*) FILTER (g.reason IS NULL) AS n_alive, count(*) FILTER (g.reason IS NULL AND pl.k > 60) AS n_keyframes,
     bool_or(g.reason IS NULL AND pl.k > 80) AS hit FROM pl JOIN g USING (video_id, frame_index) WHERE pl.place_id IS NOT NULL GROUP BY ALL),
j AS (SELECT sg.video_id, sg.place_id, coalesce(n_samples, 0) AS n_samples, coalesce(n_alive, 0) AS n_alive, coalesce(n_keyframes, 0) AS n_keyframes FROM sg LEFT JOIN st USING (video_id, place_id) WHERE NOT coalesce(hit, false))
SELECT *, CASE WHEN n_samples = 0 THEN 'no samples' WHEN n_alive = 0 THEN 'gate' WHEN n_keyframes = 0 THEN 'not selected' ELSE 'unreadable' END AS reason FROM j"""
)
def loss_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = _placed(spark, sf_dir)
    judged = gate.gate(ad.frames(spark, sf_dir), CFG)
    alive = judged.where("reason is null")
    hits = placed.join(alive.where("k > 80").select("video_id", "frame_index"), ["video_id", "frame_index"], "left_semi").where("place_id is not null").select("video_id", "place_id").distinct()
    places = ad.segments(spark, sf_dir, "signup").select("video_id", "place_id")
    return recall.loss_reasons(placed, judged.where("reason is not null"), alive.where("k > 60"), hits, places)


_SUBSETS = {"all": "true", "sign": "has_sign", "bright": "NOT dark", "dark": "dark"}


@query(
    "WITH x AS (SELECT lang AS split, source AS video_id, quality = 1 AS recovered, n_chars > 500 AS has_sign, toxic = 1 AS dark FROM labels JOIN documents USING (doc_id)) SELECT split, video_id, "
    + ", ".join(f"count(*) FILTER ({c}) AS {n}_places, count(*) FILTER ({c} AND recovered) AS {n}_recovered, round(count(*) FILTER ({c} AND recovered) / nullif(count(*) FILTER ({c}), 0), 6) AS {n}_recall" for n, c in _SUBSETS.items())
    + " FROM x GROUP BY ROLLUP (split, video_id)"
)
def recall_by_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("split"), F.col("source").alias("video_id"), (F.col("n_chars") > 500).alias("has_sign"))
    facts = ad.table(spark, sf_dir, "labels").join(docs, "doc_id").withColumns({"recovered": F.col("quality") == 1, "dark": F.col("toxic") == 1})
    rows = recall.recall_by_subset(facts)
    return rows.select([F.round(c, 6).alias(c) if c.endswith("_recall") else F.col(c) for c in rows.columns])


@query(
    "WITH x AS (SELECT source, count(*) AS n, count(*) FILTER (toxic = 1) AS m FROM labels JOIN documents USING (doc_id) GROUP BY source), i AS (SELECT x.*, unnest(range(least(16, n))) AS i FROM x)"
    " SELECT source, n, m, round(CASE WHEN m = 0 THEN 0 WHEN bool_or(n - m - i <= 0) THEN 1 ELSE 1 - exp(sum(ln(greatest(n - m - i, 1) / (n - i)))) END, 6) AS expected FROM i GROUP BY source, n, m"
)
def random_expectation(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ad.table(spark, sf_dir, "documents").select("doc_id", "source")
    rows = ad.table(spark, sf_dir, "labels").join(docs, "doc_id").groupBy("source").agg(F.count("*").alias("n"), F.count_if(F.col("toxic") == 1).alias("m"))
    return rows.select("source", "n", "m", F.round(scores.random_hit(F.col("n"), F.col("m"), 16), 6).alias("expected"))


def _plain(c: str) -> F.Column:
    upper = F.translate(F.coalesce(F.col(c), F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return F.trim(F.regexp_replace(upper, "[^A-Z0-9]+", " "))


_PLAIN_SQL = "trim(regexp_replace(translate(coalesce(text, ''), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ'), '[^A-Z0-9]+', ' ', 'g'))"


def _candidates(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    """``doc_id, item_id, doc_plain, item_plain`` of texts that share a run of ``n`` plain words, or as many as a shorter item has; no text meets all others."""

    def runs(rows: DataFrame, key: str, k: int) -> DataFrame:
        w = rows.select(key, F.split("plain", " ").alias("w"))
        grams = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.xxhash64(F.array_join(F.slice("w", i + 1, k), " ")))
        return w.where(F.size("w") >= k).select(key, F.explode(F.array_distinct(grams)).alias("g"))

    docs = ad.table(spark, sf_dir, "documents").select("doc_id", _plain("text").alias("plain"))
    items = ad.table(spark, sf_dir, "benchmark").select("item_id", _plain("text").alias("plain")).where("plain <> ''")
    length = F.least(F.size(F.split("plain", " ")), F.lit(n))
    pairs = None
    for k in sorted(r[0] for r in items.select(length).distinct().collect()) or [n]:
        met = runs(docs, "doc_id", k).join(runs(items.where(length == k), "item_id", k), "g").select("doc_id", "item_id").distinct()
        pairs = met if pairs is None else pairs.union(met)
    return pairs.join(docs.withColumnRenamed("plain", "doc_plain"), "doc_id").join(items.withColumnRenamed("plain", "item_plain"), "item_id")


@query(f"WITH d AS (SELECT doc_id, {_PLAIN_SQL} AS p FROM documents), i AS (SELECT item_id, {_PLAIN_SQL} AS p FROM benchmark) SELECT doc_id, item_id FROM d, i WHERE contains(' ' || d.p || ' ', ' ' || i.p || ' ') AND i.p <> ''")
def exact_contains_ascii(spark: SparkSession, sf_dir: str) -> DataFrame:
    pad = lambda c: F.concat(F.lit(" "), F.col(c), F.lit(" "))
    return _candidates(spark, sf_dir, 5).where(F.contains(pad("doc_plain"), pad("item_plain"))).select("doc_id", "item_id")


@query()
def fuzzy_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = fuzzy.match(ad.table(spark, sf_dir, "documents").select("doc_id", "text"), ad.table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return met.select("doc_id", "item_id", F.round("similarity", 6).alias("similarity"))


@query(
    "WITH x AS (SELECT o_orderkey, (o_orderkey * 7 % 20000) AS s FROM orders) SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || ':' || lpad((s // 60 % 60)::VARCHAR, 2, '0') || ':' || lpad((s % 60)::VARCHAR, 2, '0') ELSE (s // 60) || ':' || lpad((s % 60)::VARCHAR, 2, '0') END AS shown, s::DOUBLE AS seconds FROM x"
)
def parse_format_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "orders").select("o_orderkey", text.format_time(F.col("o_orderkey") * 7 % 20000).alias("shown"))
    return rows.withColumn("seconds", text.parse_time(F.col("shown")))


@query(
    r"SELECT page_id, regexp_matches(regexp_extract(url, '//([^./]*)\.', 1), '^[a-z0-9][a-z0-9-]*$') AS valid, regexp_extract(url, '/([a-z]{2})/(\d+)', 2) AS number,"
    f" nullif(regexp_extract('see youtu.be/' || left(replace(url, '/', '_'), 11) || '?t=1', '{text.VIDEO_ID}', 1), '') AS youtube_id FROM pages"
)
def url_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return ad.table(spark, sf_dir, "pages").select("page_id", text.is_key(F.regexp_extract(url, r"//([^./]*)\.", 1)).alias("valid"), F.regexp_extract(url, r"/([a-z]{2})/(\d+)", 2).alias("number"), text.youtube_id(F.concat(F.lit("see youtu.be/"), F.left(F.replace(url, F.lit("/"), F.lit("_")), F.lit(11)), F.lit("?t=1"))).alias("youtube_id"))


@query(
    _with(ad.FRAMES_SQL, FIRST_SQL)
    + ", m AS (SELECT video_id, place_id, quantile_cont(luma, 0.5) < 0.18 AS dim FROM pl WHERE place_id IS NOT NULL GROUP BY ALL) SELECT sg.video_id, sg.place_id, coalesce(CASE WHEN place_order % 5 = 0 THEN true END, dim, false) AS dark FROM sg LEFT JOIN m USING (video_id, place_id)"
)
def dark_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    places = ad.segments(spark, sf_dir, "signup").select("video_id", "place_id", F.when(F.col("place_order") % 5 == 0, True).alias("dark"))
    return recall.dark_flags(_placed(spark, sf_dir), places)


@query(_with(ad.FRAMES_SQL) + " SELECT video_id, frame_index, luma, row_number() OVER (PARTITION BY video_id ORDER BY luma, frame_index)::INT AS rank FROM f QUALIFY rank <= 3")
def darkest_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("video_id").orderBy("luma", "frame_index"))
    return ad.frames(spark, sf_dir).select("video_id", "frame_index", "luma", rank.alias("rank")).where("rank <= 3")


@query(
    _with(ad.FRAMES_SQL, GATE_SQL)
    + " SELECT video_id, frame_index, printf('%.4f', luma) AS luma, printf('%.3f', noise) AS noise, (reason IS NULL AND k > 60)::INT AS selected, coalesce(reason, '') AS reject_reason FROM g"
)
def csv_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = gate.gate(ad.frames(spark, sf_dir), CFG)
    rows = sinks.csv_rows(judged.select("video_id", "frame_index", "t", "luma", "noise"), judged.where("reason is null and k > 60"), judged.where("reason is not null"))
    return rows.select("video_id", "frame_index", "luma", "noise", "selected", "reject_reason")  # t is rounded otherwise in SQL


@query(SQL["funnel"].replace("SELECT video_id, count(*) AS decoded", "SELECT video_id, 258 * decoded AS tokens_before, 258 * selected AS tokens_after, 258 * (decoded - selected) AS tokens_saved FROM (SELECT video_id, count(*) AS decoded", 1) + ")")
def token_savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.token_savings(funnel(spark, sf_dir))


@query(
    "WITH a AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND value > 100), b AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 100)"
    " SELECT 'difference' AS op, user_id FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'intersection', user_id FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'union', user_id FROM (FROM a UNION FROM b)"
)
def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.table(spark, sf_dir, "events").where("value > 100").select("user_id", "event_type")
    a, b = (rows.where(F.col("event_type") == e).select("user_id") for e in ("error", "purchase"))
    named = lambda op, r: r.select(F.lit(op).alias("op"), "user_id")
    return named("difference", a.exceptAll(b).distinct().join(b, "user_id", "left_anti")).unionByName(named("intersection", a.intersect(b))).unionByName(named("union", a.union(b).distinct()))


@query("SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING') GROUP BY ALL")
def owner_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = ad.table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    rows = ad.table(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus", "o_totalprice").join(own, "o_custkey", "left_semi")
    return rows.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("o_totalprice").cast("decimal(20,4)")), 2).cast("double").alias("total"))


@query(
    _with(ad.FRAMES_SQL)
    + " SELECT video_id, frame_index, CASE WHEN luma < 0.015 OR clip_low > 0.65 THEN false ELSE luma < 0.18 OR clip_low >= 0.12 END AS rescue, coalesce(CASE WHEN rescued THEN lapvar * 2 END, lapvar) AS lapvar, coalesce(CASE WHEN k % 3 = 0 THEN textness END >= textness - 0.03, false) AS keeps FROM f"
)
def rescue_and_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    better = F.when(F.col("rescued"), F.col("lapvar") * 2)
    guard = F.coalesce(scores.keeps_enhanced(F.when(F.col("k") % 3 == 0, F.col("textness")), F.col("textness"), CFG.enhance_textness_drop_limit), F.lit(False))
    return ad.frames(spark, sf_dir).select("video_id", "frame_index", scores.needs_rescue(F.col("luma"), F.col("clip_low"), CFG).alias("rescue"), scores.effective(F.col("lapvar"), better).alias("lapvar"), guard.alias("keeps"))


@query(
    _with(ad.FRAMES_SQL)
    + f", sg AS ({ad.segments_sql('signup')}) SELECT video_id, place_id, greatest(a, 172800) - 172800 AS start, least(b, 1209600) - 172800 AS \"end\" FROM sg WHERE least(b, 1209600) > greatest(a, 172800)"
)
def clip_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ad.segments(spark, sf_dir, "signup").select("video_id", "place_id", F.array(F.struct("start", "end")).alias("s"))
    moved = rows.select("video_id", "place_id", F.explode(shift_segments(F.col("s"), F.lit(2 * ad.DAY), F.lit(14 * ad.DAY))).alias("x"))
    return moved.select("video_id", "place_id", "x.start", "x.end")


@query(
    _with(ad.FRAMES_SQL)
    + ", d AS (SELECT video_id, frame_index // 16 AS sheet, min(t) AS first_t, max(t) AS last_t, count(*) AS n FROM f GROUP BY ALL) SELECT video_id, sheet, round(first_t, 6) AS first_t, round(last_t, 6) AS last_t, n FROM d"
)
def contact_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.sheets(ad.frames(spark, sf_dir)).select("video_id", "sheet", F.round("first_t", 6).alias("first_t"), F.round("last_t", 6).alias("last_t"), "n")


@query("WITH h AS (SELECT sha256(coalesce(text, '')) AS key, doc_id FROM documents), c AS (SELECT DISTINCT sha256(coalesce(text, '')) AS key FROM documents WHERE lang = 'en') SELECT key IN (SELECT key FROM c) AS hit, count(*) AS n, count(DISTINCT key) AS texts FROM h GROUP BY 1")
def recognition_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ad.table(spark, sf_dir, "documents").select("lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"))
    hit, left = sinks.cached(docs.select("key"), docs.where("lang = 'en'").select("key").distinct(), "key")
    count = lambda rows, h: rows.agg(F.lit(h).alias("hit"), F.count("*").alias("n"), F.countDistinct("key").alias("texts")).where("n > 0")
    return count(hit, True).union(count(left, False))


@query("SELECT p_partkey, CASE WHEN greatest(w, h) <= 1280 THEN w ELSE (floor(w * 1280 / greatest(w, h) / 2) * 2)::INT END AS width, CASE WHEN greatest(w, h) <= 1280 THEN h ELSE (floor(h * 1280 / greatest(w, h) / 2) * 2)::INT END AS height FROM (SELECT p_partkey, p_size * 60 AS w, (p_partkey % 31 * 70 + 10)::INT AS h FROM part)")
def scaled_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("p_size") * 60, (F.col("p_partkey") % 31 * 70 + 10).cast("int")
    width, height = scores.scaled_size(w, h, 1280)
    return ad.table(spark, sf_dir, "part").select("p_partkey", width.alias("width"), height.alias("height"))


def _selection(spark: SparkSession, sf_dir: str):  # noqa: ANN202
    """Frames take the embedding whose number is their event's, modulo the number of embeddings."""
    table = ad.table(spark, sf_dir, "embeddings")
    rows = ad.frames(spark, sf_dir).withColumn("v", F.pmod("event_id", F.lit(table.count()))).join(table.select(F.col("vec_id").alias("v"), "embedding"), "v")
    cfg = SelectConfig(blur_neighbor_window_sec=ad.DAY, max_keyframes=8, scene_similarity_threshold=0.05, duplicate_shot_threshold=0.3, min_shot_gap_sec=ad.DAY)
    return select_keyframes(rows, cfg)


@query()
def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(spark, sf_dir).keyframes


@query()
def selection_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(spark, sf_dir).summary
