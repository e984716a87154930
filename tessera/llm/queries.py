"""One query per operator, over the whole of its table, and SQL for those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, exact_dedup, html_extract, lsh_forest, mixing, quality, suffix_dedup, tool_calls, url_filter, warc
from tessera.llm.common import Scratch


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> bpe.Vocabulary:
    import public_tokenizers

    return bpe.Vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def fresh_index(spark: SparkSession) -> exact_dedup.DigestIndex:
    """An index that holds nothing yet, for one run."""
    return exact_dedup.DigestIndex(spark, "digests_" + uuid.uuid4().hex)


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.rate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return rated.drop("draw")


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(_table(spark, sf_dir, "pages"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    index = fresh_index(spark)
    decided = exact_dedup.dedup(docs, index)
    index.remove(files=True)  # what is decided no longer reads it
    return decided.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex(exact_dedup.DIGEST)).alias("text_sha256"))


OP3_SQL = """
SELECT doc_id, keep_id, group_size, kept AND copy = 1 AS kept, text_sha256
FROM (SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
             doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept,
             row_number() OVER (PARTITION BY coalesce(text, ''), doc_id) AS copy, sha256(coalesce(text, '')) AS text_sha256
      FROM documents WINDOW g AS (PARTITION BY coalesce(text, '')))
"""


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    warc.write_warc(_table(spark, sf_dir, "pages"), scratch.path("archive"), scratch)
    found = warc.read_warc(spark, scratch.path("archive"), with_payload=False).where("kind = 'record'")
    return found.select(
        warc.page_of("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", warc.page_of("refers_to").alias("refers_to")
    )


OP4_SQL = """
WITH RECURSIVE p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS hexed, min(page_id) OVER (PARTITION BY sha1(body)) AS first FROM p),
digits AS (SELECT i, ('0x' || substr(hexed, 1 + 5 * i, 5))::BIGINT AS v, d.* FROM d, range(8) t(i)),
spelt AS (SELECT page_id, payload_bytes, first,
  string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v >> 15)::INT, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 10) & 31)::INT, 1)
  || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((v >> 5) & 31)::INT, 1) || substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + (v & 31)::INT, 1), '' ORDER BY i) AS payload_digest
  FROM digits GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM spelt
"""


def op5_tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = _table(spark, sf_dir, "conversations")
    return tool_calls.link(tool_calls.calls_of(messages), tool_calls.results_of(messages))


OP5_SQL = r"""
WITH RECURSIVE m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
c AS (SELECT conv_id, 'call-' || turn AS call_id, turn, min(text) AS text, count(*) AS n_calls FROM m WHERE role = 'user' GROUP BY ALL),
a AS (SELECT *, len(regexp_extract_all(text, '\S+')) AS words, CASE WHEN turn >= 2 THEN 'call-' || (turn - 2) END AS dep FROM c),
l(conv_id, call_id, level) AS (
  SELECT conv_id, call_id, 0 FROM a WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = a.conv_id AND c.call_id = a.dep)
  UNION ALL SELECT a.conv_id, a.call_id, l.level + 1 FROM a JOIN l ON a.conv_id = l.conv_id AND a.dep = l.call_id),
r AS (SELECT conv_id, 'call-' || (turn - 1) AS call_id, min(turn) AS result_turn, arg_min(text, (turn, text)) AS content, count(*) AS n_results FROM m WHERE role = 'assistant' GROUP BY ALL),
e AS (SELECT a.*, level, dep IS NOT NULL AND NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = a.conv_id AND c.call_id = a.dep) AS unknown FROM a JOIN l USING (conv_id, call_id)),
j AS (SELECT coalesce(e.conv_id, r.conv_id) AS conv_id, coalesce(e.call_id, r.call_id) AS call_id, e.turn, text, words, n_calls, level, unknown, result_turn, content, n_results
      FROM e FULL JOIN r ON e.conv_id = r.conv_id AND e.call_id = r.call_id),
w AS (SELECT *, CASE WHEN n_calls IS NULL THEN '' ELSE concat_ws('; ', CASE WHEN length(text) < 1 THEN 'query is below 1' WHEN length(text) > 4000 THEN 'query is above 4000' END,
      CASE WHEN words < 1 THEN 'words is below 1' WHEN words > 64 THEN 'words is above 64' END, CASE WHEN unknown THEN 'a dependency is not known' END) END AS errors FROM j)
SELECT conv_id, call_id, CASE WHEN n_calls IS NOT NULL THEN 'answer' END AS name, turn, result_turn, level, coalesce(n_calls, 0) AS n_calls, coalesce(n_results, 0) AS n_results,
       CASE WHEN n_calls IS NULL THEN 'orphan result' WHEN n_results IS NULL THEN 'unanswered' ELSE 'linked' END AS status, errors = '' AS valid, errors,
       '{"arguments":' || coalesce('{"query":' || to_json(text) || ',"words":' || words || '}', 'null') || ',"id":' || to_json(call_id) || ',"level":' || coalesce(level::VARCHAR, 'null')
       || ',"name":' || CASE WHEN n_calls IS NULL THEN 'null' ELSE '"answer"' END || ',"result":' || coalesce(to_json(content)::VARCHAR, 'null') || '}' AS canonical_json
FROM w
"""


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _held(r: quality.Rule) -> str:
    return " AND ".join([f"{r.metric} >= {r.low}"] * (r.low is not None) + [f"{r.metric} <= {r.high}"] * (r.high is not None))


OP6_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda line: regexp_matches(line, '[^\x20\x09-\x0D]')) AS lines FROM d),
w AS (SELECT r, unnest(words) AS word, unnest(range(len(words))) AS i FROM t),
s AS (SELECT r, i, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS gram FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS n FROM s WHERE gram IS NOT NULL) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(3) x(k) GROUP BY r),
m AS (SELECT doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, length(regexp_replace(text, '[^!\p{{Lu}}]', '', 'g')) AS n_shouts,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(list_filter(words, lambda x: lower(x) IN ({", ".join(f"'{w}'" for w in sorted(set(quality.STOP_WORDS)))}))) AS n_stop_words
      FROM t LEFT JOIN rep USING (r)),
q AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_chars, coalesce(n_symbols / nullif(word_chars, 0), 0) AS symbol_ratio,
             coalesce(n_stop_words / nullif(n_words, 0), 0) AS stop_word_ratio, coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio,
             coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_word_ratio, coalesce(n_shouts / nullif(word_chars, 0), 0) AS shout_ratio,
             n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(_held(r) for r in quality.RULES)} AS kept
FROM q
"""


def op7_url_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages")).drop("score")


def _op7_sql() -> str:
    """The rules, the counts of each order, the interpolation from the shortest context up, and the calibration."""
    u, m = url_filter, url_filter.ORDER
    fits = lambda r: f"(host = '{r.host}' OR suffix(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    longest = sorted(u.RULES, key=lambda r: -len(r.text))
    levels = ""
    for k in range(1, m + 1):
        levels += f"""
o{k} AS (SELECT substr(gram, {m + 1 - k}, {k + 1}) AS s, sum(a) AS a, sum(r) AS r FROM g GROUP BY 1),
c{k} AS (SELECT substr(s, 1, {k}) AS c, sum(a) AS na, sum(r) AS nr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr FROM o{k} GROUP BY 1),
l{k} AS (SELECT o.s, CASE WHEN na >= {u.MIN_CONTEXT} THEN (o.a + ta * l.pa) / (na + ta) ELSE l.pa END AS pa,
                CASE WHEN nr >= {u.MIN_CONTEXT} THEN (o.r + tr * l.pr) / (nr + tr) ELSE l.pr END AS pr
         FROM o{k} o JOIN c{k} c ON substr(o.s, 1, {k}) = c.c JOIN l{k - 1} l ON substr(o.s, 2, {k}) = l.s),"""
    cases = lambda f: " ".join(f"WHEN {fits(r)} THEN '{f(r)}'" for r in longest)
    half = u.BINS // 2
    return f"""
WITH x AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM x),
p AS (SELECT page_id, translate(raw, '{u.UPPER}', '{u.LOWER}') AS host, regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path, translate(url, '{u.UPPER}', '{u.LOWER}') AS key FROM h),
d AS (SELECT *, CASE {cases(lambda r: r.text)} END AS rule, CASE {cases(lambda r: r.verdict)} END AS ruled FROM p),
k AS (SELECT key, count(*) FILTER (ruled = 'allow') AS accepted, count(*) FILTER (ruled = 'block') AS rejected, ('0x' || substr(md5(key), 1, 8))::BIGINT % {u.HOLD_OUT} = 0 AS held FROM d GROUP BY key),
z AS (SELECT key, substr(repeat(chr(2), {m}) || key || chr(3), unnest(range(1, length(key) + 2)), {m + 1}) AS gram,
             CASE WHEN held THEN 0 ELSE accepted END AS a, CASE WHEN held THEN 0 ELSE rejected END AS r FROM k),
g AS (SELECT gram, sum(a) AS a, sum(r) AS r FROM z GROUP BY gram),
o0 AS (SELECT substr(gram, {m + 1}, 1) AS s, sum(a) AS a, sum(r) AS r FROM g GROUP BY 1),
t AS (SELECT sum(a) AS na, sum(r) AS nr, count(*) FILTER (a > 0) AS ta, count(*) FILTER (r > 0) AS tr, count(*) AS letters FROM o0),
l0 AS (SELECT s, (a + ta / letters) / (na + ta) AS pa, (r + tr / letters) / (nr + tr) AS pr FROM o0, t),{levels}
q AS (SELECT key, round(sum(round((ln(pa) - ln(pr)) * 1e9)) / 1e9 / (length(key) + 1), 9) AS score FROM z JOIN l{m} ON gram = s GROUP BY key),
b AS (SELECT floor(greatest(-5, least(5, score)) * {u.BINS / 10})::INT AS bin, sum(accepted) AS a, sum(rejected) AS r FROM q JOIN k USING (key) WHERE held AND accepted + rejected > 0 GROUP BY 1),
e AS (SELECT i, i * 10 / {u.BINS} AS edge, round((1 - coalesce(sum(a) FILTER (bin < i), 0) / sum(a) + coalesce(sum(r) FILTER (bin < i), 0) / sum(r)) / 2, 12) AS rate FROM range(-{half}, {half + 2}) v(i), b GROUP BY i),
best AS (SELECT edge FROM e ORDER BY rate DESC, abs(edge), edge DESC LIMIT 1)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= (SELECT edge FROM best) THEN 'allow' ELSE 'block' END) AS verdict FROM d JOIN q USING (key)
"""


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.similar(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


OP8_SQL = r"""
WITH RECURSIVE t AS (SELECT coalesce(text, '') AS text, min(doc_id) AS least, count(*) AS n_copies FROM documents GROUP BY 1),
w AS (SELECT text, regexp_extract_all(text, '\S+') AS words FROM t),
s AS (SELECT DISTINCT text, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ') ELSE array_to_string(words[i:i + 4], ' ') END AS g
      FROM (SELECT text, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)),
k AS (SELECT text, count(*) AS n FROM s GROUP BY text),
p AS (SELECT a.text AS a, b.text AS b, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.text <> b.text GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN k x ON a = x.text JOIN k y ON b = y.text WHERE 10 * common >= 8 * (x.n + y.n - common)),
r(a, b) AS (SELECT text, text FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS text, min(least) AS class_id FROM r JOIN t ON r.b = t.text GROUP BY a),
d AS (SELECT a AS text, count(*) AS n_links FROM e GROUP BY a)
SELECT doc_id, class_id, coalesce(n_links, 0) AS n_links, n_copies
FROM documents JOIN t ON coalesce(documents.text, '') = t.text JOIN c ON c.text = t.text LEFT JOIN d ON d.text = t.text
"""


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_table(spark, sf_dir, "documents"), vocabulary())


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"), with_text=False).drop("kept")


OP10_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, doc_id, unnest(range(greatest(length(h) // 2 - 49, 0))) AS i, h FROM d),
g AS (SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS gram FROM w),
f AS (SELECT gram, min(doc_id) AS first FROM g GROUP BY gram),
bad AS (SELECT r, i, i - lag(i) OVER (PARTITION BY r ORDER BY i) AS step FROM g JOIN f USING (gram) WHERE first < doc_id),
isl AS (SELECT r, i, sum(CASE WHEN step <= 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY i) AS island FROM bad),
spans AS (SELECT r, island, min(i) AS a, max(i) + 50 AS b FROM isl GROUP BY r, island),
cut AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS prev FROM spans),
kept AS (SELECT r, count(*) AS n_spans, sum(b - a)::BIGINT AS n_removed, max(b) AS last,
                string_agg(substr(h, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS head FROM cut JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_soft_mixing": op1_soft_mixing,
        "op2_site_style_tree": op2_site_style_tree,
        "op3_exact_dedup": op3_exact_dedup,
        "op4_warc": op4_warc,
        "op5_tool_call_linking": op5_tool_call_linking,
        "op6_quality_rules": op6_quality_rules,
        "op7_url_language_model": op7_url_language_model,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_suffix_array_dedup": op10_suffix_array_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_exact_dedup": OP3_SQL,
        "op4_warc": OP4_SQL,
        "op5_tool_call_linking": OP5_SQL,
        "op6_quality_rules": OP6_SQL,
        "op7_url_language_model": _op7_sql(),
        "op8_ngram_jaccard_join": OP8_SQL,
        "op10_suffix_array_dedup": OP10_SQL,
    }
