"""URL filter: rules, and for the rest a character language-model ratio.

Two smoothed variable-order Markov models, of accepted and of rejected URLs, predict each character from the up to ``order``
characters before it: a context that a model has not seen often enough gives way to the next shorter one, and each order is
interpolated with the one below it (Witten-Bell). A URL's score is the difference of the log-likelihoods divided by its length;
the threshold is calibrated on labelled URLs that the models were not trained on, where the mean of both classes' hit
rates is highest. Everything is DataFrame operations: character strings are counted, the models are tables of
distinct strings, and scores are sums over a join with them.

The training URLs are those that the rules decide; the models judge all others.

Defined results: a null url, or one without ``://``, has an empty host and path, fits no rule, and is judged as the text that it
is (null as empty); hosts are compared without the case of A-Z, paths with it; a host with a port does not fit a rule
without it; without training URLs of both classes the score is 0 and the verdict is allow; rows that repeat get equal verdicts
but count as often as they occur in training; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, shuffle_partitions

ORDER, MIN_CONTEXT, HOLD_OUT, BINS = 4, 2, 5, 400
#: Rows of the model that are sent to all executors at most, about 40 bytes each; beyond that the join shuffles.
BROADCAST_ROWS = 500_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
START, END = "\x02", "\x03"


@dataclass(frozen=True)
class UrlRule:
    """Fits ``host`` and its subdomains where the path starts with ``path``."""

    verdict: str
    host: str
    path: str = "/"

    @property
    def text(self) -> str:
        return self.host + self.path


RULES = (
    UrlRule("allow", "org"),
    UrlRule("block", "example.org", "/es/"),
    UrlRule("block", "example.org", "/en/1"),
    UrlRule("allow", "com", "/fr/"),
    UrlRule("block", "com", "/de/"),
)


def host_and_path(url: str) -> tuple[Column, Column]:
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def decide(rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict; null without one. Rules are a bounded parameter."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.text)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        rule, verdict = F.when(fits, F.lit(r.text)).otherwise(rule), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return rule, verdict


def _strings(urls: DataFrame, order: int) -> DataFrame:
    """A row for each character of each url, and its end: the string of the ``order`` characters before it and itself."""
    padded = F.concat(F.lit(START * order), F.col("key"), F.lit(END))
    urls = urls.repartition(shuffle_partitions(urls.sparkSession), "key")  # small rows, which grow here
    return urls.select("*", F.explode(F.transform(F.sequence(F.lit(1), F.length("key") + 1), lambda i: F.substring(padded, i, F.lit(order + 1)))).alias("gram"))


def train(urls: DataFrame, scratch: Scratch, order: int = ORDER, min_context: int = MIN_CONTEXT) -> DataFrame:
    """``gram, gain``: log p(last | before) among accepted less that among rejected, for every string of ``urls``.

    ``urls`` has ``key, accepted, rejected``: how often each url is in either training set. Strings that are in neither set are
    scored by the shorter ones.
    """
    counts = _strings(urls, order).groupBy("gram").agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r"))
    counts = scratch.save(counts, "grams")
    last = F.substring("gram", order + 1, 1)
    tops = counts.groupBy(last.alias("x")).agg(F.sum("a").alias("a"), F.sum("r").alias("r"))
    total = tops.agg(F.sum("a"), F.sum("r"), F.count_if(F.col("a") > 0), F.count_if(F.col("r") > 0), F.count("*")).first()
    n_a, n_r, t_a, t_r, letters = (int(x or 0) for x in total)
    flat = 1.0 / max(letters, 1)  # every character of the whole input is possible in both models
    mix = lambda n, t, c, below: (c + t * below) / (n + t)
    base = tops.select(
        F.col("x").alias("key0"),
        (mix(F.lit(n_a), F.lit(t_a), F.col("a"), F.lit(flat)) if n_a else F.lit(flat)).alias("pa"),
        (mix(F.lit(n_r), F.lit(t_r), F.col("r"), F.lit(flat)) if n_r else F.lit(flat)).alias("pr"),
    )
    level = scratch.save(base, "level0")
    for k in range(1, order + 1):
        key = F.substring("gram", order + 1 - k, k + 1)
        own = scratch.save(counts.groupBy(key.alias(f"key{k}")).agg(F.sum("a").alias("a"), F.sum("r").alias("r")), f"own{k}")
        before = own.groupBy(F.substring(f"key{k}", 1, k).alias("context")).agg(
            F.sum("a").alias("na"), F.sum("r").alias("nr"), F.count_if(F.col("a") > 0).alias("ta"), F.count_if(F.col("r") > 0).alias("tr")
        )
        met = own.withColumn("context", F.substring(f"key{k}", 1, k)).withColumn(f"key{k - 1}", F.substring(f"key{k}", 2, k)).join(before, "context").join(level, f"key{k - 1}")
        step = lambda n, t, c, p: F.when(F.col(n) >= min_context, mix(F.col(n), F.col(t), F.col(c), F.col(p))).otherwise(F.col(p))
        level = scratch.save(met.select(f"key{k}", step("na", "ta", "a", "pa").alias("pa"), step("nr", "tr", "r", "pr").alias("pr")), f"level{k}")
    return level.select(F.col(f"key{order}").alias("gram"), (F.log("pa") - F.log("pr")).alias("gain"))


def score(urls: DataFrame, model: DataFrame, order: int = ORDER, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``key, score`` for every row of ``urls``, whose keys are distinct."""
    if model.count() <= broadcast_rows:
        model = F.broadcast(model)
    met = _strings(urls.select("key"), order).join(model, "gram")
    summed = met.groupBy("key").agg(F.sum(F.round(F.col("gain") * 1e9).cast("decimal(38,0)")).alias("s"))  # whole parts: the order of addition does not matter
    return summed.select("key", F.round(F.col("s").cast("double") / 1e9 / (F.length("key") + 1), 9).alias("score"))


def calibrate(scored: DataFrame, bins: int = BINS) -> float:
    """The threshold with the highest mean hit rate on ``score, accepted, rejected``; of equal ones the nearest to 0."""
    at = F.floor(F.greatest(F.lit(-5.0), F.least(F.lit(5.0), F.col("score"))) * (bins / 10)).cast("int").alias("bin")
    rows = sorted((r["bin"], float(r["a"]), float(r["r"])) for r in scored.groupBy(at).agg(F.sum("accepted").alias("a"), F.sum("rejected").alias("r")).collect())
    total_a, total_r = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not total_a or not total_r:
        return 0.0
    table = {b: (a, r) for b, a, r in rows}
    best, below_a, below_r = (-math.inf, 0.0, 0.0), 0.0, 0.0
    for b in range(-bins // 2, bins // 2 + 2):
        rate = (1 - below_a / total_a + below_r / total_r) / 2
        edge = b * 10 / bins
        best = max(best, (round(rate, 12), -abs(edge), edge))
        a, r = table.get(b, (0.0, 0.0))
        below_a, below_r = below_a + a, below_r + r
    return best[2]


def judge(pages: DataFrame, *, rules: tuple[UrlRule, ...] = RULES, id_col: str = "page_id", url_col: str = "url", order: int = ORDER, min_context: int = MIN_CONTEXT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``, one row per row of ``pages``; scores of urls that a rule decides too."""
    scratch = Scratch(pages.sparkSession, "urls")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    host, path = host_and_path("url")
    rows = rows.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})
    rule, verdict = decide(rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict, "key": F.translate(F.coalesce("url", F.lit("")), UPPER, LOWER)})
    # distinct urls, each with how often it is in either set; a fifth of them, by hash, is held out for calibration
    is_in = lambda v: F.count_if(F.col("ruled") == v)
    keys = scratch.save(rows.groupBy("key").agg(is_in("allow").alias("accepted"), is_in("block").alias("rejected")), "keys")
    held = F.pmod(F.conv(F.substring(F.md5("key"), 1, 8), 16, 10).cast("long"), F.lit(HOLD_OUT)) == 0
    training = keys.select("key", *[F.when(held, 0).otherwise(F.col(c)).alias(c) for c in ("accepted", "rejected")])
    seen = training.agg(F.sum("accepted"), F.sum("rejected")).first()
    if seen[0] and seen[1]:
        scored = scratch.save(score(keys, train(training, scratch, order, min_context), order, broadcast_rows), "scores")
    else:
        scored = keys.select("key", F.lit(0.0).alias("score"))
    threshold = calibrate(scored.join(keys.where(held & ((F.col("accepted") > 0) | (F.col("rejected") > 0))), "key"))
    judged = rows.join(scored, "key")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.col("score") >= threshold, "allow").otherwise("block")).alias("verdict"), "score")
