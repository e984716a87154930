"""Mixing sources to target weights by soft membership.

1. A softmax classifier, fitted on a bounded sample of labelled documents, predicts each document's posterior over domains
   from hashed words and a few ratios.
2. Document rates are fitted so that the expected tokens of each domain, ``sum_d r_d tokens_d p_d``, match the targets, by
   least squares over the domains, each weighed by its present tokens. A rate is at least 0, and at least 1 where the likeliest
   domain is protected, so that no such document goes. Projected gradient descent with momentum starts at r = 1 and takes
   gradients in the metric of the documents' tokens, so a rate depends on the posterior and not on the length:
   ``r <- max(bound, r - eta p . residual / tokens)``. One pass over the documents gathers the sums of a step; the driver
   keeps only the last steps, from which every document recomputes its own rate; every few steps rates are written.
3. ``mix`` realises a rate as whole copies: its floor, and one more with the chance of the rest, drawn from a hash of id
   and text.

Targets: ``weights`` are shares of tokens. Without a ``budget`` the total is fitted with the rates: it starts as the least that
holds what the bounds keep, and grows, to ``growth`` times the input at most, where the shares cannot be met else. ``Fit`` tells
the targets and what was reached, which differ where documents that meet the targets are not there.

Defined results: null texts count as empty and have no tokens; labels with nulls, or of documents that are absent, are not
used; of labels that conflict the worse stands (toxic, then low), and of texts with one id the least is learned from; without
usable labels every posterior is uniform; domains without weight have the target 0; rows that repeat get equal rates; null
ids pass through; an empty table gives no rows. Other columns are not read (``mix`` keeps all).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, map_arrow, row_of

DOMAINS = ("clean", "low", "toxic")
WEIGHTS = {"clean": 0.85, "low": 0.11, "toxic": 0.04}
PROTECTED = ("clean", "low")
DIMENSIONS = 1 << 18
DENSE = 6


def domain_of(labels: DataFrame) -> Column:
    """The index of a label's domain: toxic before low quality; null if a label is missing."""
    return F.when(labels["toxic"].isNull() | labels["quality"].isNull(), None).when(labels["toxic"] == 1, 2).when(labels["quality"] == 0, 1).otherwise(0)


class Features:
    """Distinct hashed words of a text and ratios of its shape; word hashes are remembered up to a bound."""

    def __init__(self, remember: int = 300_000) -> None:
        self.remember, self.cache = remember, {}

    def __call__(self, text: str | None) -> tuple[np.ndarray, np.ndarray, int]:
        import xxhash

        text = text or ""
        words = text.split()
        cache = self.cache
        if len(cache) > self.remember:
            cache.clear()
        found = set()
        for w in set(words):
            c = cache.get(w)
            if c is None:
                c = cache[w] = xxhash.xxh32_intdigest(w.strip(".,;:!?\"'()").lower()) % DIMENSIONS
            found.add(c)
        n, chars = max(len(words), 1), max(len(text), 1)
        symbols = sum(map(text.count, "#*$%&|<>"))
        dense = np.array([min(symbols / n, 1.0), min(text.count("!") / n, 1.0), min(text.count("|") / n, 1.0), len(set(words)) / n, min(chars / n / 10, 3.0), np.log1p(len(words)) / 10], np.float32)
        return np.fromiter(found, np.int64, len(found)), dense, len(words)


@dataclass(frozen=True)
class Classifier:
    """Softmax weights of the words that enough sampled documents have; its size is bounded by the sample's."""

    words: np.ndarray  # sorted hashed words
    weights: np.ndarray  # a row for each word, for each ratio, and the bias

    def posterior(self, found: np.ndarray, dense: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.words, found)
        at = at[(at < len(self.words)) & (self.words[np.minimum(at, len(self.words) - 1)] == found)] if len(self.words) else at[:0]
        k = len(self.words)
        z = self.weights[at].sum(axis=0) + dense @ self.weights[k : k + DENSE] + self.weights[-1]
        z = np.exp(z - z.max())
        return z / z.sum()


def _telling(samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, min_docs: int, least: float) -> np.ndarray:
    """Sorted words whose presence goes with some class, by the chi-square statistic of its two-by-two table."""
    label = np.repeat([s[2] for s in samples], [len(s[0]) for s in samples])
    every, at = np.unique(np.concatenate([s[0] for s in samples]), return_inverse=True)
    have = np.stack([np.bincount(at[label == c], minlength=len(every)) for c in range(classes)])
    size = np.bincount([s[2] for s in samples], minlength=classes)
    n, best = len(samples), np.zeros(len(every))
    total = have.sum(axis=0)
    for c in range(classes):
        a, b = have[c], total - have[c]
        below = total * (n - total) * float(size[c]) * float(n - size[c])
        best = np.maximum(best, np.where(below > 0, n * (a * float(n - size[c]) - b * float(size[c])) ** 2 / np.maximum(below, 1), 0))
    return every[(total >= min_docs) & (best >= least)]


def fit(
    samples: list[tuple[np.ndarray, np.ndarray, int]], classes: int, min_docs: int = 5, least: float = 40.0, steps: int = 300, rate: float = 0.05, ridge: float = 1e-4
) -> Classifier:
    """Full-batch Adam on ``(words, ratios, class)``; without samples, all classes are equally likely."""
    if not samples:
        return Classifier(np.empty(0, np.int64), np.zeros((DENSE + 1, classes)))
    words = _telling(samples, classes, min_docs, least)
    rows, cols = [], []
    for i, (found, _, _) in enumerate(samples):
        at = np.searchsorted(words, found)
        at = at[(at < len(words)) & (words[np.minimum(at, max(len(words) - 1, 0))] == found)] if len(words) else np.empty(0, np.int64)
        rows.append(np.full(len(at), i))
        cols.append(at)
    row, col = np.concatenate(rows), np.concatenate(cols)
    dense = np.stack([s[1] for s in samples]).astype(np.float64)
    dense = np.hstack([dense, np.ones((len(samples), 1))])
    y = np.eye(classes)[[s[2] for s in samples]]
    k = len(words)
    w = np.zeros((k + DENSE + 1, classes))
    w[-1] = np.log(y.mean(axis=0) + 1e-3)
    m, v = np.zeros_like(w), np.zeros_like(w)
    by_col = np.argsort(col, kind="stable")
    used, starts = np.unique(col[by_col], return_index=True)
    starts_row = np.searchsorted(row, np.arange(len(samples)))
    has = np.bincount(row, minlength=len(samples)) > 0
    for t in range(1, steps + 1):
        z = dense @ w[k:]
        if len(col):
            part = np.add.reduceat(w[col], np.minimum(starts_row, len(col) - 1), axis=0)
            z += np.where(has[:, None], part, 0)
        z -= z.max(axis=1, keepdims=True)
        p = np.exp(z)
        p /= p.sum(axis=1, keepdims=True)
        d = (p - y) / len(samples)
        g = ridge * w
        if len(col):
            g[used] += np.add.reduceat(d[row[by_col]], starts, axis=0)
        g[k:] += dense.T @ d
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Classifier(words, w)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    features = Features()
    for batch in batches:
        made = [features(t.as_py()) for t in batch.column(1)]
        lists = [pa.array([f.tolist() for f, _, _ in made], pa.list_(pa.int64())), pa.array([d.tolist() for _, d, _ in made], pa.list_(pa.float32()))]
        yield pa.RecordBatch.from_arrays([batch.column(0), *lists], ["doc_id", "words", "ratios"])


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> Classifier:
    """Fits on at most ``sample`` labelled documents of ``docs``, those with the least hashes of their ids."""
    known = labels.select(F.col("doc_id").cast("long").alias("id"), domain_of(labels).alias("domain")).where("id is not null and domain is not null")
    known = known.groupBy("id").agg(F.max("domain").alias("domain"))
    known = known.join(docs.select(F.col(id_col).cast("long").alias("id")), "id", "left_semi")  # labels of other documents take no place
    domain = {r["id"]: r["domain"] for r in known.orderBy(F.xxhash64("id"), "id").limit(sample).collect()}
    if not domain:
        return fit([], len(DOMAINS))
    ids = docs.sparkSession.createDataFrame([(i,) for i in domain], "id long")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("id"), "left_semi")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"))
    found = map_arrow(rows, _features, "doc_id long, words array<long>, ratios array<float>").orderBy("doc_id").collect()
    return fit([(np.array(sorted(r["words"]), np.int64), np.array(r["ratios"], np.float32), domain[r["doc_id"]]) for r in found], len(DOMAINS))


def _posteriors(model: Classifier):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            n, p = [], []
            for t in batch.column("text"):
                found, dense, tokens = features(t.as_py())
                n.append(tokens)
                p.append(model.posterior(found, dense))
            cols = np.array(p).T if p else np.empty((len(DOMAINS), 0))
            keep = [batch.column(c) for c in ("doc_id", "draw")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(n, pa.int64()), *[pa.array(c, pa.float64()) for c in cols]], ["doc_id", "draw", "n_tokens", *[f"p_{d}" for d in DOMAINS]])

    return run


def posteriors(docs: DataFrame, model: Classifier, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, draw, n_tokens, p_<domain>...``; ``draw`` hashes id and text and stands for a uniform number."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), draw_of(id_col, text_col).alias("draw"))
    return map_arrow(rows, _posteriors(model), "doc_id long, draw long, n_tokens long, " + ", ".join(f"p_{d} double" for d in DOMAINS))


def draw_of(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")), F.col(id_col).cast("long"))


@dataclass(frozen=True)
class Step:
    """A step of the descent: the momentum before it, and the gradient of each domain there."""

    momentum: float
    gradient: np.ndarray


def bound_of(protected: tuple[str, ...]) -> Column:
    """The least rate of a document: 1 if a protected domain is its likeliest."""
    most = F.greatest(*[F.col(f"p_{d}") for d in DOMAINS])
    held = F.lit(False)
    for d in protected:
        held = held | (F.col(f"p_{d}") == most)
    return F.when(held, 1.0).otherwise(0.0)


def rates_after(steps: list[Step], bound: Column) -> Column:
    """A document's rate after the steps, from its columns ``now`` and ``before``, as a struct of these."""
    start = F.struct(F.col("now").cast("double").alias("now"), F.col("before").cast("double").alias("before"))
    if not steps:
        return start
    number = lambda x: f"double('{float(x)!r}')"
    moves = F.expr("array(" + ", ".join(f"named_struct('momentum', {number(s.momentum)}, " + ", ".join(f"'{d}', {number(x)}" for d, x in zip(DOMAINS, s.gradient, strict=True)) + ")" for s in steps) + ")")
    down = lambda g: sum((F.col(f"p_{d}") * g[d] for d in DOMAINS[1:]), F.col(f"p_{DOMAINS[0]}") * g[DOMAINS[0]])
    go = lambda s, g: F.greatest(bound, s["now"] + g["momentum"] * (s["now"] - s["before"]) - down(g))
    return F.aggregate(moves, start, lambda s, g: F.struct(go(s, g).alias("now"), s["now"].alias("before")))


def shares_of(tokens: np.ndarray, weights: dict[str, float]) -> np.ndarray:
    """Target shares; domains without present tokens cannot be met, and have none."""
    share = np.where(tokens > 0, [weights.get(d, 0.0) for d in DOMAINS], 0.0)
    return share / share.sum() if share.sum() else share


@dataclass(frozen=True)
class Fit:
    """Rated documents, target tokens of each domain, the expected tokens that were reached, and the steps."""

    rated: DataFrame
    targets: np.ndarray
    reached: np.ndarray
    steps: int


def fit_rates(
    known: DataFrame, *, weights: dict[str, float] = WEIGHTS, protected: tuple[str, ...] = PROTECTED, budget: float | None = None, growth: float = 3.0, eta: float = 0.5,
    tolerance: float = 1e-3, max_steps: int = 60, patience: int = 6, every: int = 6,
) -> Fit:
    """Adds ``rate`` to the output of ``posteriors`` (a written table, as it is read once a step)."""
    bound, scratch = bound_of(protected), Scratch(known.sparkSession, "rates")
    at = known.withColumns({"now": F.lit(1.0), "before": F.lit(1.0)})
    steps: list[Step] = []
    # whole millionths, so that the sums do not hang on the order of addition
    whole = lambda r, d: F.sum(F.round(r * F.col("n_tokens") * F.col(f"p_{d}") * 1e6).cast("decimal(38,0)"))

    def totals(one: Column, other: Column, rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        row = rows.agg(*[whole(r, d) for r in (one, other) for d in DOMAINS]).first()
        found = np.array([float(x or 0) / 1e6 for x in row])
        return found[: len(DOMAINS)], found[len(DOMAINS) :]

    tokens, kept = totals(F.lit(1.0), bound, at)
    share, scale = shares_of(tokens, weights), np.where(tokens > 0, tokens, 1.0)
    low = high = budget
    if budget is None:
        high = growth * float(tokens.sum())
        low = min(max([k / s for k, s in zip(kept, share, strict=True) if s > 0], default=0.0) or float(tokens.sum()), high)
    eta_total = eta / max(float(np.sum(share * share / scale)), 1e-300)
    total = before = low
    k, n, error = 0, 0, np.inf
    errors: list[float] = []
    while True:
        momentum, r = k / (k + 3), F.col("_r.now")
        reached, ahead = totals(r, r + momentum * (r - F.col("_r.before")), at.withColumn("_r", rates_after(steps, bound)))
        targets = share * total
        if n >= max_steps or np.max(np.abs(reached - targets) / np.maximum(targets, 1e-3 * scale)) <= tolerance:
            break
        last, error = error, float(np.sum((reached - targets) ** 2 / scale))
        errors.append(error)
        if len(errors) > patience and min(errors[-patience:]) > 0.98 * min(errors[:-patience]):
            break  # no rates within the bounds come closer
        if error > last and k:  # the momentum overshoots: it starts anew
            k, momentum, ahead = 0, 0.0, reached
        total_ahead = total + momentum * (total - before)
        gradient = (ahead - total_ahead * share) / scale
        steps.append(Step(momentum, eta * gradient))
        total, before = min(max(total_ahead + eta_total * float(np.sum(share * gradient)), low), high), total
        k, n = k + 1, n + 1
        if len(steps) == every:
            moved = at.withColumn("_r", rates_after(steps, bound)).withColumns({"now": F.col("_r.now"), "before": F.col("_r.before")}).drop("_r")
            at, steps = scratch.save(moved, f"rates{n}"), []
            scratch.drop(f"rates{n - every}")
    rated = at.withColumn("rate", rates_after(steps, bound)["now"]).drop("now", "before")
    return Fit(rated, share * total, reached, n)


def copies() -> Column:
    """Whole copies of a rated row."""
    part = F.pmod(F.col("draw"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return (F.floor("rate") + F.when(part < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int")


def fitted(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", sample: int = 4000, **options: object) -> Fit:
    """The fit; its ``rated`` is what ``rate`` gives."""
    model = train(docs, labels, sample=sample, id_col=id_col, text_col=text_col)
    known = Scratch(docs.sparkSession, "mixing").save(posteriors(docs, model, id_col=id_col, text_col=text_col), "posteriors")
    made = fit_rates(known, **options)
    return Fit(made.rated.withColumn("copies", copies()), made.targets, made.reached, made.steps)


def rate(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """``doc_id, draw, n_tokens, p_<domain>..., rate, copies``, one row per row of ``docs``."""
    return fitted(docs, labels, **options).rated


def mix(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options: object) -> DataFrame:
    """The rows of ``docs``, each as often as its copies, with all columns."""
    rated = rate(docs, labels, id_col=id_col, text_col=text_col, **options)
    # rows that repeat have equal answers, of which one is enough
    rated = rated.groupBy("doc_id", "draw").agg(F.max("copies").alias("copies")).where("copies > 0")
    rows = docs.select(row_of(docs), F.col(id_col).cast("long").alias("id"), draw_of(id_col, text_col).alias("drawn"))
    met = rows.join(rated, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("drawn") == F.col("draw")))
    return met.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select("row.*")
