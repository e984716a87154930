import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import mixing
from tessera.llm.common import Scratch


def known(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, draw long, n_tokens long, p_clean double, p_low double, p_toxic double")


def posteriors(n, seed=0):
    rng = np.random.default_rng(seed)
    p = rng.dirichlet((3, 1, 0.4), n)
    return [(i, int(rng.integers(-(2**62), 2**62)), int(rng.integers(0, 900)), *map(float, p[i])) for i in range(n)]


def plain(tokens, p, share, bound, total, steps=20_000):
    """Projected gradient without momentum at a fixed total."""
    r, present = np.ones(len(tokens)), tokens @ p
    for _ in range(steps):
        r = np.maximum(bound, r - p @ ((r * tokens @ p - share * total) / present))
    return r


def test_rates_reach_the_targets_as_a_plain_solver_does(spark):
    rows = posteriors(400)
    weights = {"clean": 0.7, "low": 0.22, "toxic": 0.08}
    fit = mixing.fit_rates(Scratch(spark, "t").save(known(spark, rows), "k"), weights=weights)
    tokens = np.array([r[2] for r in rows], float)
    p = np.array([r[3:] for r in rows])
    bound = np.where(p.argmax(axis=1) == 2, 0.0, 1.0)
    share = mixing.shares_of(tokens @ p, weights)
    assert np.allclose(fit.targets / fit.targets.sum(), share, rtol=1e-9)
    assert np.allclose(fit.reached, fit.targets, rtol=1e-3)
    r = plain(tokens, p, share, bound, fit.targets.sum())
    assert np.allclose(r * tokens @ p, fit.targets, rtol=1e-3)
    made = {x.doc_id: x.rate for x in fit.rated.select("doc_id", "rate").collect()}
    own = np.array([made[i] for i in range(len(rows))])
    assert np.allclose(own * tokens @ p, fit.reached, rtol=1e-3)
    assert (own >= bound).all()
    assert fit.targets.sum() >= max((bound * tokens) @ p / share) * (1 - 1e-6)


def test_budget_absent_domains_and_misses(spark):
    assert mixing.shares_of(np.array([100.0, 0.0, 50.0]), {"clean": 0.5, "low": 0.5, "toxic": 0.0}).tolist() == [1.0, 0.0, 0.0]
    assert mixing.shares_of(np.zeros(3), mixing.WEIGHTS).tolist() == [0, 0, 0]
    rows = [(i, 7919 * i, 100, 0.9, 0.05, 0.05) for i in range(10)]
    table = Scratch(spark, "t").save(known(spark, rows), "k")
    fit = mixing.fit_rates(table, weights={"clean": 0.9, "low": 0.05, "toxic": 0.05}, budget=500.0, protected=())
    assert np.allclose(fit.reached, [450, 25, 25], rtol=1e-3)
    fit = mixing.fit_rates(table, weights={"clean": 0.5, "low": 0.5, "toxic": 0.0}, budget=1000.0)
    assert fit.targets.tolist() == [500, 500, 0]
    assert fit.reached.tolist() == [900, 50, 50]  # every document is protected and like the others: the miss is told


@pytest.mark.parametrize("weights", [mixing.WEIGHTS, {"clean": 0.6, "low": 0.35, "toxic": 0.05}])
def test_mix_meets_its_weights(spark, weights):
    docs, labels = corpus(1500)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fit = mixing.fitted(frame, marks, weights=weights)
    p = {r.doc_id: np.array([r.p_clean, r.p_low, r.p_toxic]) * r.n_tokens for r in fit.rated.collect()}
    made = sum(p[r.doc_id] for r in mixing.mix(frame, marks, weights=weights).select("doc_id").collect())
    assert np.abs(made / made.sum() - [weights[d] for d in mixing.DOMAINS]).max() < 0.01
    assert abs(made.sum() / fit.targets.sum() - 1) < 0.03


def test_conflicting_labels_and_texts_train_alike(spark):
    docs = [(i, f"{'good' if i % 2 else 'vile'} word {i}") for i in range(40)] + [(3, "another text")]
    labels = [(i, 1, 1 - i % 2) for i in range(40)] + [(5, 0, 0), (5, 1, 0), (7, 1, 1)]
    models = [mixing.train(spark.createDataFrame(docs[::k], "doc_id long, text string").repartition(n), spark.createDataFrame(labels[::k], "doc_id long, quality int, toxic int").repartition(n)) for k, n in ((1, 1), (-1, 3))]
    assert (models[0].weights == models[1].weights).all() and models[0].weights.any()


def corpus(n=500, seed=2):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdef") for _ in range(4)) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [rnd.choice(words) for _ in range(rnd.randint(20, 80))]
        kind = rnd.choices((0, 1, 2), (6, 2, 2))[0]
        if kind == 1:
            w = [x.upper() + "!!" for x in w]
        if kind == 2:
            for _ in range(3):
                w[rnd.randrange(len(w))] = rnd.choice(("vile", "rotten"))
        docs.append((i, " ".join(w)))
        labels.append((i, int(kind != 1), int(kind == 2)))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    model = mixing.train(frame, spark.createDataFrame(labels[:350], "doc_id long, quality int, toxic int"))
    truth = {i: 2 if t else 0 if q else 1 for i, q, t in labels[350:]}
    rows = mixing.posteriors(frame, model).collect()
    right = [np.argmax([r.p_clean, r.p_low, r.p_toxic]) == truth[r.doc_id] for r in rows if r.doc_id in truth]
    assert np.mean(right) > 0.95


def test_mix_keeps_protected_documents_and_columns(spark):
    docs, labels = corpus()
    rows = [(*d, "z") for d in docs] + [(None, None, None), (1000, "", "y"), (3, docs[3][1], "x")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, copies string").withColumn("_copy", F.lit(1)).withColumn("draw", F.lit("d"))
    mixed = mixing.mix(frame, spark.createDataFrame([*labels, (None, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int"), weights={"clean": 0.7, "low": 0.27, "toxic": 0.03})
    assert mixed.columns == ["doc_id", "text", "copies", "_copy", "draw"]
    made = {}
    for r in mixed.collect():
        made[r.doc_id, r.copies] = made.get((r.doc_id, r.copies), 0) + 1
    kind = {i: 2 if t else 0 if q else 1 for i, q, t in labels}
    assert all((i, "z") in made for i, k in kind.items() if k < 2)
    assert sum(made.get((i, "z"), 0) for i, k in kind.items() if k == 2) < 0.3 * sum(k == 2 for k in kind.values())
    assert made.get((3, "z")) == made.get((3, "x"))
    assert (None, None) in made
    assert (1000, "y") in made


@pytest.mark.parametrize("labels", [[], [(0, None, 1)], [(99, 1, 0)]])
def test_without_usable_labels_and_empty(spark, labels):
    frame = spark.createDataFrame([(0, "a b"), (1, "c")], "doc_id long, text string")
    none = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = mixing.rate(frame, none).collect()
    assert len(rows) == 2
    assert all(abs(r.p_clean - 1 / 3) < 1e-9 for r in rows)
    assert mixing.mix(frame.limit(0), none).collect() == []


def test_copies_are_drawn_without_bias(spark):
    rows = [(i, i * 2654435761, 1, 0.0, 0.0, 1.0) for i in range(4000)]
    frame = known(spark, rows).withColumn("draw", F.xxhash64("draw")).withColumn("rate", F.lit(1.3))
    assert abs(frame.select(F.avg(mixing.copies())).first()[0] - 1.3) < 0.03


def test_very_long_text(spark):
    long = " ".join(f"w{i % 5000}" for i in range(300_000))
    frame = spark.createDataFrame([(1, long), (2, "a b"), (3, "x" * 500_000)], "doc_id long, text string")
    rows = {r.doc_id: r for r in mixing.rate(frame, spark.createDataFrame([(2, 1, 0)], "doc_id long, quality int, toxic int")).collect()}
    assert [rows[i].n_tokens for i in (1, 2, 3)] == [300_000, 2, 1]
