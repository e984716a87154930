import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import url_filter as uf
from tessera.llm.common import Scratch

URLS = [
    ("HTTP://WWW.Example.ORG/es/1?x=/en/1", "www.example.org", "/es/1", "example.org/es/", "block"),
    ("http://a.example.org/en/12#top", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"),
    ("https://x.com/fr/?q", "x.com", "/fr/", "com/fr/", "allow"),
    ("https://x.com/FR/", "x.com", "/FR/", None, None),
    ("https://x.com/de/5", "x.com", "/de/5", "com/de/", "block"),
    ("http://xcom/de/5", "xcom", "/de/5", None, None),
    ("http://a.org?x", "a.org", "", None, None),
    ("http://a.net/u://b.org/", "a.net", "/u://b.org/", None, None),
    ("no scheme", "", "", None, None),
    ("", "", "", None, None),
    (None, "", "", None, None),
    ("ÉÑ://ÉX.Org/a", "Éx.org", "/a", "org/", "allow"),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u[0], "z") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    rows = {r.page_id: r for r in uf.judge(pages).collect()}
    for i, (_, host, path, rule, verdict) in enumerate(URLS):
        assert (rows[i].host, rows[i].path, rows[i].rule) == (host, path, rule)
        assert rows[i].verdict == verdict or verdict is None
    assert {r.verdict for r in rows.values()} <= {"allow", "block"}


def brute(urls, order, least):
    """gain of every string, straight from the definition"""
    grams = Counter()
    for key, a, r in urls:
        s = uf.START * order + key + uf.END
        for i in range(len(key) + 1):
            g = s[i : i + order + 1]
            grams[g] += 0
            for c, n in (("a", a), ("r", r)):
                grams[c, g] += n
    names = [g for g in grams if isinstance(g, str)]
    letters = {g[-1] for g in names}

    def p(c, gram, k):
        if k < 0:
            return 1 / len(letters)
        mine = gram[order - k :]
        n = Counter()
        for g in names:
            if g[order - k : order] == mine[:-1]:
                n[g[-1]] += grams[c, g]
        total, kinds = sum(n.values()), sum(v > 0 for v in n.values())
        below = p(c, gram, k - 1)
        if total < (least if k else 1):
            return below
        return (n[mine[-1]] + kinds * below) / (total + kinds)

    return {g: math.log(p("a", g, order)) - math.log(p("r", g, order)) for g in names}


@pytest.mark.parametrize("broadcast_rows", [0, 10**6])
def test_model_and_scores_against_brute_force(spark, broadcast_rows):
    rnd = random.Random(1)
    urls = [("".join(rnd.choice("ab/.") for _ in range(rnd.randint(0, 12))) + str(i), rnd.randint(0, 2), rnd.randint(0, 2)) for i in range(25)]
    frame = spark.createDataFrame(urls, "key string, accepted long, rejected long")
    model = uf.train(frame, Scratch(spark, "t"), 3, 2)
    want = brute(urls, 3, 2)
    made = {r.gram: r.gain for r in model.collect()}
    assert made.keys() == want.keys()
    assert all(abs(made[g] - want[g]) < 1e-9 for g in want)
    scores = {r.key: r.score for r in uf.score(frame, model, 3, broadcast_rows).collect()}
    for key, _, _ in urls:
        s = uf.START * 3 + key + uf.END
        assert abs(scores[key] - sum(want[s[i : i + 4]] for i in range(len(key) + 1)) / (len(key) + 1)) < 1e-7


def test_held_out_accuracy(spark):
    rnd = random.Random(2)
    pages = []
    for i in range(1500):
        good = rnd.random() < 0.5
        host = "".join(rnd.choice("aeiou" if good else "xzqkw") for _ in range(6))
        known = rnd.random() < 0.6
        pages.append((i, f"http://{host}.{('com/fr/' if good else 'com/de/') if known else 'net/en/'}{rnd.randint(1, 999)}", good))
    rows = uf.judge(spark.createDataFrame([p[:2] for p in pages], "page_id long, url string")).where("rule is null").collect()
    truth = {i: g for i, _, g in pages}
    assert sum((r.verdict == "allow") == truth[r.page_id] for r in rows) > 0.95 * len(rows)


def test_calibration(spark):
    frame = spark.createDataFrame([(0.31, 1, 0), (0.4, 1, 0), (0.2, 0, 1), (-0.5, 0, 1), (0.33, 0, 0)], "score double, accepted long, rejected long")
    assert 0.2 < uf.calibrate(frame) <= 0.31
    assert uf.calibrate(frame.where("rejected = 0")) == 0.0


def test_native_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://a.org/")], "page_id long, url string")
    plan = uf.judge(pages)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert uf.judge(pages.limit(0)).collect() == []
    twice = pages.union(pages).withColumn("x", F.lit(1))
    assert uf.judge(twice).count() == 2
