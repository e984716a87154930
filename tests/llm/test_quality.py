import re

import pytest
from pyspark.sql import functions as F

from tessera.llm import quality

GOOD = "the of and to in " * 3 + " ".join(f"word{i}" for i in range(60)) + " the of and to in it"
TEXTS = [(1, GOOD), (2, None), (3, ""), (4, " \t\n\x0b\x0c\r "), (5, "a b c a b c a b c d"), (6, "x " * 200), (7, "#*$%&|<> word\nline\nline\n\n \nline"), (8, GOOD), (8, GOOD), (9, "é ü " * 60), (10, "the " + " ".join(f"w{i} of" for i in range(20_000)))]


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = {}
    for g in grams:
        count[g] = count.get(g, 0) + 1
    inside = {i + k for i, g in enumerate(grams) if count[g] > 1 for k in range(3)}
    n = len(words)
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), n < 50 or 100 * len(inside) > 50 * n


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*t, "z") for t in TEXTS], "doc_id long, text string, n_words string")
    rows = quality.judge(docs).collect()
    made = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in rows)
    assert made == sorted((d, *brute(t)) for d, t in TEXTS)
    assert {r.doc_id for r in rows if r.kept} == {1, 8, 10}


def test_rules_run_in_one_native_stage(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Exchange|Python|Arrow|Pandas", plan)


def test_keep_and_empty(spark):
    docs = spark.createDataFrame([(*t, "z") for t in TEXTS], "doc_id long, text string, kept string")
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 8, 8, 10]
    assert quality.judge(docs.limit(0)).collect() == []


@pytest.mark.parametrize(("rule", "kept"), [(quality.Rule("n_words", low=50), {1, 6, 8, 9, 10}), (quality.Rule("symbol_ratio", high=0.0), {1, 2, 3, 4, 5, 6, 8, 9, 10})])
def test_each_rule(spark, rule, kept):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumn("m", quality.metrics(F.col("text"))).withColumn("held", quality.compile_rules((rule,), F.col("m")))
    assert {r.doc_id for r in docs.where("held").collect()} == kept


def test_columns_of_the_input_with_names_of_ours(spark):
    docs = spark.createDataFrame([(1, "a b", "v", "w", 3, "x")], "doc_id long, text string, _verdict string, `a``.b` string, N_Words int, Kept string")
    made = quality.judge(docs)
    assert [c for c in made.columns if c.lower() == "kept"] == ["kept"]
    row = made.first()
    assert (row["_verdict"], row["a`.b"], row["n_words"], row["kept"]) == ("v", "w", 2, False)
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
