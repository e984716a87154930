import pytest
from oracle import DATA, same, there

from tessera.plans import features, queries  # noqa: F401

pytestmark = pytest.mark.skipif(not there(), reason="needs the driver's tables")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, name):
    same(spark, queries.QUERIES[name], queries.SQL[name])


def test_keyframes_and_their_summary(spark):
    from collections import Counter

    made = queries.keyframes(spark, DATA).collect()
    n = Counter(r.video_id for r in made)
    assert made and max(n.values()) <= 8
    assert len({(r.video_id, r.frame_index) for r in made}) == len(made)
    assert len({(r.video_id, r.shot_id) for r in made}) == len(made)  # one of each shot
    total = {r.video_id: r for r in queries.selection_summary(spark, DATA).collect()}
    assert {v: r.selected for v, r in total.items() if r.selected} == dict(n)
    decoded = Counter(r[0] for r in spark.read.parquet(f"{DATA}/events.parquet").select("user_id").collect())
    assert {v: r.decoded for v, r in total.items()} == dict(decoded)
    for r in total.values():
        assert r.selected <= r.shots <= r.after_gate <= r.decoded
        assert abs(r.reduction_ratio - (1 - r.selected / r.decoded)) < 1e-9


def test_fuzzy_matches_of_the_tables(spark):
    from tessera.functions.text import best_ratio, normalize

    docs = {r.doc_id: normalize(r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}
    items = {r.item_id: normalize(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id", "text").collect()}
    made = {(r.doc_id, r.item_id): r.similarity for r in queries.fuzzy_match(spark, DATA).collect()}
    assert made
    assert {k for k, v in made.items() if v == 1.0} == {(d, i) for d, t in docs.items() for i, s in items.items() if s and s in t}
    assert all(abs(best_ratio(docs[d], items[i]) - v) < 1e-6 >= 0 and v >= 0.8 for (d, i), v in list(made.items())[:20])


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
