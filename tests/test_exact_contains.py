from tessera.plans import queries


def test_items_of_any_number_of_words(spark, tmp_path):
    docs = ["the old bakery, open on Sundays and holidays!", "Bakery", "open bakery", "", None, "an old bakeryman opens"]
    items = ["bakery", "OLD bakery", "bakery open on", "on sundays and holidays", "the old bakery open on sundays", "", None, "..."]
    spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    made = sorted((r.doc_id, r.item_id) for r in queries.exact_contains_ascii(spark, str(tmp_path)).collect())
    assert made == [(0, 0), (0, 1), (0, 2), (0, 3), (0, 4), (1, 0), (2, 0)]
