from tessera.llm import mixing


def test_labels_of_absent_documents_take_no_place(spark):
    docs = spark.createDataFrame([(i, f"{'good words here' if i % 2 else 'vile foul hate'} {i}") for i in range(12)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(600)], "doc_id long, quality int, toxic int")
    own = labels.where("doc_id < 12")
    made, want = (mixing.train(docs, rows, sample=12) for rows in (labels, own))
    assert (made.weights == want.weights).all() and made.weights.any()
