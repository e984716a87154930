import hashlib
import random

import pytest

pytest.importorskip("public_tokenizers")
pytest.importorskip("tiktoken")
import corpus_pipeline  # noqa: E402
from tessera.llm import queries  # noqa: E402


def corpus():
    rnd = random.Random(4)
    words = ["the", "of", "and", *("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(500))]
    text = lambda: " ".join(rnd.choice(words[:3]) if rnd.random() < 0.3 else rnd.choice(words) for _ in range(rnd.randint(80, 200)))
    docs = [(i, text()) for i in range(40)]
    near = docs[7][1].split()
    near[-1] = "changed"
    docs += [(100, docs[5][1]), (101, " ".join(near)), (102, None), (103, "too short"), (104, "x " * 100), (105, docs[5][1])]
    return docs


def test_each_stage_takes_effect(spark, tmp_path):
    docs = corpus()
    d = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    at = spark.read.parquet(f"{d}/documents.parquet")
    left = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, d)
        assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
        out.write.parquet(f"{d}/{len(left)}")
        at = spark.read.parquet(f"{d}/{len(left)}")
        left.append(sorted({r.doc_id for r in at.select("doc_id").collect()}))
    base = set(range(40))
    assert set(left[0]) == base | {100, 101, 105}
    assert set(left[1]) == base - {5} | {101, 105}
    assert set(left[2]) == base - {5} | {105}
    assert left[3] == left[2]  # all are clean, so none is dropped
    encoding = queries.vocabulary().tables[1]
    want = {i: (len(e := encoding.encode_ordinary(t)), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in e)).hexdigest(), hashlib.sha256(t.encode()).hexdigest()) for i, t in docs if t}
    rows = corpus_pipeline.run(spark, d).collect()
    assert {r.doc_id for r in rows} == set(left[3])
    assert all((r.n_tokens, r.ids_sha256, r.decoded_sha256) == want[r.doc_id] for r in rows)
