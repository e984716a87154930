import hashlib

import pytest

P = pytest.importorskip("public_tokenizers")
tiktoken = pytest.importorskip("tiktoken")

from tessera.llm import bpe  # noqa: E402

TEXTS = [(1, "Hello world, hello  world\n\n  don't 123"), (2, None), (3, ""), (3, ""), (None, "naïve Ωmega 漢字 🙂 <|endoftext|>"), (5, "a " * 5000), (6, "\x00\t\r\n "), (7, "x" * 3000)]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def truth(vocabulary):
    encoding = vocabulary.tables[1]
    return [(d, encoding.encode_ordinary(t or "")) for d, t in TEXTS]


@pytest.mark.parametrize("block_bytes", [1, 200, 1 << 20])
def test_encode_matches_the_library_and_decodes(spark, vocabulary, truth, block_bytes):
    docs = spark.createDataFrame([(d, t, "clash", "x") for d, t in TEXTS], "doc_id long, text string, ids string, block string")
    made = bpe.encode(docs, vocabulary, block_bytes=block_bytes)
    rows = [(r.doc_id, list(r.ids)) for r in made.collect()]
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(rows, key=key) == sorted(truth, key=key)
    back = {(r.doc_id, bytes(r.text_bytes)) for r in bpe.decode(made, vocabulary).collect()}
    assert back == {(d, (t or "").encode()) for d, t in TEXTS}


def test_round_trip_digests(spark, vocabulary, truth):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string")
    rows = sorted((r.doc_id or 0, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.round_trip(docs, vocabulary).collect())
    want = [(d or 0, len(ids), hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for (d, t), (_, ids) in zip(TEXTS, truth, strict=True)]
    assert rows == sorted(want)


def test_empty_table(spark, vocabulary):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode(docs, vocabulary).collect() == []


def merged(piece, ranks):
    """The ids of a match by the merges' definition: the adjacent pair of least rank is joined, the first of equals, until none has a rank."""
    if piece in ranks:
        return [ranks[piece]]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while True:
        least = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if least is None:
            return [ranks[p] for p in parts]
        parts[least[1] : least[1] + 2] = [parts[least[1]] + parts[least[1] + 1]]


def test_encode_matches_a_merge_loop_of_its_own(spark, vocabulary):
    import base64

    import regex

    ranks = {}
    with open(P.path("byte_bpe_multi_50k.tiktoken"), "rb") as lines:
        for line in lines:
            token, _, rank = line.partition(b" ")
            ranks[base64.b64decode(token)] = int(rank)
    texts = [(d, t) for d, t in TEXTS if d not in (5, 7)] + [(8, "Donaudampfschifffahrtsgesellschaft unbelievableness zzzqqqxxyy ÄÖÜß привет-мир 12345678 \u200d\ufeff"), (9, "ab" * 150)]
    want = [(d or 0, [i for m in regex.findall(P.PATTERN, t or "") for i in merged(m.encode(), ranks)]) for d, t in texts]
    made = [(r.doc_id or 0, list(r.ids)) for r in bpe.encode(spark.createDataFrame(texts, "doc_id long, text string"), vocabulary).collect()]
    assert sorted(made) == sorted(want)


def test_a_block_of_a_million_codes_takes_little_memory(vocabulary):
    """An executor's two workers, each with a block of 32 MB, once took it over its memory. What Python and NumPy allocate is counted here."""
    import random
    import tracemalloc

    import pyarrow as pa

    rnd = random.Random(1)
    letters = str.maketrans("0123456789", "ghijklmnop")
    words = [f" {rnd.randrange(1 << 30):x}".translate(letters) for _ in range(100_000)]
    texts = ["".join(rnd.choices(words, k=1000)) for _ in range(1000)]
    batches = [pa.record_batch({"doc_id": pa.array(range(i, i + 100), pa.int64()), "text": texts[i : i + 100]}) for i in range(0, 1000, 100)]
    tracemalloc.start()
    try:
        made = list(bpe._explode(vocabulary.pattern, 4, 1 << 40)(iter(batches)))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 4 * sum(map(len, texts))  # 3.0 times; it was 5.8
    rows = [r for b in made for r in b.to_pylist()]
    assert [r["kind"] for r in rows] == [bpe.CODES] + [bpe.WORDS] * 4
    batch = lambda rows: pa.RecordBatch.from_pylist(rows, made[0].schema)
    ids = [r for b in bpe._encode_words(vocabulary)(iter([batch(sorted(rows[1:], key=lambda r: r["part"]))])) for r in b.to_pylist()]
    out = [r for b in bpe._assemble(bpe._ids_out)(iter([batch([rows[0], *ids])])) for r in b.to_pylist()]
    encoding = vocabulary.tables[1]
    assert [(r["doc_id"], r["ids"]) for r in out] == [(i, encoding.encode_ordinary(t)) for i, t in enumerate(texts)]


def test_texts_come_in_small_batches_and_the_session_keeps_its_own(spark, vocabulary, tmp_path, monkeypatch):
    from tessera.llm.common import BATCH_BYTES

    def sizes(*_):
        def run(batches):
            for b in batches:
                yield bpe._batch([(0, bpe.CODES, -1, b.num_rows, b"")])

        return run

    monkeypatch.setattr(bpe, "_explode", sizes)
    monkeypatch.setattr(bpe, "map_arrow", lambda df, fn, schema: df.mapInArrow(fn, schema))
    kept = []
    save = bpe.Scratch.save
    monkeypatch.setattr(bpe.Scratch, "save", lambda self, df, name, **o: kept.append(save(self, df, name, **o)) or kept[-1])
    spark.range(0, 3000, 1, 1).selectExpr("id AS doc_id", "repeat('0123456789', 1000) AS text").write.parquet(f"file://{tmp_path}/docs")
    before = spark.conf.get(BATCH_BYTES, None)
    bpe.encode(spark.read.parquet(f"file://{tmp_path}/docs"), vocabulary)
    assert spark.conf.get(BATCH_BYTES, None) == before
    rows = [r.n for r in kept[0].collect()]
    assert sum(rows) == 3000 and max(rows) <= 600  # 30 MB, of which a batch has 4; all were one batch of 3000
