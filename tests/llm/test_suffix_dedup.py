import hashlib
import random

import numpy as np
import pytest

from tessera.llm import suffix_dedup as sd


def brute(rows, length=50):
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        key = (d is not None, d or 0)
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            first[w] = min(first.get(w, key), key)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (d is not None, d or 0):
                gone[i : i + length] = b"\x01" * length
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rnd.randint(3, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rnd.choice(passages) if rnd.random() < 0.4 else " ".join(word() for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(0, 6))]
        rows.append((i, "".join(parts)))
    rows += [(200 + i, rows[i][1]) for i in range(0, n, 5)] + [(rows[3][0], rows[3][1])]
    rows += [(900, "ab" * 300), (901, "x" + "ab" * 200), (902, "a" * 49), (903, "a" * 50), (904, "a" * 400), (905, None), (None, passages[0] + "tail"), (None, None), (906, "\x00" * 120), (907, "\x00" * 60)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize(("block_bytes", "hot"), [(600, 20_000), (1 << 20, 20_000), (600, 3), (5000, 10)])
def test_against_brute_force(spark, block_bytes, hot):
    rows = corpus(1, 60)
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, part string").repartition(3)
    made = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup(docs, block_bytes=block_bytes, hot=hot).collect()]
    assert sorted(made, key=str) == brute(rows)


def test_long_text_and_kept_bytes(spark):
    rnd = random.Random(3)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(300_000))
    rows = [(1, long), (2, "new " + long[1000:2000] + " end"), (3, "short")]
    made = {r.doc_id: r for r in sd.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert bytes(made[2].kept) == b"new  end" or made[2].n_removed >= 1000
    assert (made[1].n_removed, made[3].n_removed, made[2].n_spans) == (0, 0, 1)


def test_empty_table(spark):
    assert sd.dedup(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_rolling_hash_and_runs():
    rnd = np.random.default_rng(0)
    text = rnd.integers(0, 4, 5000).astype(np.uint8)
    for width in (1, 5, 20, 50):
        h = sd.rolling_hash(text, width)
        seen = {}
        for i in range(len(text) - width + 1):
            assert seen.setdefault(text[i : i + width].tobytes(), h[i]) == h[i]
        assert len(set(seen.values())) == len(seen)
        assert (sd.hash_at(text, np.array([7, 3, 4000]), width, piece=64) == h[[7, 3, 4000]]).all()
    whole = sd.minimizer_runs(text, np.array([100, 100, 3000, 5000]), 50, 20)
    cut = sd.minimizer_runs(text, np.array([100, 100, 3000, 5000]), 50, 20, piece=128)
    spread = lambda r: sorted((int(f) + k, int(h), int(d)) for h, f, n, d in zip(*r, strict=True) for k in range(n))
    assert spread(whole) == spread(cut)
    assert [w for w, _, _ in spread(whole)] == [*range(0, 51), *range(100, 2951), *range(3000, 4951)]


def test_suffix_order_and_longest_previous_factors():
    rnd = np.random.default_rng(1)
    text = rnd.integers(0, 2, 400).astype(np.uint8)
    at = np.arange(0, 350)
    doc = rnd.integers(0, 5, 350)
    order = sd.suffix_order(text, at, doc, 50)
    keys = [(text[i : i + 50].tobytes(), int(doc[i])) for i in at]
    assert [keys[i] for i in order] == sorted(keys)

    def common(a, b):
        return next((k for k in range(50) if a[k] != b[k]), 50)

    want = [max([common(x[0], k[0]) for k in keys if k[1] < x[1]], default=0) for x in keys]
    assert sd.longest_previous_factors(text, at, doc, order, 50).tolist() == want
    assert sd.lpf_reaches(text, at, doc, 12, piece=10).tolist() == [w >= 12 for w in want]


def test_nearest_smaller():
    rnd = np.random.default_rng(2)
    for n in (0, 1, 7, 500):
        for values in (rnd.integers(0, 9, n), np.arange(n), np.arange(n)[::-1], np.zeros(n, int)):
            want = [max((j for j in range(i) if values[j] < values[i]), default=-1) for i in range(n)]
            assert sd.nearest_smaller(values).tolist() == want


def test_groups_compare_bytes_not_hashes(monkeypatch):
    monkeypatch.setattr(sd, "_mix", lambda h: np.zeros_like(h))  # hashes that tell nothing apart by themselves
    text = np.frombuffer(b"a" * 60 + b"b" * 60 + b"a" * 60 + b"a" * 59 + b"c", np.uint8)
    first, size = np.array([0, 60, 120, 180]), np.full(4, 60)
    order, head = sd._groups(text, first, size, np.array([3, 1, 2, 0]), 50)
    groups = []
    for i, h in zip(order, head, strict=True):
        if h:
            groups.append(set())
        groups[-1].add(int(i))
    assert {frozenset(g) for g in groups} == {frozenset({0, 2}), frozenset({1}), frozenset({3})}


def test_nothing_goes_without_the_factors(spark, monkeypatch):
    """Passages at other places of their runs are only found by their previous factors, which tasks compute from this module's functions."""
    rows = [(1, "x" * 7 + "".join(chr(97 + i * 7 % 26) for i in range(200))), (2, "yz" + "".join(chr(97 + i * 7 % 26) for i in range(3, 160)) + "end")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in sd.dedup(docs).collect()} == {1: 0, 2: 157}
    text = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    at = np.concatenate([np.arange(0, 158), np.arange(207, 207 + 113)])
    doc = np.repeat([1, 2], [158, 113])
    assert sd.lpf_reaches(text, at, doc, 50).sum() == 157 - 49
    monkeypatch.setattr(sd, "nearest_smaller", lambda values: np.full(len(values), -1))
    assert sd.lpf_reaches(text, at, doc, 50).sum() == 0


def test_parts_follow_the_bytes(spark):
    rows = corpus(1, 40)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    made = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in sd.dedup(docs, block_bytes=600, part_bytes=500).collect()]
    assert sorted(made, key=str) == brute(rows)


def test_short_lengths_are_refused(spark):
    with pytest.raises(ValueError, match="gram"):
        sd.dedup(spark.createDataFrame([(1, "a")], "doc_id long, text string"), length=7)


def test_suffix_order_sorts_bytes_then_documents():
    rng = np.random.default_rng(8)
    for letters, n in ((2, 3000), (250, 500)):
        text = rng.integers(0, letters, n, np.uint8)
        text[n // 2 : n // 2 + 200] = text[:200]
        text[-150:] = 7
        at = rng.permutation(n - 50 + 1)
        doc = rng.integers(-3, 4, len(at)) * (1 << 40)
        order = sd.suffix_order(text, at, doc, 50)
        keys = [(text[a : a + 50].tobytes(), d) for a, d in zip(at.tolist(), doc.tolist(), strict=True)]
        assert sorted(order.tolist()) == list(range(len(at)))
        assert [keys[i] for i in order] == sorted(keys)
    assert len(sd.suffix_order(text, at[:0], doc[:0], 50)) == 0
