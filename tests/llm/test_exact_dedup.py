import hashlib
import random
import uuid

import pytest

from tessera.llm.exact_dedup import DigestIndex, dedup, digest_of, keep_first

ROWS = [(1, "a"), (2, "a"), (5, "b"), (5, "b"), (4, "b"), (7, None), (8, ""), (None, "c"), (None, "a"), (9, "A "), (10, "x" * 100_000)]


def index(spark, buckets=4):
    return DigestIndex(spark, "ix_" + uuid.uuid4().hex, buckets=buckets)


def brute(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    out, done = [], set()
    for d, t in rows:
        own = groups[t or ""]
        keep = max((x for x in own if x is not None), default=None)
        kept = d == keep and (t or "") not in done
        done |= {t or ""} if kept else set()
        out.append((d, keep, len(own), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_brute_force(spark):
    docs = spark.createDataFrame([(*r, "z") for r in ROWS], "doc_id long, text string, keep_id string")
    rows = dedup(docs, index(spark)).collect()
    assert sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.digest.hex()) for r in rows], key=str) == brute(ROWS)


def test_second_batch_meets_the_first(spark):
    ix = index(spark)
    first = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    second = spark.createDataFrame([(3, "a"), (4, "c"), (5, "c")], "doc_id long, text string")
    assert dedup(first, ix).where("kept").count() == 2
    rows = {r.doc_id: r for r in dedup(second, ix).collect()}
    assert (rows[3].keep_id, rows[3].kept, rows[3].group_size) == (1, False, 2)
    assert [rows[4].kept, rows[5].kept] == [False, True]
    again = DigestIndex(spark, "again_" + uuid.uuid4().hex, path=ix.path, buckets=4)  # as a later session opens it
    assert again.table().count() == 4  # "a" has a row for each batch
    assert again.table().select("digest").distinct().count() == 3


def test_index_side_is_not_shuffled(spark):
    ix = index(spark)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    dedup(docs, ix).collect()
    groups = docs.select(digest_of("text").alias("digest"))
    plan = ix.unseen(groups)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "SelectedBucketsCount: 4 out of 4" in plan


def test_keep_first_and_empty(spark):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(ROWS)], "doc_id long, text string, n int")
    kept = keep_first(docs, index(spark))
    assert kept.columns == ["doc_id", "text", "n"]
    assert sorted(((r.doc_id or 0), (r.text or "")[:3]) for r in kept.collect()) == [(0, "c"), (2, "a"), (5, "b"), (8, ""), (9, "A "), (10, "xxx")]
    assert dedup(spark.createDataFrame([], "doc_id long, text string"), index(spark)).count() == 0


def test_batches_against_brute_force_with_a_repeat_and_a_second_session(spark):
    rnd = random.Random(8)
    ix, first, size = index(spark), {}, {}
    batches = [[(100 * b + i, rnd.choice(["a", "b", "c", "d", "e", None, f"own {b} {i}"])) for i in range(20)] for b in range(3)]
    for b, rows in enumerate(batches):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        own = {}
        for i, t in rows:
            own.setdefault(t or "", []).append(i)
        want = sorted((i, first.get(t or "", max(own[t or ""])), size.get(t or "", 0) + len(own[t or ""]), (t or "") not in first and i == max(own[t or ""])) for i, t in rows)
        made = lambda x, d=docs: sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in dedup(d, x).collect())
        assert made(ix) == want
        assert made(ix) == want  # a retry, after the index has the batch
        for t, ids in own.items():
            first.setdefault(t, max(ids))
            size[t] = size.get(t, 0) + len(ids)
        if b == 1:  # another session opens it
            ix = DigestIndex(spark, "again_" + uuid.uuid4().hex, path=ix.path, buckets=4)
    ix.compact()
    assert sorted((r.digest.hex(), r.keep_id, r.n_rows) for r in ix.table().collect()) == sorted((hashlib.sha256(t.encode()).hexdigest(), first[t], size[t]) for t in first)
    late = dedup(spark.createDataFrame([(900, "a"), (901, "new")], "doc_id long, text string"), ix).collect()
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in late) == [(900, first["a"], size["a"] + 1, False), (901, 901, 1, True)]


def test_another_number_of_buckets_is_refused(spark):
    ix = index(spark)
    with pytest.raises(ValueError, match="4 buckets"):
        DigestIndex(spark, "again_" + uuid.uuid4().hex, path=ix.path, buckets=8)
    ix.remove(files=True)
    DigestIndex(spark, "again_" + uuid.uuid4().hex, path=ix.path, buckets=8).remove(files=True)


def test_helper_columns_clash_with_none(spark):
    docs = spark.createDataFrame([(1, "a", "x", "y"), (2, "a", "z", "w")], "doc_id long, text string, _id string, Digest string")
    kept = keep_first(docs, index(spark))
    assert kept.columns == docs.columns
    assert [tuple(r) for r in kept.collect()] == [(2, "a", "z", "w")]
