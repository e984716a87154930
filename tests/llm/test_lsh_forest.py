import random

import pytest

from tessera.llm import lsh_forest as lf


def shingles(t):
    w = (t or "").split()
    n = min(5, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()


def brute(rows, threshold=0.8):
    texts = sorted({t or "" for _, t in rows})
    sets = {t: shingles(t) for t in texts}
    near = {t: [u for u in texts if u != t and sets[t] and len(sets[t] & sets[u]) >= threshold * len(sets[t] | sets[u]) - 1e-9] for t in texts}
    out = {}
    for t in texts:
        seen, todo = {t}, [t]
        while todo:
            for u in near[todo.pop()]:
                if u not in seen:
                    seen.add(u)
                    todo.append(u)
        ids = [d for d, x in rows if (x or "") in seen and d is not None]
        out[t] = (min(ids, default=None), len(near[t]), sum((x or "") == t for _, x in rows))
    return sorted([(d, *out[t or ""]) for d, t in rows], key=str)


def corpus(n_base=12, n_near=14, seed=5):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(4))
    rows, i = [], 0
    for _ in range(n_base):
        base = [word() for _ in range(rnd.choice((6, 40, 150, 400)))]
        rows.append((i := i + 1, " ".join(base)))
        for _ in range(rnd.randint(0, n_near)):
            w = list(base)
            for _ in range(rnd.randint(0, max(1, len(w) // 40))):
                w[rnd.randrange(len(w))] = word()
            rows.append((i := i + 1, " ".join(w)))
    rows += [(500, "one two"), (501, "one  two"), (502, "one two three"), (503, ""), (504, None), (505, " "), (None, "one two"), (None, "lonely words here"), (7, rows[3][1]), (7, rows[3][1])]
    return rows


@pytest.mark.parametrize(("block", "broadcast_nodes", "edges"), [(1024, 500_000, 10**6), (4, 0, 0), (3, 500_000, 10**6)])
def test_against_brute_force(spark, block, broadcast_nodes, edges):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, node string")
    made = lf.similar(docs, block=block, broadcast_nodes=broadcast_nodes, single_task_edges=edges).collect()
    assert sorted([(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in made], key=str) == brute(rows)


def test_keep_one_of_each_class(spark):
    rows = corpus()
    docs = spark.createDataFrame([(d, t, "z") for d, t in rows], "doc_id long, text string, n_links string")
    kept = lf.keep_one(docs)
    assert kept.columns == ["doc_id", "text", "n_links"]
    made = [r.doc_id for r in kept.collect()]
    truth = brute(rows)
    named = {c for _, c, _, _ in truth if c is not None}
    assert {d for d in made if d is not None} == named
    assert len(made) == len(named) + 1  # the class whose ids are all null


def test_empty_table(spark):
    assert lf.similar(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_floor_is_where_the_target_is_met():
    assert lf.floor_depth(20, 6, 0.8, 0.999) == 5
    assert lf.floor_depth(20, 6, 0.8, 0.99) == 6
    assert lf.floor_depth(2, 6, 0.8, 0.999) == 1
    assert lf.recall(0.8, 20, 5) > 0.9995


def test_sorted_labels_tell_the_longest_shared_prefixes():
    import numpy as np
    import pyarrow as pa

    rnd = random.Random(3)
    rows = sorted((t, bytes(b for _ in range(4) for b in (rnd.randrange(2), 0)), bytes([i])) for t in range(2) for i in range(60))
    want = {}
    for t, label, node in rows:
        common = [next((k for k in range(4) if label[2 * k] != x[2 * k]), 4) for u, x, other in rows if u == t and other != node]
        want[t, node] = max(common)
    table = pa.table({"tree": pa.array([r[0] for r in rows], pa.int32()), "label": [r[1] for r in rows], "node": [r[2] for r in rows]})
    made = pa.Table.from_batches(list(lf._neighbours(4, 0)(iter(table.to_batches(max_chunksize=7))))).to_pylist()
    assert [(r["tree"], r["label"], r["node"]) for r in made] == rows
    inner = made[1:-1]  # the ends count as shared, as they may have neighbours in other tasks
    assert [r["longest"] for r in inner] == [want[r["tree"], r["node"]] for r in inner]
    assert made[0]["longest"] == made[-1]["longest"] == 4
    assert np.array_equal(lf.shared_levels(np.array([[1, 2], [1, 2], [1, 3], [1, 3]], np.uint16), np.array([0, 0, 0, 1])), [2, 1, 0])


def pairs_of(n, seed=11):
    """Pairs of documents that share a little over eight tenths of their shingles, and close ones."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(5))
    rows = []
    for i in range(n):
        base = [word() for _ in range(120)]
        other = list(base)
        for k in range(2 if i % 2 else 1):
            other[20 + 50 * k] = word()
        rows += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    return rows


def test_shortening_finds_what_whole_labels_miss(spark):
    docs = spark.createDataFrame(pairs_of(60), "doc_id long, text string")
    whole = lf.join(docs, trees=6, levels=8, least=8)
    linked = lambda j: sum(r.n_links for r in j.rows.select("n_links").collect())
    found = lf.join(docs, trees=6, levels=8)
    assert linked(found) == 120 > linked(whole)  # without shortening links are lost
    assert found.recall() >= 0.999 > whole.recall()
    depths = found.depths()
    assert len(depths) > 1 and min(depths) < 8  # nodes stop at depths of their own
    assert min(depths) >= lf.floor_depth(6, 8, 0.8, 0.999)


def test_large_component_only_compares_slices_that_met(spark):
    """A chain of documents, each near the next only, is one component; most of its slices never meet."""
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    words, rows = [word() for _ in range(200)], []
    for i in range(120):
        rows.append((i, " ".join(words)))
        words = [*words[4:], *(word() for _ in range(4))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = lf.join(docs, block=8)
    assert sorted([(r.doc_id, r.class_id, r.n_links, r.n_copies) for r in made.rows.collect()], key=str) == brute(rows)
