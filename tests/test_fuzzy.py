import random

from tessera.functions.text import best_ratio, normalize
from tessera.operators import fuzzy


def letters(draw, k, alphabet="abcdefghijklmnopqrstuvwxyz"):
    return "".join(draw.choices(alphabet, k=k))


def brute(docs, items):
    found = {(d, i): best_ratio(normalize(t), normalize(s)) for d, t in enumerate(docs) for i, s in enumerate(items)}
    return {k: round(r, 9) for k, r in found.items() if r >= 0.8}


def matched(spark, docs, items):
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string").repartition(2)
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    return {(r.doc_id, r.item_id): round(r.similarity, 9) for r in fuzzy.match(docs, items).collect()}


def test_all_pairs_of_a_ratio_are_found(spark):
    draw = random.Random(7)
    words = [letters(draw, draw.randint(2, 8)) for _ in range(60)]
    hangul = ["".join(chr(draw.randint(0xAC00, 0xD7A3)) for _ in range(draw.randint(1, 3))) for _ in range(60)]
    items = [" ".join(draw.choices(words, k=k)) for k in (30, 18, 12, 7, 4, 3, 1)] + [" ".join(draw.choices(hangul, k=k)) for k in (25, 9, 3, 1)] + ["ab", "7", "", None, "  !"]
    docs = ["", None, "ab", "A-B 7"]
    for item in items[:11]:
        w, pool = item.split(), hangul if item[0] > "z" else words
        around = lambda made, pool=pool: " ".join([*draw.choices(pool, k=9), made, *draw.choices(pool, k=9)])
        docs.append(around(item))
        docs.append(around("".join(w)))  # no spaces
        docs.append("".join(f"{c} " for c in item))  # a space after each character
        for every in (4, 6):
            docs.append(around(" ".join(draw.choice(pool) if k % every == every - 1 else x for k, x in enumerate(w))))
        for gap in (5, 8):  # a character replaced, left out or put in at each gap
            docs.append(around("".join("x" if k % gap == gap - 1 else c for k, c in enumerate(item.replace(" ", "")))))
            docs.append(around("".join("" if k % gap == gap - 1 else c for k, c in enumerate(item.replace(" ", "")))))
            docs.append(around("".join(c + "q" if k % gap == gap - 1 else c for k, c in enumerate(item.replace(" ", "")))))
    want = brute(docs, items)
    assert matched(spark, docs, items) == want
    assert len({i for _, i in want}) >= 12 and sum(0.8 <= r < 1 for r in want.values()) >= 20


def test_packs_and_streams_change_nothing(spark, monkeypatch):
    draw = random.Random(9)
    items = [letters(draw, n, "abcd") for n in (300, 150, 70, 40, 21, 20, 19, 9, 5, 4)]
    docs = [letters(draw, 60, "abcd") + items[i][: -1 - i % 3] + letters(draw, 30 * (i % 4), "abcd") for i in range(10)]
    want = brute(docs, items)
    assert matched(spark, docs, items) == want
    made = {}
    for pack in (items[:3], items[3:]):
        scan = fuzzy._Pack([(i, normalize(s)) for i, s in enumerate(pack)])
        for d in range(0, 10, 7):
            made |= {(d + t, items.index(pack[i])): round(r, 9) for t, i, r in scan.scan([normalize(x) for x in docs[d : d + 7]])}
    assert made == want
    monkeypatch.setattr(fuzzy, "PACK", 3)
    assert matched(spark, docs, items) == want
