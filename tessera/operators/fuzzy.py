"""Fuzzy containment: all pairs of a text and an item whose best window has a matching-blocks ratio of 0.8 or more.

A window and an item of ``n`` normalised characters with that ratio share ``n - d`` of them in order, ``d = n // 5``, so
that at most ``2 d`` edits turn one into the other. Of the ``k`` pieces into which the item is cut, one then ends in the
text with at most ``2 d // k`` edits. All pieces of a pack of items are sought at once by bit-parallel edit distance (Myers,
1999), a piece a machine word; texts are one stream, cut into strips. What is found is tested on the whole item, on the
longest common subsequence of each window, and last by the ratio itself; each test only drops what the ratio would drop.
Items of under ``SHORT`` characters meet windows by counts of characters.
"""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.functions.text import normalize

#: Characters below which an item's edits leave no piece to seek; steps between two looks at the distances; lanes and characters at once.
SHORT, EVERY, LANES, STREAM = 20, 4, 12800, 2_000_000
#: Words of pieces that one pass over the texts seeks.
PACK = 2048
WORD = 64
OUT = "doc_id long, item_id long, similarity double"


def _eq(needle: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(needle):
        out[c] = out.get(c, 0) | 1 << i
    return out


def _common(window: str, eq: dict[str, int], n: int) -> int:
    """Length of the longest common subsequence."""
    full = (1 << n) - 1
    v = full
    for c in window:
        u = v & eq.get(c, 0)
        v = (v + u | v - u) & full
    return n - v.bit_count()


def _near(text: str, eq: dict[str, int], n: int, edits: int) -> bool:
    """Whether the needle occurs in the text with so many edits at most."""
    full, top = (1 << n) - 1, 1 << n - 1
    vp, vn, score = full, 0, n
    for c in text:
        x = eq.get(c, 0) | vn
        d0 = ((vp + (x & vp)) ^ vp | x) & full
        hn, hp = vp & d0, (vn | ~(vp | d0)) & full
        score += bool(hp & top) - bool(hn & top)
        if score <= edits:
            return True
        x = hp << 1 & full
        vn, vp = x & d0, (hn << 1 | ~(x | d0)) & full
    return False


def _best(windows: set[str], needle: str, eq: dict[str, int]) -> float:
    """The best ratio of the windows if it is 0.8 or more, else 0."""
    n = len(needle)
    found = sorted(((m, w) for w in windows if (m := _common(w, eq, n)) >= n - n // 5), reverse=True)
    matcher = difflib.SequenceMatcher(autojunk=False)
    matcher.set_seq2(needle)
    best = 0.0
    for m, w in found:
        if m / n <= best:
            break
        matcher.set_seq1(w)
        best = max(best, matcher.ratio())
    return best if best >= 0.8 else 0.0


class _Pack:
    """Items with the words of their pieces: ``table`` has the word of each piece by character code; code 0 is any other."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        self.items = items
        self.codes = np.zeros(1 << 16, np.uint16)
        chars = sorted({c for _, s in items for c in s})
        for i, c in enumerate(chars):
            self.codes[ord(c)] = i + 1
        self.eq = [_eq(s) for _, s in items]
        owner, ends, most, table, start = [], [], [], [], []
        for i, (_, s) in enumerate(items):
            n = len(s)
            if n < SHORT:
                continue
            k = -(-n // WORD)
            cuts = [n * j // k for j in range(k + 1)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pad = WORD - (b - a)  # low bits that match any character, so that set bits count the distance
                words = np.full(len(chars) + 1, (1 << pad) - 1, np.uint64)
                for j in range(a, b):
                    words[self.codes[ord(s[j])]] |= np.uint64(1 << pad + j - a)
                table.append(words)
                start.append((1 << WORD) - (1 << pad))
                owner.append(i)
                ends.append(b)
                most.append(2 * (n // 5) // k + EVERY - 1)
        self.owner, self.ends = np.array(owner, np.int64), np.array(ends, np.int64)
        self.most, self.start = np.array(most, np.uint8), np.array(start, np.uint64)
        self.table = np.ascontiguousarray(np.array(table, np.uint64).T) if table else None
        self.short = [i for i, (_, s) in enumerate(items) if len(s) < SHORT]

    def seek(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the stream just behind which a piece may end, and the pieces."""
        lanes = len(self.owner)
        rows = max(1, min(LANES // lanes, len(stream) // 1000 + 1))
        lead = 2 * WORD + EVERY
        length = -(-(-(-len(stream) // rows)) // EVERY) * EVERY
        padded = np.zeros(lead + rows * length, np.uint16)
        padded[lead : lead + len(stream)] = stream
        steps = np.ascontiguousarray(np.lib.stride_tricks.as_strided(padded, (lead + length, rows), (padded.itemsize, length * padded.itemsize)))
        x, d, hn, vn = (np.zeros((rows, lanes), np.uint64) for _ in range(4))
        vp = np.tile(self.start, (rows, 1))
        at, piece = [], []
        for j in range(lead + length):
            np.take(self.table, steps[j], axis=0, out=x, mode="clip")
            np.bitwise_or(x, vn, out=x)
            np.bitwise_and(x, vp, out=d)
            np.add(d, vp, out=d)
            np.bitwise_xor(d, vp, out=d)
            np.bitwise_or(d, x, out=d)
            np.bitwise_and(vp, d, out=hn)
            np.bitwise_or(vp, d, out=vp)
            np.invert(vp, out=vp)
            np.bitwise_or(vp, vn, out=vp)
            np.add(vp, vp, out=vp)
            np.bitwise_and(vp, d, out=vn)
            np.bitwise_or(vp, d, out=vp)
            np.invert(vp, out=vp)
            np.add(hn, hn, out=hn)
            np.bitwise_or(vp, hn, out=vp)
            if j % EVERY == EVERY - 1 and j >= lead:
                hit = np.flatnonzero(np.bitwise_count(vp) <= np.bitwise_count(vn) + self.most)
                if len(hit):
                    r, p = np.divmod(hit, lanes)
                    at.append(r * length + (j - lead))
                    piece.append(p)
        none = np.zeros(0, np.int64)
        return np.concatenate([none, *at]), np.concatenate([none, *piece])

    def alike(self, stream: np.ndarray, needle: str) -> np.ndarray:
        """Where windows start that share at least n - d characters with the needle in any order."""
        n = len(needle)
        shared = np.zeros(max(0, len(stream) - n + 1), np.int32)
        for c in set(needle):
            total = np.concatenate([[0], np.cumsum(stream == self.codes[ord(c)], dtype=np.int32)])
            shared += np.minimum(total[n:] - total[:-n], needle.count(c)) if len(shared) else 0
        return np.flatnonzero(shared >= n - n // 5)

    def scan(self, texts: list[str]) -> Iterator[tuple[int, int, float]]:
        """``text, item, similarity`` by their places."""
        gap = "\0" * EVERY  # a look behind a text's end belongs to it
        sizes = np.array([len(t) + EVERY for t in texts], np.int64)
        begins = np.cumsum(sizes) - sizes
        stream = self.codes[np.frombuffer((gap.join(texts) + gap).encode("utf-16-le"), np.uint16)]
        for i in self.short:
            needle, n = self.items[i][1], len(self.items[i][1])
            starts = self.alike(stream, needle)
            doc = np.searchsorted(begins, starts, "right") - 1
            for t in np.unique(doc):
                text = texts[t]
                own = starts[doc == t] - begins[t]
                windows = {text[a : a + n] for a in own.tolist() if a + n <= len(text)}
                best = 1.0 if needle in windows else _best(windows, needle, self.eq[i])
                if best:
                    yield int(t), i, best
        if self.table is None:
            return
        at, piece = self.seek(stream)
        at, piece = at[at < len(stream)], piece[at < len(stream)]
        doc, item = np.searchsorted(begins, at, "right") - 1, self.owner[piece]
        at = at - begins[doc] + 1 - self.ends[piece]
        order = np.lexsort((at, item, doc))
        doc, item, at = doc[order], item[order], at[order]
        edges = np.flatnonzero(np.diff(doc * len(self.items) + item, prepend=-1, append=-1)) if len(doc) else []
        for a, b in zip(edges, edges[1:], strict=False):
            t, i = int(doc[a]), int(item[a])
            text, needle = texts[t], self.items[i][1]
            n, drift = len(needle), len(needle) // 5
            if len(text) < n:
                continue
            if needle in text:
                yield t, i, 1.0
                continue
            windows: set[str] = set()
            low = high = 0
            for s in [*at[a:b].tolist(), None]:
                if s is not None and s - drift - EVERY <= high:
                    high = max(high, min(s + drift + 1, len(text) - n + 1))
                    continue
                if high > low and _near(text[low : high - 1 + n], self.eq[i], n, 2 * drift):
                    windows |= {text[w : w + n] for w in range(low, high)}
                if s is not None:
                    low, high = max(0, s - drift - EVERY), min(s + drift + 1, len(text) - n + 1)
            best = _best(windows, needle, self.eq[i])
            if best:
                yield t, i, best


def _scan(pack: list[tuple[int, str]]):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = _Pack(pack)

        def answer(ids: list, texts: list[str]) -> pa.RecordBatch:
            rows = [(ids[t], pack[i][0], s) for t, i, s in made.scan(texts)]
            cols = list(zip(*rows, strict=True)) or [(), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["doc_id", "item_id", "similarity"])

        ids, texts, held = [], [], 0
        for batch in batches:
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids.append(i)
                texts.append(normalize(t.as_py()))
                held += len(texts[-1]) + EVERY
                if held >= STREAM:
                    yield answer(ids, texts)
                    ids, texts, held = [], [], 0
        if ids:
            yield answer(ids, texts)

    return run


def match(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id, similarity`` of all pairs of 0.8 or more; ``docs`` has ``doc_id, text`` and ``items`` ``item_id, text``.

    The texts are read once for each pack of items.
    """
    packs: list[list[tuple[int, str]]] = [[]]
    held = 0
    for r in items.select("item_id", "text").toLocalIterator():
        needle = normalize(r.text)
        if needle:
            words = -(-len(needle) // WORD)
            if packs[-1] and held + words > PACK:
                packs.append([])
                held = 0
            packs[-1].append((r.item_id, needle))
            held += words
    # scanning outweighs a shuffle by far, and a file of one row group would be one task
    rows = docs.selectExpr("cast(doc_id as long) doc_id", "text").repartition(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    out = None
    for pack in packs:
        found = rows.mapInArrow(_scan(pack), OUT)
        out = found if out is None else out.union(found)
    return out
