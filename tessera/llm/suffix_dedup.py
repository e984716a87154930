"""Suffix-array dedup: bytes of later documents that repeat a string of an earlier one are removed.

A suffix's longest previous factor (LPF) is the longest prefix that it shares with a suffix of an earlier document. In
suffix order the best earlier matches are the previous and the next suffix whose document is smaller. All that matters
is whether the LPF reaches ``length`` bytes, so suffixes are ordered by their first ``length`` bytes, and factors are
measured up to it, byte by byte.

1. Blocks of documents are written compressed. Each ``length``-byte window has a minimizer: the ``gram``-byte string in
   it with the least hash. Blocks send their distinct minimizers, packed by hash part; each part says which of them
   two or more documents have. Equal windows have equal minimizers, so all other windows are unique.
2. Blocks send the stretches ("runs") of windows whose minimizer is shared, grouped by the minimizer's part. Of runs
   with equal bytes only those of the smallest document of the block leave it. A minimizer that very many documents
   have is sent by window rather than by run, dealt by the window's own hash, so no part gathers it.
3. Each part sorts its suffixes, finds the previous and next smaller documents, measures the LPF, and returns the
   intervals to remove to their blocks. There are as many parts as the input's bytes need.

Defined results: a null text is empty; matches are of bytes, never cross documents and are judged on the input; a
string that repeats only within its own document, or in rows of the same id, stays; texts shorter than ``length``
stay whole; a null id is smaller than any other; rows that repeat are each answered. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, map_arrow, shuffle_partitions

LENGTH, GRAM = 50, 20
NO_ID = np.iinfo(np.int64).min
BLOCK = "block long, n int, raw long, body binary"
BLOCK_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
PART = "part int, block long, n int, body binary"
PART_TYPES = [pa.int32(), pa.int64(), pa.int32(), pa.binary()]


def _pack(*arrays: np.ndarray | bytes, level: int = 1) -> bytes:
    import zstandard

    raw = [a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=level).compress(b"".join(len(r).to_bytes(8, "little") + r for r in raw))


def _unpack(body: bytes) -> list[memoryview]:
    import zstandard

    raw, at, out = memoryview(zstandard.ZstdDecompressor().decompress(body)), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _batch(rows: list[tuple], schema: str, types: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types, strict=True)], [c.split()[0] for c in schema.split(", ")])


# --- blocks of documents


def _blocks(block_bytes: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = (TaskContext.get() and TaskContext.get().partitionId()) or 0
        serial, held, ids, texts = 0, 0, [], []

        def flush() -> pa.RecordBatch:
            nonlocal serial, held, ids, texts
            sizes = np.fromiter(map(len, texts), np.int64, len(texts))
            out = _batch([((task << 32) | serial, len(ids), int(sizes.sum()), _pack(np.array([NO_ID if i is None else i for i in ids], np.int64), sizes, b"".join(texts), level=3))], BLOCK, BLOCK_TYPES)
            serial, held, ids, texts = serial + 1, 0, [], []
            return out

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                if held and held + len(raw) > block_bytes:
                    yield flush()
                ids.append(doc.as_py())
                texts.append(raw)
                held += len(raw) + 64
        if ids:
            yield flush()

    return run


def _open(body: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, ends and bytes of a block's documents."""
    ids, sizes, text = _unpack(body)
    return np.frombuffer(ids, np.int64), np.cumsum(np.frombuffer(sizes, np.int64)), np.frombuffer(text, np.uint8)


# --- minimizers


def _mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def rolling_hash(text: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """A 64-bit hash of each ``width``-byte string, by doubling."""
    n = len(text) - width + 1
    level, power, span = text.astype(np.uint64) + np.uint64(1), np.uint64(base), 1
    made, made_span = None, 0
    with np.errstate(over="ignore"):
        while True:
            if width & span:
                if made is None:
                    made, made_span = level, span
                else:  # what is made so far is followed by this level's string
                    m = min(len(made), len(level) - made_span)
                    made, made_span = made[:m] * power + level[made_span : made_span + m], made_span + span
            if span * 2 > width:
                break
            level = level[:-span] * power + level[span:]
            power, span = power * power, span * 2
    return _mix(made[:n].copy())


def hash_at(text: np.ndarray, at: np.ndarray, width: int, base: int = 0x9E3779B97F4A7C15, piece: int = 1 << 21) -> np.ndarray:
    """``rolling_hash`` at some places, a piece of the text at a time."""
    out = np.empty(len(at), np.uint64)
    order = np.argsort(at, kind="stable")
    cuts = np.searchsorted(at[order], np.arange(0, len(text) + piece, piece))
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        if a < b:
            own = order[a:b]
            out[own] = rolling_hash(text[i * piece : (i + 1) * piece + width - 1], width, base)[at[own] - i * piece]
    return out


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` values in a row."""
    level, span = values, 1
    while span * 2 <= width:
        level = np.minimum(level[:-span], level[span:])
        span *= 2
    n = len(values) - width + 1
    return np.minimum(level[:n], level[width - span : width - span + n])


def minimizer_runs(text: np.ndarray, ends: np.ndarray, length: int, gram: int, piece: int = 1 << 21) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first window, count of windows and document of each run of windows that share a minimizer's hash.

    Works on a piece of the block at a time; a run that a piece's edge cuts becomes two, which changes no result.
    """
    starts = np.concatenate([[0], ends[:-1]])
    found: list[tuple[np.ndarray, ...]] = []
    for at in range(0, max(len(text) - length + 1, 0), piece):
        part = text[at : at + piece + length - 1]
        least = _least(rolling_hash(part, gram), length - gram + 1)
        first = int(np.searchsorted(ends, at, side="right"))
        where = np.arange(at, at + len(least))
        doc = np.repeat(np.arange(first, len(ends)), np.clip(np.minimum(ends[first:], at + len(least)) - np.maximum(starts[first:], at), 0, None))
        inside = where + length <= ends[doc]
        edge = np.ones(len(least), bool)
        edge[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]) | (inside[1:] != inside[:-1])
        begin = np.flatnonzero(edge)
        count = np.diff(np.append(begin, len(least)))
        good = inside[begin]
        begin, count = begin[good], count[good]
        # text of a short period has runs without end; they are cut, so that a run is under twice the length
        n = -(-count // length)
        rest = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        begin, count = np.repeat(begin, n) + rest * length, np.minimum(np.repeat(count, n) - rest * length, length)
        found.append((least[begin], where[begin], count, doc[begin]))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


# --- step 1: which minimizers two or more documents have

TOP = 6  # bytes of a hash that are sent; equal heads of different hashes only add windows to look at


def _heads(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - 8 * TOP)


def _distinct(h: np.ndarray, doc: np.ndarray, ids: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hash heads of a block in order of part, and how many documents have each (2 counts different ids only)."""
    head, one = _heads(h), ids[doc]
    order = np.lexsort((one, head))
    head, one = head[order], one[order]
    fresh = np.ones(len(head), bool)
    fresh[1:] = (head[1:] != head[:-1]) | (one[1:] != one[:-1])
    head = head[fresh]
    heads, n = np.unique(head, return_counts=True)
    order = np.argsort(heads % np.uint64(parts), kind="stable")
    return heads[order], n[order]


def _send_minimizers(length: int, gram: int, parts: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body in zip(batch.column("block").to_pylist(), batch.column("body"), strict=True):
                ids, ends, text = _open(body.as_py())
                h, _, _, doc = minimizer_runs(text, ends, length, gram)
                heads, n = _distinct(h, doc, ids, parts)
                part = (heads % np.uint64(parts)).astype(np.int64)
                cuts = np.searchsorted(part, np.arange(parts + 1))
                rows = []
                for p in np.unique(part).tolist():
                    a, b = cuts[p], cuts[p + 1]
                    planes = heads[a:b].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :TOP].T
                    rows.append((p, block, int(b - a), _pack(planes, np.minimum(n[a:b], 65_535).astype("<u2"))))
                if rows:
                    yield _batch(rows, PART, PART_TYPES)

    return run


def _share(hot: int):  # noqa: ANN202
    """A part's minimizers to flags for each block: 0 one document has it, 1 more do, 2 at least ``hot`` do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            heads, counts = [], []
            for _, n, body in held:
                planes, docs = _unpack(body)
                raw = np.zeros((n, 8), np.uint8)
                raw[:, :TOP] = np.frombuffer(planes, np.uint8).reshape(TOP, n).T
                heads.append(raw.view("<u8").reshape(-1))
                counts.append(np.frombuffer(docs, "<u2"))
            _, inverse = np.unique(np.concatenate(heads), return_inverse=True)
            total = np.bincount(inverse, weights=np.concatenate(counts))[inverse]
            flags = (total > 1).astype(np.uint8) + (total >= hot)
            cuts = np.cumsum([0] + [n for _, n, _ in held])
            yield _batch([(at, block, n, _pack(flags[a:b])) for (block, n, _), a, b in zip(held, cuts, cuts[1:], strict=False)], PART, PART_TYPES)

        for batch in batches:
            for part, block, n, body in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "n", "body")), strict=True):
                if part != at:
                    yield from flush()
                    at, held = part, []
                held.append((block, n, body))
        yield from flush()

    return run


# --- step 2: runs of windows whose minimizer is shared


def _slices(text: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Bytes of ``text[f : f + n]`` end to end."""
    total = int(size.sum())
    return text[np.repeat(first - (np.cumsum(size) - size), size) + np.arange(total)]


def word_at(views: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as a number, the first byte highest."""
    return views[at].view(">u8").reshape(-1).astype(np.uint64)


def _views(text: np.ndarray) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([text, np.zeros(8, np.uint8)]), 8)


def _edges(size: np.ndarray, length: int) -> Iterator[np.ndarray | int]:
    """Offsets of eight-byte words that cover the first and the last ``length`` bytes of runs, hence all of a run."""
    for k in range(0, length - 8, 8):
        yield k
        yield size - length + k
    yield length - 8
    yield size - 8


def _groups(text: np.ndarray, first: np.ndarray, size: np.ndarray, doc_id: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of equal bytes: their order by content, then document, and where each group begins in it.

    Runs have under twice ``length`` bytes. They are ordered by their size and 128 bits of hashes of their bytes, and
    neighbours are equal where their bytes are.
    """
    views = _views(text)
    keys = [size.astype(np.uint64) * np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)]
    with np.errstate(over="ignore"):
        for off in _edges(size, length):
            word = word_at(views, first + off)
            keys[0] = _mix((keys[0] ^ word) * np.uint64(0xFF51AFD7ED558CCD))
            keys[1] = (keys[1] + word) * np.uint64(0xC4CEB9FE1A85EC53)
            keys[1] ^= keys[1] >> np.uint64(31)
    order = np.lexsort((doc_id, *keys))
    head = np.ones(len(order), bool)
    same = (keys[0][order][1:] == keys[0][order][:-1]) & (size[order][1:] == size[order][:-1])
    at = np.flatnonzero(same)
    if len(at):
        a, b = order[at], order[at + 1]
        equal = np.ones(len(at), bool)
        for off, other in zip(_edges(size[a], length), _edges(size[b], length), strict=True):
            equal &= word_at(views, first[a] + off) == word_at(views, first[b] + other)
        head[at[equal] + 1] = False
    return order, head


def _local(text: np.ndarray, first: np.ndarray, size: np.ndarray, doc_id: np.ndarray, length: int) -> np.ndarray:
    """True where no run of equal bytes has a smaller document in this block."""
    order, head = _groups(text, first, size, doc_id, length)
    out = np.empty(len(order), bool)
    out[order] = doc_id[order] == doc_id[order[head]][np.cumsum(head) - 1]
    return out


def _send_runs(length: int, gram: int, parts: int):  # noqa: ANN202
    """Blocks with their flags to packed runs by part, and (part -1) the intervals that are decided in the block."""

    def work(block: int, body: bytes, flagged: dict[int, bytes]) -> list[tuple]:
        ids, ends, text = _open(body)
        h, first, count, doc = minimizer_runs(text, ends, length, gram)
        heads, _ = _distinct(h, doc, ids, parts)
        flags = np.concatenate([np.frombuffer(_unpack(flagged[p])[0], np.uint8) for p in sorted(flagged)]) if flagged else np.empty(0, np.uint8)
        if len(flags) != len(heads):
            raise RuntimeError(f"block {block} has {len(heads)} minimizers, but flags of {len(flags)}")
        by = np.argsort(heads)
        flag = flags[by][np.searchsorted(heads[by], _heads(h))] if len(heads) else flags
        keep = flag > 0
        h, first, count, doc, flag = h[keep], first[keep], count[keep], doc[keep], flag[keep]
        if not len(h):
            return []
        part = (_heads(h) % np.uint64(parts)).astype(np.int64)
        # very frequent minimizers: each window is a run of its own, dealt by its bytes
        hot = flag == 2
        if hot.any():
            n = count[hot]
            one = np.repeat(first[hot] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            dealt = (hash_at(text, one, length) % np.uint64(parts)).astype(np.int64)
            first = np.concatenate([first[~hot], one])
            doc = np.concatenate([doc[~hot], np.repeat(doc[hot], n)])
            part = np.concatenate([part[~hot], dealt])
            count = np.concatenate([count[~hot], np.ones(len(one), np.int64)])
        size = count + length - 1
        mine = _local(text, first, size, ids[doc], length)
        out = []
        later = ~mine
        if later.any():
            out.append((-1, block, int(later.sum()), _pack(first[later].astype(np.int64), size[later].astype(np.int32))))
        first, size, doc, part = first[mine], size[mine], doc[mine], part[mine]
        order = np.argsort(part, kind="stable")
        first, size, doc, part = first[order], size[order], doc[order], part[order]
        cuts = np.searchsorted(part, np.arange(parts + 1))
        for p in np.unique(part).tolist():
            a, b = cuts[p], cuts[p + 1]
            out.append((p, block, int(b - a), _pack(_slices(text, first[a:b], size[a:b]), size[a:b].astype(np.int32), first[a:b].astype(np.int32), ids[doc[a:b]], level=3)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, body, flags in zip(batch.column("block"), batch.column("body"), batch.column("flags"), strict=True):
                rows = work(block.as_py(), body.as_py(), {f["part"]: f["body"] for f in flags.as_py() or ()})
                for i in range(0, len(rows), 64):
                    yield _batch(rows[i : i + 64], PART, PART_TYPES)

    return run


# --- step 3: suffix order, longest previous factors


def suffix_order(text: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes at ``at`` by their first ``length`` bytes, then by document.

    Eight bytes at a time; what they have put in order is not looked at again, only suffixes that are equal so far.
    """
    views = _views(text)
    order = np.arange(len(at))
    tied, group = np.arange(len(at)), np.zeros(len(at), np.uint64)  # places that share a group, and their group
    for k in (*range(0, length - 8, 8), length - 8, None):
        own = order[tied]
        value = doc[own] if k is None else word_at(views, at[own] + k)
        by = np.argsort(value)
        # ranks of the values within all, so that group and value are one number
        step = np.ones(len(by), np.uint64)
        step[1:] = value[by][1:] != value[by][:-1]
        both = np.empty(len(by), np.uint64)
        both[by] = np.cumsum(step)
        both |= group << np.uint64(32)
        by = np.argsort(both)
        order[tied] = own[by]
        both = both[by]
        same = both[1:] == both[:-1]
        keep = np.zeros(len(both), bool)
        keep[1:] |= same
        keep[:-1] |= same
        head = np.ones(len(both), np.uint64)
        head[1:] = ~same
        tied, group = tied[keep], np.cumsum(head)[keep]
        if not len(tied):
            break
    return order


def nearest_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the last one before it with a smaller value, -1 if there is none.

    Places point to the one before, and follow the pointers of those whose value is not smaller, all at once; whatever lies
    between a place and its pointer is not smaller than it.
    """
    found = np.arange(-1, len(values) - 1)
    todo = np.flatnonzero((found >= 0) & (values[found] >= values))
    while len(todo):
        found[todo] = found[found[todo]]
        todo = todo[(found[todo] >= 0) & (values[found[todo]] >= values[todo])]
    return found


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Bytes that the suffixes at ``a`` and ``b`` have in common, ``length`` at most."""
    views = _views(text)
    out = np.zeros(len(a), np.int64)
    left = np.arange(len(a))
    for k in range(0, length, 8):
        off = min(k, length - 8)  # the last word overlaps the one before it
        x = views[a[left] + off] == views[b[left] + off]
        whole = x.all(axis=1)
        out[left] = off + np.where(whole, 8, x.argmin(axis=1))
        left = left[whole]
        if not len(left):
            break
    return out


def longest_previous_factors(text: np.ndarray, at: np.ndarray, doc: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Of each suffix, the longest prefix (``length`` bytes at most) that it shares with a suffix of a smaller document.

    It is shared with the previous or the next suffix in ``order`` whose document is smaller, as common prefixes only shorten
    with the distance in the order.
    """
    out = np.zeros(len(order), np.int64)
    ranked = doc[order]
    place = at[order]
    for flip in (False, True):
        found = nearest_smaller(ranked[::-1] if flip else ranked)
        found = np.where(found >= 0, len(order) - 1 - found, -1)[::-1] if flip else found
        has = np.flatnonzero(found >= 0)
        has = has[out[order[has]] < length]
        own = order[has]
        out[own] = np.maximum(out[own], common_prefix(text, place[has], place[found[has]], length))
    return out


def lpf_reaches(text: np.ndarray, at: np.ndarray, doc: np.ndarray, length: int, piece: int = 1_000_000) -> np.ndarray:
    """Which suffixes have a longest previous factor of ``length`` bytes, a range of the suffix order at a time.

    Ranges are cut by the first two bytes, which a factor of two bytes or more shares.
    """
    two = text[at].astype(np.int64) << 8 | text[at + 1]
    chunk = np.cumsum(np.bincount(two, minlength=1 << 16)) // piece
    chunk = chunk[two]
    out = np.empty(len(at), bool)
    for c in np.unique(chunk):
        own = np.flatnonzero(chunk == c)
        order = suffix_order(text, at[own], doc[own], length)
        out[own] = longest_previous_factors(text, at[own], doc[own], order, length) >= length
    return out


def _lpf(length: int):  # noqa: ANN202
    def decide(rows: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
        texts, sizes, firsts, docs = [], [], [], []
        for _, n, body in rows:
            text, size, first, doc = _unpack(body)
            texts.append(np.frombuffer(text, np.uint8))
            sizes.append(np.frombuffer(size, np.int32))
            firsts.append(np.frombuffer(first, np.int32))
            docs.append(np.frombuffer(doc, np.int64))
        text, size, first, doc = np.concatenate(texts), np.concatenate(sizes).astype(np.int64), np.concatenate(firsts).astype(np.int64), np.concatenate(docs)
        del texts
        begin = np.cumsum(size) - size
        # equal runs of different blocks: the later ones are covered whole, one of the first is looked into
        order, head = _groups(text, begin, size, doc, length)
        group = np.cumsum(head) - 1
        chief = order[head]
        whole = np.zeros(len(order), bool)
        whole[order] = doc[order] > doc[chief][group]
        n = size[chief] - length + 1
        at = np.repeat(begin[chief] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        owner = np.repeat(doc[chief], n)
        flag = lpf_reaches(text, at, owner, length)
        cuts = np.cumsum(n)
        # flagged windows of the chief run hold for every run of the group that isn't covered whole
        fresh = np.flatnonzero(flag)
        which = np.searchsorted(cuts, fresh, side="right")
        shift = fresh - (cuts[which] - n[which])
        # stretches of flagged windows
        edge = np.ones(len(fresh), bool)
        edge[1:] = (which[1:] != which[:-1]) | (fresh[1:] != fresh[:-1] + 1)
        s = np.flatnonzero(edge)
        stretch_group, stretch_at = which[s], shift[s]
        stretch_n = np.diff(np.append(s, len(fresh))) + length - 1
        of = np.empty(len(order), np.int64)  # each run's group
        of[order] = group
        lo, hi = np.searchsorted(stretch_group, of, side="left"), np.searchsorted(stretch_group, of, side="right")
        take = np.where(whole, 0, hi - lo)
        run = np.repeat(np.arange(len(of)), take)
        pick = np.repeat(lo - (np.cumsum(take) - take), take) + np.arange(int(take.sum()))
        out_run = np.concatenate([np.flatnonzero(whole), run])
        out_at = np.concatenate([first[whole], first[run] + stretch_at[pick]])
        out_n = np.concatenate([size[whole], stretch_n[pick]])
        owner_row = np.repeat(np.arange(len(rows)), [n for _, n, _ in rows])[out_run]
        back = np.argsort(owner_row, kind="stable")
        ends = np.searchsorted(owner_row[back], np.arange(len(rows) + 1))
        made = []
        for i, (block, _, _) in enumerate(rows):
            own = back[ends[i] : ends[i + 1]]
            if len(own):
                made.append((-1, block, len(own), _pack(out_at[own].astype(np.int64), out_n[own].astype(np.int32))))
        if made:
            yield _batch(made, PART, PART_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for part, block, n, body in zip(*(batch.column(c).to_pylist() for c in ("part", "block", "n", "body")), strict=True):
                if part != at and held:
                    yield from decide(held)
                    held = []
                at = part
                held.append((block, n, body))
        if held:
            yield from decide(held)

    return run


# --- the answer of each document


def _finish(with_text: bool):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body, cut in zip(batch.column("body"), batch.column("cuts"), strict=True):
                ids, ends, text = _open(body.as_py())
                firsts, sizes = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
                for c in cut.as_py() or ():
                    first, size = _unpack(c)
                    firsts.append(np.frombuffer(first, np.int64))
                    sizes.append(np.frombuffer(size, np.int32).astype(np.int64))
                first, size = np.concatenate(firsts), np.concatenate(sizes)
                depth = np.zeros(len(text) + 1, np.int32)
                np.add.at(depth, first, 1)
                np.add.at(depth, first + size, -1)
                gone = np.cumsum(depth[:-1]) > 0
                starts = np.concatenate([[0], ends[:-1]])
                rows = []
                raw = text.tobytes()
                for i, a, b in zip(ids.tolist(), starts.tolist(), ends.tolist(), strict=True):
                    own = gone[a:b]
                    n = int(own.sum())
                    spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0
                    kept = text[a:b][~own].tobytes() if n else raw[a:b]
                    rows.append((None if i == NO_ID else i, b - a, n, spans, hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield _batch(rows, OUT, types)

    return run


OUT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM, block_bytes: int | None = None, hot: int = 20_000, part_bytes: int = 32 << 20, with_text: bool = True) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept`` (the remaining bytes, null unless ``with_text``).

    Without ``block_bytes``, blocks grow with the number of parts, so that what a block sends to a part stays worth a row.
    """
    if not 8 <= gram <= length:
        raise ValueError("a gram has 8 bytes at least and the length at most")
    spark = docs.sparkSession
    scratch = Scratch(spark, "suffix")
    least = shuffle_partitions(spark)
    block_bytes = block_bytes or min(max(4 << 20, 2048 * least), 256 << 20)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    blocks = scratch.save(map_arrow(rows, _blocks(block_bytes), BLOCK), "blocks")
    parts = max(least, -(-(blocks.agg(F.sum("raw")).first()[0] or 0) // part_bytes))  # a part holds no more than its share of the input
    sent = map_arrow(blocks, _send_minimizers(length, gram, parts), PART).repartition(parts, "part").sortWithinPartitions("part")
    flags = scratch.save(map_arrow(sent, _share(hot), PART), "flags")
    per_block = flags.groupBy("block").agg(F.collect_list(F.struct("part", "body")).alias("flags"))
    runs = scratch.save(map_arrow(blocks.join(per_block, "block"), _send_runs(length, gram, parts), PART), "runs")
    scratch.drop("flags")
    met = runs.where("part >= 0").repartition(parts, "part").sortWithinPartitions("part")
    cuts = scratch.save(map_arrow(met, _lpf(length), PART).union(runs.where("part < 0")), "cuts")
    scratch.drop("runs")
    per_block = cuts.groupBy("block").agg(F.collect_list("body").alias("cuts"))
    return map_arrow(blocks.join(per_block, "block", "left"), _finish(with_text), OUT)
