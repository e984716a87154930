"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Explode: each block of documents (about ``block_bytes`` of text) is split into pre-tokens. A pre-token's position is
   kept as its index in the block's array of word codes; the block's distinct words leave as one packed row for each
   hash part of the words.
2. Distinct words: rows meet by word part, and each task encodes every distinct word of its part once.
3. Join back: the ids of a block's words return to the block, where the code arrays select them by position.
4. Decoding joins ids with the token-byte table, which has one row for each id of the vocabulary (a fixed size), in memory.

Only codes, distinct words and their ids are shuffled, never the exploded tokens. A frequent word costs a row's share in
each block, not one for each use. A block is the unit that a task holds; a document is never split over blocks.

Defined results: a null text counts as empty and has no ids; no special tokens are recognised; rows that repeat are
encoded each for itself; null ids of documents pass through; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Scratch, map_arrow, release_memory, shuffle_partitions

WORDS, CODES, IDS = 0, 1, 2
PACKED = "block long, kind int, part int, n int, body binary"
PACKED_TYPES = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
PACKED_NAMES = ["block", "kind", "part", "n", "body"]


class Vocabulary:
    """Ranks of byte strings, read once on the driver; its size is that of the file, whatever the input's."""

    def __init__(self, path: str, pattern: str) -> None:
        with open(path, "rb") as f:
            self.lines = f.read()
        self.pattern = pattern

    def __reduce__(self):  # noqa: ANN204
        return _vocabulary, (self.lines, self.pattern)

    @property
    def tables(self) -> tuple[dict[bytes, int], object, list[bytes]]:
        return _tables(self.lines, self.pattern)


def _vocabulary(lines: bytes, pattern: str) -> Vocabulary:
    v = Vocabulary.__new__(Vocabulary)
    v.lines, v.pattern = lines, pattern
    return v


@lru_cache(maxsize=2)
def _tables(lines: bytes, pattern: str) -> tuple[dict[bytes, int], object, list[bytes]]:
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines.splitlines() if line)}
    encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return ranks, encoding, [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), PACKED_TYPES, strict=True)], PACKED_NAMES)


def _pack(*parts: bytes | bytearray, level: int = 3) -> bytes:
    """Parts, each after its length, compressed as one stream, so that they are never joined."""
    import zstandard

    stream = zstandard.ZstdCompressor(level=level).compressobj(size=sum(8 + len(p) for p in parts))
    return b"".join([*(stream.compress(x) for p in parts for x in (len(p).to_bytes(8, "little"), p)), stream.flush()])


def _unpack(body: bytes) -> list[memoryview]:
    import zstandard

    raw, at, out = memoryview(zstandard.ZstdDecompressor().decompress(body)), 0, []
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 8], "little")
        out.append(raw[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def _planes(values: np.ndarray) -> tuple[bytes, ...]:
    """Byte planes of 32-bit values: the rarely used ones all but vanish when compressed."""
    raw = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return tuple(np.ascontiguousarray(raw[:, i]).tobytes() for i in range(4))


def _from_planes(planes: list[memoryview]) -> np.ndarray:
    raw = np.empty((len(planes[0]), 4), np.uint8)
    for i, p in enumerate(planes):
        raw[:, i] = np.frombuffer(p, np.uint8)
    return raw.view("<u4").reshape(-1)


def _pieces(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Some codes at a time, so that what is made of them (index arrays of 8 bytes a code, masks) stays small."""
    return (codes[i : i + 500_000] for i in range(0, len(codes), 500_000))


def _code_streams(codes: np.ndarray, rank: np.ndarray) -> tuple[bytearray, ...]:
    """A byte for each code's rank, 255 for those whose remainder follows in planes of their own."""
    first, *rest = (bytearray() for _ in range(5))
    for piece in _pieces(codes):
        ranks = rank[piece]
        first += np.minimum(ranks, 255).astype(np.uint8).tobytes()
        for plane, own in zip(rest, _planes(ranks[ranks >= 255] - 255), strict=True):
            plane += own
    return first, *rest


def _from_code_streams(streams: list[memoryview]) -> np.ndarray:
    codes = np.frombuffer(streams[0], np.uint8).astype(np.uint32)
    codes[codes == 255] += _from_planes(streams[1:])
    return codes


def _part(word: bytes, parts: int) -> int:
    import zlib

    return zlib.crc32(word) % parts


def _explode(pattern: str, parts: int, block_bytes: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        task = (TaskContext.get() and TaskContext.get().partitionId()) or 0
        serial, held = 0, 0
        words: dict[str, int] = {}
        docs: list[tuple[int | None, int]] = []
        codes = array("I")

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal serial, held, words, docs, codes
            if not docs:
                return
            block = (task << 32) | serial  # unique within the table that this run writes
            raw = [w.encode() for w in words]
            words = {}  # its strings go before the rest is made
            # words are numbered by part, and in it by bytes; a code is a place in that order
            part = np.fromiter((_part(w, parts) for w in raw), np.int64, len(raw))
            order = np.fromiter(sorted(range(len(raw)), key=raw.__getitem__), np.int64, len(raw))
            order = order[np.argsort(part[order], kind="stable")]
            place = np.empty(len(raw), np.uint32)
            place[order] = np.arange(len(raw), dtype=np.uint32)
            own = np.frombuffer(codes, np.uint32)
            counts = np.zeros(len(raw), np.int64)
            for piece in _pieces(own):
                counts += np.bincount(piece, minlength=len(raw))
            # frequent words get small codes, which pack well; those used once follow in the order of their places
            once = np.flatnonzero(counts == 1)
            often = np.flatnonzero(counts > 1)
            often = often[np.argsort(-counts[often], kind="stable")]
            rank = np.empty(len(raw), np.uint32)
            rank[np.concatenate([often, once[np.argsort(place[once])]])] = np.arange(len(raw), dtype=np.uint32)
            lengths = np.fromiter((n for _, n in docs), np.uint32, len(docs))
            ids = np.fromiter((0 if d is None else d for d, _ in docs), np.int64, len(docs))
            known = np.fromiter((d is not None for d, _ in docs), np.uint8, len(docs))
            streams = _code_streams(own, rank)
            n, docs, codes, own = len(docs), [], array("I"), None
            yield _batch([(block, CODES, -1, n, _pack(ids.tobytes(), known.tobytes(), lengths.tobytes(), *streams, *_planes(place[often])))])
            out, streams = [], None
            begins = np.flatnonzero(np.diff(part[order], prepend=-1)).tolist()
            for begin, end in zip(begins, [*begins[1:], len(order)], strict=False):
                those = [raw[i] for i in order[begin:end].tolist()]
                sizes = np.fromiter(map(len, those), np.uint32, len(those))
                out.append((block, WORDS, int(part[order[begin]]), len(those), _pack(b"".join(those), *_planes(sizes), level=9)))
            if out:
                yield _batch(out)
            serial, held = serial + 1, 0

        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                text = text.as_py() or ""
                found = find(text)
                codes.extend(words.setdefault(w, len(words)) for w in found)
                docs.append((doc.as_py(), len(found)))
                held += len(text) + 64
                if held >= block_bytes:
                    yield from flush()
                    release_memory()
        yield from flush()

    return run


def _encode_words(vocabulary: Vocabulary):  # noqa: ANN202
    """Word rows of one or more parts to rows of ids; each distinct word of a task is encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, encoding, _ = vocabulary.tables
        made: dict[bytes, bytes] = {}
        at = None
        for batch in batches:
            for block, part, n, body in zip(*(batch.column(c).to_pylist() for c in ("block", "part", "n", "body")), strict=True):
                if part != at:
                    made, at = {}, part
                text, *planes = _unpack(body)
                text = bytes(text)
                ends = np.cumsum(_from_planes(planes)).tolist()
                out, begin = [], 0
                for end in ends:
                    word = text[begin:end]
                    begin = end
                    ids = made.get(word)
                    if ids is None:
                        rank = ranks.get(word)
                        ids = made[word] = np.array([rank] if rank is not None else encoding._encode_single_piece(word), "<u4").tobytes()
                    out.append(ids)
                sizes = np.fromiter(map(len, out), np.uint32, n) // 4
                yield _batch([(block, IDS, part, n, _pack(*_planes(np.frombuffer(b"".join(out), "<u4")), *_planes(sizes)))])

    return run


def gather(values: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """``values[offsets[c] : offsets[c] + sizes[c]]`` for each code, end to end."""
    n = sizes[codes].astype(np.int64)
    total = int(n.sum())
    starts = np.repeat(offsets[codes] - (np.cumsum(n) - n), n)
    return values[starts + np.arange(total, dtype=np.int64)]


def _assemble(finish):  # noqa: ANN001, ANN202
    """A block's rows to documents. ``finish(ids, n)`` gives an Arrow batch's columns for (doc, ids) pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, codes, ids = None, None, {}

        def flush() -> Iterator[pa.RecordBatch]:
            if codes is None:
                return
            docs, known, lengths, *planes = _unpack(codes)
            docs, known, lengths = np.frombuffer(docs, np.int64), np.frombuffer(known, np.uint8), np.frombuffer(lengths, np.uint32)
            rank, often = _from_code_streams(planes[:5]), _from_planes(planes[5:])
            values, sizes = [], []
            for part in sorted(ids):
                parts = _unpack(ids[part])
                values.append(_from_planes(parts[:4]))
                sizes.append(_from_planes(parts[4:]))
            value = np.concatenate(values) if values else np.empty(0, np.uint32)
            size = np.concatenate(sizes) if sizes else np.empty(0, np.uint32)
            place = np.concatenate([often, np.setdiff1d(np.arange(len(size), dtype=np.uint32), often, assume_unique=True)]).astype(np.int64)
            if len(rank) and int(rank.max()) >= len(place):
                raise RuntimeError(f"block {at} has a word {int(rank.max())}, but ids of {len(size)} words")
            offset = np.cumsum(size, dtype=np.int64) - size
            size, offset = size[place], offset[place]
            ends = np.cumsum(lengths, dtype=np.int64)
            first = 0
            while first < len(docs):  # some documents at a time, so that the ids in memory stay few
                start = int(ends[first - 1]) if first else 0
                last = max(first + 1, int(np.searchsorted(ends, start + 500_000)))
                own = rank[start : ends[last - 1]]
                flat = gather(value, offset, size, own)
                per = np.concatenate([[0], np.cumsum(size[own], dtype=np.int64)])
                cuts = per[np.concatenate([[0], ends[first:last] - start])].tolist()
                yield finish([d if k else None for d, k in zip(docs[first:last].tolist(), known[first:last].tolist(), strict=True)], [flat[a:b] for a, b in zip(cuts, cuts[1:], strict=False)])
                first = last

        for batch in batches:
            for block, kind, part, body in zip(*(batch.column(c).to_pylist() for c in ("block", "kind", "part", "body")), strict=True):
                if block != at:
                    yield from flush()
                    at, codes, ids = block, None, {}
                if kind == CODES:
                    codes = body
                else:
                    ids[part] = body
        yield from flush()

    return run


def _ids_out(docs: list, ids: list[np.ndarray]) -> pa.RecordBatch:
    flat = np.concatenate(ids) if ids else np.empty(0, np.uint32)
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat.astype(np.int32), pa.int32()))
    return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), lists], ["doc_id", "ids"])


def _digest_out(vocabulary: Vocabulary):  # noqa: ANN202
    def finish(docs: list, ids: list[np.ndarray]) -> pa.RecordBatch:
        tokens = vocabulary.tables[2]
        n = [len(x) for x in ids]
        coded = [hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]
        plain = [hashlib.sha256(b"".join([tokens[i] for i in x.tolist()])).hexdigest() for x in ids]
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(n, pa.int64()), pa.array(coded), pa.array(plain)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return finish


def _encoded(docs: DataFrame, vocabulary: Vocabulary, scratch: Scratch, id_col: str, text_col: str, block_bytes: int, finish, schema: str) -> DataFrame:  # noqa: ANN001
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # a block stays whole however its rows come, so that small batches cost nothing but hold less
    packed = scratch.save(map_arrow(rows, _explode(vocabulary.pattern, parts, block_bytes), PACKED), "blocks", batch_bytes=4 << 20)
    words = packed.where(F.col("kind") == WORDS).repartition(parts, "part").sortWithinPartitions("part")
    ids = map_arrow(words, _encode_words(vocabulary), PACKED)
    # blocks are of like size and dealt evenly by their number
    met = packed.where(F.col("kind") == CODES).unionByName(ids).repartition(parts, "block").sortWithinPartitions("block")
    return map_arrow(met, _assemble(finish), schema)


def encode(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """``doc_id, ids array<int>``, one row per document."""
    return _encoded(docs, vocabulary, Scratch(docs.sparkSession, "bpe"), id_col, text_col, block_bytes, _ids_out, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text_bytes binary``: ids joined with the token-byte table; null ids count as none, unknown ones are an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = vocabulary.tables[2]
        for batch in batches:
            made = [b"".join([tokens[i] for i in ids or ()]) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["doc_id", "text_bytes"])

    return map_arrow(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), run, "doc_id long, text_bytes binary")


def round_trip(docs: DataFrame, vocabulary: Vocabulary, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 32 << 20) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: encodes, then decodes each document's ids where they are."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _encoded(docs, vocabulary, Scratch(docs.sparkSession, "bpe"), id_col, text_col, block_bytes, _digest_out(vocabulary), schema)
