import base64
import hashlib

import pytest

from tessera.llm import warc
from tessera.llm.common import Scratch

PAGES = [(5, "http://a/ b", "<p>x</p>"), (2, "http://b", "<p>x</p>"), (9, None, None), (3, "http://c", ""), (7, "http://d", "WARC/1.1\r\n\r\nfoo\r\n\r\n" * 3), (7, "http://d", "WARC/1.1\r\n\r\nfoo\r\n\r\n" * 3), (None, "http://e\r\nX: y", "é" * 70000)]


def brute(pages):
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, _, h in pages:
        b = (h or "").encode()
        f = first.get(h or "")
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if i == f or f is None else "revisit", None if i == f or f is None else f))
    return sorted(out, key=str)


@pytest.mark.parametrize("compress", [False, True])
def test_round_trip(spark, tmp_path, compress):
    pages = spark.createDataFrame([(*p, "q") for p in PAGES], "page_id long, url string, html string, kind string")
    path = f"file://{tmp_path}/w"
    warc.write_warc(pages, path, Scratch(spark, "t"), compress=compress, max_records=3)
    rows = warc.read_warc(spark, path).withColumn("page", warc.page_of("record_id")).withColumn("to", warc.page_of("refers_to")).collect()
    assert {r.kind for r in rows} == {"record"}
    assert sorted([(r.page, r.payload_length, r.payload_digest, r.record_type, r.to) for r in rows], key=str) == brute(PAGES)


def test_small_payloads_are_all_responses(spark, tmp_path):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w", Scratch(spark, "t"), min_revisit_bytes=9)
    rows = warc.read_warc(spark, f"file://{tmp_path}/w").collect()
    assert sorted((r.payload_length, r.record_type) for r in rows if r.payload_length < 9) == [(0, "response")] * 2 + [(8, "response")] * 2


def archive(n, gz):
    out = []
    for i in range(n):
        body = f"payload {i} ".encode() * (i + 1)
        digest = base64.b32encode(hashlib.sha1(body).digest())
        rec = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x-page:%d>\r\nWARC-Payload-Digest: sha1:%s\r\nContent-Length: %d\r\n\r\n" % (i, digest, len(body)) + body + b"\r\n\r\n"
        if gz:
            import gzip

            rec = gzip.compress(rec)
        out.append(rec)
    return out


@pytest.mark.parametrize("gz", [False, True])
def test_salvage_goes_on_after_damage(gz):
    recs = archive(6, gz)
    damaged = [bytearray(r) for r in recs]
    damaged[1][-6] ^= 0xFF  # a flipped byte in the payload, or in the checksum of a member
    damaged[3] = damaged[3][: len(recs[3]) // 2]  # cut short
    data = bytes(b"".join([*damaged, b"junk at the end"]))
    found = list(warc.salvage(data))
    ids = [x.fields["warc-record-id"] for x in found if isinstance(x, warc.Record)]
    assert ids == [f"<urn:x-page:{i}>" for i in (0, 2, 4, 5)]
    gaps = [x for x in found if isinstance(x, warc.Gap)]
    assert [(g.offset, g.length) for g in gaps] == [(len(recs[0]), len(recs[1])), (sum(map(len, damaged[:3])), len(damaged[3])), (len(data) - 15, 15)]
    assert all(g.reason for g in gaps)
    assert sum(x.length for x in found) == len(data)


def test_salvage_of_nothing_and_of_noise():
    assert list(warc.salvage(b"")) == []
    assert [type(x) for x in warc.salvage(b"\x00" * 100)] == [warc.Gap]
    head = b"WARC/1.0\r\nWARC-Type: x\r\nContent-Length: 99\r\n\r\n"
    assert [type(x) for x in warc.salvage(head * 3)] == [warc.Gap]


def test_empty_table(spark, tmp_path):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write_warc(pages, f"file://{tmp_path}/w", Scratch(spark, "t"))
    assert warc.read_warc(spark, f"file://{tmp_path}/w").count() == 0


@pytest.mark.parametrize("place", [0, 1])
def test_salvage_after_a_damaged_start(place):
    import gzip
    import random

    body = random.Random(1).randbytes(9000).hex().encode()
    rec = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x-page:99>\r\nContent-Length: 18000\r\n\r\n" + body + b"\r\n\r\n"
    first = bytearray(gzip.compress(rec))
    assert len(first) > 8192
    first[place] ^= 0xFF
    rest = archive(3, True) + archive(2, False) + archive(2, True)
    data = bytes(first) + b"".join(rest)
    found = list(warc.salvage(data))
    assert [x.fields["warc-record-id"] for x in found if isinstance(x, warc.Record)] == [f"<urn:x-page:{i}>" for i in (0, 1, 2, 0, 1, 0, 1)]
    assert sum(x.length for x in found) == len(data)


def test_salvage_of_plain_records_behind_a_gzip_magic():
    recs = archive(4, False)
    data = b"X" + recs[0][1:20] + warc.GZIP + recs[0][20:] + b"".join(recs[1:])
    found = list(warc.salvage(data))
    assert [x.fields["warc-record-id"] for x in found if isinstance(x, warc.Record)] == [f"<urn:x-page:{i}>" for i in (1, 2, 3)]
    assert (found[0].offset, found[0].length) == (0, len(recs[0]) + 3)


def test_records_that_share_a_member_or_spell_their_digest_in_hexadecimal():
    import gzip

    recs = archive(5, False)
    body = b"payload 1 " * 2
    hexed = recs[1].replace(base64.b32encode(hashlib.sha1(body).digest()), hashlib.sha1(body).hexdigest().encode())
    assert hexed != recs[1]
    wrong = recs[3].replace(b"payload 3", b"payload X", 1)
    data = gzip.compress(recs[0]) + gzip.compress(hexed + recs[2] + wrong + recs[4]) + recs[0].replace(b"WARC/1.0", b"WARC/0.18")
    found = list(warc.salvage(data))
    assert [x.fields["warc-record-id"] if isinstance(x, warc.Record) else x.reason for x in found] == [
        "<urn:x-page:0>", "<urn:x-page:1>", "<urn:x-page:2>", "inside a member: payload digest differs", "<urn:x-page:4>", "<urn:x-page:0>"
    ]
    assert sum(x.length for x in found) == len(data)


def test_files_are_bounded_by_bytes(spark, tmp_path):
    assert warc.size_classes([(1, 500_000), (0, 0), (2, 1 << 40)], 20_000, 1 << 20) == [(0, 20_000), (1, 2), (2, 1)]
    pages = [(i, None, f"{i}" + "x" * n) for i, n in enumerate([10] * 30 + [20_000] * 12 + [600_000] * 3 + [16 << 10, 0])]
    path = f"file://{tmp_path}/w"
    warc.write_warc(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(1), path, Scratch(spark, "t"), max_bytes=100_000)
    rows = warc.read_warc(spark, path).collect()
    assert sorted((warc_id(r.record_id), r.payload.decode()) for r in rows) == [(i, h) for i, _, h in pages]
    held = {}
    for r in rows:
        held.setdefault(r.path, []).append(r.payload_length)
    assert all(sum(n) <= 100_000 or len(n) == 1 for n in held.values())
    assert len(held) >= 3 + 3 + 1


def warc_id(record_id):
    return int(record_id.removeprefix("<urn:x-page:").removesuffix(">"))
