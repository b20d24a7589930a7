"""Archives: round trip through Spark, and salvage of damaged files."""

import gzip
import os
import random

import brute
import pytest

from topicweave.llm import warc


def record(n, body=b"payload", kind="response", digest=True):
    head = f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:page:{n}>\r\nContent-Length: {len(body)}\r\n"
    if digest:
        head += f"WARC-Block-Digest: sha1:{warc._digest(body)}\r\n"
    return head.encode() + b"\r\n" + body + b"\r\n\r\n"


def found(data):
    out = [*warc.salvage(data)]
    edges = [(s, e) for _, s, e, _ in out]
    assert not data or (edges[0][0] == 0 and edges[-1][1] == len(data))
    return [x[3]["headers"]["warc-record-id"] for x in out if x[0] == "record"], [(s, e) for k, s, e, _ in out if k == "gap"]


def ids(*ns):
    return [f"<urn:page:{n}>" for n in ns]


@pytest.mark.parametrize("pack", [bytes, gzip.compress], ids=["plain", "members"])
def test_salvage(pack):
    parts = [pack(record(i, b"<p>%d WARC/1.0\r\n x</p>" % i * 9)) for i in range(5)]
    assert found(b"".join(parts)) == (ids(0, 1, 2, 3, 4), [])
    assert found(b"") == ([], [])
    hurt = bytearray(parts[2])
    hurt[len(hurt) // 2] ^= 255
    data = parts[0] + parts[1] + bytes(hurt) + parts[3] + parts[4]
    at = len(parts[0]) + len(parts[1])
    assert found(data) == (ids(0, 1, 3, 4), [(at, at + len(hurt))])
    cut = b"".join(parts)[:-7]
    # of a member that is cut behind its record the record is whole
    whole = (0, 1, 2, 3) if pack is bytes else (0, 1, 2, 3, 4)
    assert found(cut) == (ids(*whole), [(len(cut) - len(parts[4]) + 7, len(cut))])
    junk = b"junk" + parts[0] + b"\0\0" + parts[1] if pack is not bytes else b"junk\n" + parts[0] + b"\0\n" + parts[1]
    got, gaps = found(junk)
    assert got == ids(0, 1) and len(gaps) == 2


def test_wrong_length_and_malformed_headers():
    bad = record(1).replace(b"Content-Length: 7", b"Content-Length: 9")
    worse = record(2).replace(b"WARC-Type:", b"WARC-Type")
    none = record(3).replace(b"Content-Length", b"Content-Size")
    data = record(0) + bad + worse + none + record(4)
    got, gaps = found(data)
    assert got == ids(0, 4) and sum(e - s for s, e in gaps) == len(bad + worse + none)


def test_random_damage_loses_only_what_it_touches():
    rng = random.Random(1)
    parts = [record(i, bytes(rng.randrange(32, 127) for _ in range(200))) for i in range(30)]
    data = bytearray(b"".join(parts))
    for k in rng.sample(range(30), 6):
        begin = sum(map(len, parts[:k]))
        for _ in range(20):
            data[begin + rng.randrange(len(parts[k]) - 4)] = rng.randrange(256)
    got, gaps = found(bytes(data))
    assert len(got) >= 24 and set(got) <= set(ids(*range(30)))


ROWS = [
    (3, "http://a/é?x", "<p>one</p>", "x"), (1, None, "<p>one</p>", "x"), (2, "http://b/\r\nX: y", None, None), (7, "", "", "x"),
    (None, "http://c", "<p>one</p>", "x"), (9, "http://d", "two\r\n\r\nWARC/1.1\r\nthree \U0001f600", "x"), (10, "u", "y" * 3_000_000, "x"),
    (11, "u", "z" * 100_000, "x"), (1, None, "<p>one</p>", "x"), (None, None, "alone", None),
]


def test_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string, record_type string")
    path = str(tmp_path / "w")
    warc.write_archives(pages, path)
    rows = warc.read_archives(spark, path, with_payload=True).collect()
    assert {r.kind for r in rows} == {"record"}
    got = [(r.page_id and int(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and int(r.refers_to)) for r in rows]
    assert sorted(got, key=str) == sorted(brute.warc([r[:3] for r in ROWS]), key=str)
    assert {r.page_id: bytes(r.payload or b"") for r in rows}["9"] == ROWS[5][2].encode()
    assert not any(r.payload for r in rows if r.record_type == "revisit")

    # damage one file: its other records survive, the loss is logged
    file = max((os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")), key=lambda f: open(f, "rb").read().count(b"WARC/1.1\r\nWARC-Type"))
    data = bytearray(open(file, "rb").read())
    data[data.index(b"HTTP/1.1")] ^= 1
    open(file, "wb").write(data)
    os.remove(os.path.join(os.path.dirname(file), f".{os.path.basename(file)}.crc"))
    again = warc.read_archives(spark, path).collect()
    assert sum(r.kind == "record" for r in again) == len(rows) - 1
    gap = [r for r in again if r.kind == "gap"]
    assert len(gap) == 1 and gap[0].reason == "block digest differs" and gap[0].end > gap[0].start


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "w")
    warc.write_archives(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc.read_archives(spark, path).count() == 0


def test_one_bad_record_costs_no_other_of_its_member():
    parts = [record(i, b"<p>%d</p>" % i * 9) for i in range(6)]
    bad = parts[2].replace(b"<p>2", b"<p>x", 1)
    member = gzip.compress(b"".join([*parts[:2], bad, *parts[3:]]))
    got, gaps = found(member + gzip.compress(record(9)))
    assert got == ids(0, 1, 3, 4, 5, 9) and gaps == [(0, len(member))]
    rng = random.Random(2)
    many = [record(i, bytes(rng.randrange(32, 127) for _ in range(3000))) for i in range(40)]
    member = gzip.compress(b"".join(many))
    half = member[: len(member) // 2]
    got, gaps = found(half + gzip.compress(record(99)))
    assert len(got) > 15 and got == [*ids(*range(len(got) - 1)), *ids(99)] and gaps == [(0, len(half))]


def test_plain_archive_with_a_packed_payload():
    inner = record(1, gzip.compress(b"some page"))
    data = b"XARC" + record(0)[4:] + inner + record(2)
    got, gaps = found(data)
    assert got == ids(1, 2) and gaps == [(0, len(record(0)))]
    mixed = gzip.compress(record(0)) + b"junk\n" + record(1) + gzip.compress(record(2)) + record(3)
    assert found(mixed)[0] == ids(0, 1, 2, 3)
