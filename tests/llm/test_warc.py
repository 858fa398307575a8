"""WARC round trip, damage, and readers."""

import gzip
import hashlib
import io

import pytest

from tracelens.llm import warc as A


def test_round_trip(spark):
    long = "é<p>" * 500
    rows = [(1, "http://a/\r\nx", long), (2, None, long), (9, "u", long), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""),
            (7, "u", "a" * 999), (8, "u", "a" * 999), (10, "u", "b" * 1000), (11, "u", "b" * 1000), (None, "u", long), (None, "u", "z" * 2000), (9, "u", long)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string").repartition(3)
    got = sorted(map(tuple, A.round_trip(pages).collect()), key=repr)
    want = []
    for p, _, h in rows:
        data = (h or "").encode()
        top = max((q for q, _, x in rows if x == h and q is not None), default=None)
        to = top if len(data) >= 1000 and p != top else None
        want.append((p, len(data), hashlib.sha1(data).hexdigest(), "response" if to is None else "revisit", to))
    assert got == sorted(want, key=repr)


def test_empty(spark):
    assert A.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_one_member_per_record_and_rotation(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"page {i} " * 300) for i in range(40)], "page_id long, url string, html string").coalesce(1)
    files = A.write(A.mark_revisits(pages), f"file://{tmp_path}/w", target_bytes=1000).collect()
    assert sum(f.n_records for f in files) == 40 and len(files) > 3
    for f in files:
        raw = open(f.path.removeprefix("file://"), "rb").read()
        assert len(raw) == f.n_bytes and len(list(A.members(io.BytesIO(raw)))) == f.n_records
        assert gzip.decompress(raw).count(b"WARC/1.1\r\n") == f.n_records


def test_damage():
    good = A.page_record(1, "u", b"x" * 5000, None, hashlib.sha1(b"x" * 5000).hexdigest(), 5000)
    (member,) = A.members(io.BytesIO(good))
    assert A.verify(*A.parse(member)) == b"x" * 5000
    with pytest.raises(A.Damaged):
        list(A.members(io.BytesIO(good[:-20])))
    with pytest.raises(A.Damaged):
        A.parse(member[:-1])
    with pytest.raises(A.Damaged):
        A.verify(*A.parse(member.replace(b"xxxxx", b"xxyxx", 1)))


def test_lengths():
    """A length that is no number, none, and members that go on beyond it: each is Damaged, and no more is inflated than the length tells."""
    import zlib

    def packed(header, body):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        return z.compress(b"WARC/1.1\r\n" + header + b"\r\n\r\n" + body) + z.flush()

    assert list(A.members(io.BytesIO(packed(b"Content-Length: 3", b"abc\r\n\r\n") * 2))) == [b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"] * 2
    bomb = packed(b"Content-Length: 10", b"\0" * 300_000_000)
    for bad in (packed(b"Content-Length: x1", b"abc\r\n\r\n"), packed(b"Content-Length: -1", b""), packed(b"Content-Length: 1_0", b""), packed(b"A: b", b"abc"), bomb, packed(b"A: " + b"x" * 3_000_000, b"")):
        with pytest.raises(A.Damaged):
            [A.parse(m) for m in A.members(io.BytesIO(bad))]
    assert A.http_length(b"HTTP/1.1 200 OK\r\nContent-Length: many\r\n\r\n") is None
