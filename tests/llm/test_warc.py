"""Archives: round trips, revisits, segments out of order, and archives that are broken or come from elsewhere."""

import gzip
import hashlib
import random
from collections import Counter

import pytest

from tidewater.llm import warc
from tidewater.llm.common import shared_dir, stored

SCHEMA = "page_id long, url string, html string, payload int, place string, origin string"
LONG = "".join(random.Random(3).choice("abcé日𝔘\r\n ") for _ in range(60_000))
SAME = "x" * 999 + "é"
PAGES = [
    (1, "http://a/1", SAME), (2, "http://a/2", SAME), (9, None, SAME), (3, "http://a/3", SAME), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "bad\r\nurl: x", LONG), (10, "u", LONG), (11, "u", LONG + "\r\n\r\n"),
    (None, "u", "y" * 2000), (None, "u", "y" * 2000), (12, "u", "y" * 2000), (13, "u", "z" * 3000), (13, "u", "z" * 3000), (None, "u", "w" * 1500), (None, "u", "w" * 1500), (14, "u", "v" * 999),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 1, "p", "o") for r in PAGES], SCHEMA).repartition(3)


def payload(html):
    return (html or "").encode()


@pytest.mark.parametrize("segment_bytes, file_records", [(warc.SEGMENT_BYTES, warc.FILE_RECORDS), (700, 5), (1, 100_000)])
def test_round_trip(spark, pages, segment_bytes, file_records):
    path = shared_dir(spark)
    rows = pages if segment_bytes > 1 else pages.where("length(html) < 1200")
    warc.write_archives(rows, path, segment_bytes=segment_bytes, file_records=file_records)
    records = stored(warc.read_archives(spark, path))
    assert records.where("problem IS NOT NULL").collect() == []
    got = [(r["fields"], r) for r in records.collect()]
    page = lambda f: int(f["page-id"]) if "page-id" in f else None
    want = [r for r in PAGES if segment_bytes > 1 or len(r[2] or "") < 1200 and r[2] is not None]
    assert Counter((page(f), r["payload_digest"]) for f, r in got) == Counter((p, hashlib.sha1(payload(h)).hexdigest()) for p, _, h in want)
    groups = {}
    for p, _, h in want:
        groups.setdefault(payload(h), []).append(p)
    responses = Counter((page(f), bytes(r["payload"])) for f, r in got if r["warc_type"] == "response")
    least = lambda ids: max(ids, key=lambda i: -1 if i is None else i)
    assert responses == Counter((p, body) for body, ids in groups.items() for p in (ids if len(body) < 1000 else [least(ids)]))
    ids = {r["record_id"]: (page(f), bytes(r["payload"])) for f, r in got if r["warc_type"] == "response"}
    assert len({r["record_id"] for _, r in got}) == len(got)
    for f, r in got:
        if r["warc_type"] == "revisit":
            assert r["payload"] is None and hashlib.sha1(ids[r["refers_to"]][1]).hexdigest() == r["payload_digest"] and f["warc-profile"] == warc.PROFILE
    linked = warc.with_originals(records.drop("payload"))
    for r in linked.collect():
        assert (r["original"] is None) == (r["warc_type"] != "revisit")
        if r["original"] is not None:
            assert r["original"]["payload_digest"] == r["payload_digest"] and r["original"]["payload_bytes"] >= 1000
    urls = {page(f): r["target_uri"] for f, r in got}
    assert urls[4] == "u" and urls.get(9) is None and (segment_bytes == 1 or urls[8] == "bad%0D%0Aurl: x")


def test_no_rows(spark, pages):
    path = shared_dir(spark)
    warc.write_archives(pages.limit(0), path)
    records = stored(warc.read_archives(spark, path).drop("payload"))
    assert records.collect() == [] and warc.with_originals(records).collect() == []


def written(spark, *files):
    path = shared_dir(spark)
    folder = path.removeprefix("file://")
    import pathlib

    pathlib.Path(folder).mkdir(parents=True)
    for i, data in enumerate(files):
        pathlib.Path(folder, f"{i}.warc.gz").write_bytes(data)
    return warc.read_archives(spark, path)


def test_segments_over_files(spark):
    """Segments in any order, over files, gzipped record by record or plain; what is missing, repeated or of another length is told."""
    block = warc.HEAD + warc.chunked_body(LONG.encode())
    fields = {"WARC-Type": "response", "WARC-Record-ID": "<a>", "WARC-Date": "d", "WARC-Target-URI": "u", "Content-Type": "application/http"}
    own = list(warc.segments_of(fields, block, 10_000, "n"))
    ends = [p + b"\r\n\r\n" for p in own]
    members = [gzip.compress(p) for p in ends]
    assert len(own) > 10
    for files in ([b"".join(members[::-1])], [b"".join(members[::2]), b"".join(ends[1::2])], [b"".join(members), b"".join(members[3:5])]):
        (r,) = written(spark, *files).collect()
        assert bytes(r["payload"]) == LONG.encode() and r["problem"] is None and r["record_id"] == "<a>"
    problem = lambda *files: [r["problem"] for r in written(spark, *files).collect()]
    assert problem(b"".join(members[:4] + members[5:])) == ["segment missing"] and problem(b"".join(members[1:])) == ["segment missing"]
    assert problem(b"".join(members[:-1])) == ["total length differs"]
    assert problem(b"".join(members).replace(members[-1], gzip.compress(ends[-1].replace(str(len(block)).encode(), b"17")))) == ["total length differs"]


def test_odd_archives(spark):
    record = lambda fields, block: warc.one_record(fields, block) + b"\r\n\r\n"
    info = record({"WARC-Type": "warcinfo", "Content-Type": "application/warc-fields"}, b"software: x")
    plain = record({"WARC-Type": "response", "WARC-Payload-Digest": "sha1:" + hashlib.sha1(b"body").hexdigest(), "Content-Type": "application/http"}, b"HTTP/1.1 200 OK\r\n\r\nbody")
    chunked = lambda body: record({"WARC-Type": "response", "Content-Type": "application/http"}, b"HTTP/1.1 200 OK\r\nTransfer-Encoding: Chunked\r\n\r\n" + body)
    folded = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: a\r\n b\r\nContent-Length: 2\r\n\r\nxy\r\n\r\n"
    wrong = record({"WARC-Type": "resource", "WARC-Payload-Digest": "sha1:" + "a" * 40}, b"q")
    rows = written(
        spark, info + plain + folded + wrong, chunked(b"3;x=1\r\nabc\r\n0\r\nTrailer: 1\r\n\r\n") + chunked(b"3\r\nab") + chunked(b"zz\r\n"), b"junk", plain[:-12], gzip.compress(plain)[:40], b"", b"WARC/1.1\r\nContent-Length: x\r\n\r\n"
    ).collect()
    got = Counter((r["warc_type"], bytes(r["payload"] or b""), r["problem"]) for r in rows)
    assert got == Counter([
        ("warcinfo", b"software: x", None), ("response", b"body", None), ("resource", b"xy", None), ("resource", b"q", "payload digest differs"), ("response", b"abc", None), ("response", b"ab", "chunk broken off"),
        ("response", b"", "chunk without a size"), (None, b"", "no record where one should start"), ("response", b"", "block broken off"), (None, b"", "archive broken off"), (None, b"", "no content length"),
    ])
    assert [r["target_uri"] for r in rows if r["warc_type"] == "resource" and r["payload"] == b"xy"] == ["a b"]
