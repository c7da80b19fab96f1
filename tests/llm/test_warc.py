from __future__ import annotations

import hashlib
import io

import pytest
import zstandard

from shotledger.llm import warc
from shotledger.sources.shared import new_folder


def rows():
    long = "<p>" + "x" * 2000
    return [(1, "http://a/1", long), (2, "http://a/2 b\r\n", long), (3, None, "short"), (4, "http://a/4", "short"), (5, "u", None), (6, "u", ""), (None, "u", long), (7, "ü", "é" * 500), (8, "u", "é" * 500), (8, "u", "é" * 500), (9, "u", "z" * 3_000_000)] + [
        (100 + k, f"http://b/{k}", f"<html>{k}</html>" * (k % 40)) for k in range(300)
    ]


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, "d", "n") for r in rows()], "page_id long, url string, html string, digest string, n string")
    manifest = warc.write_archives(warc.plan_records(pages), new_folder(spark, "warc"))
    found = warc.read_archives(manifest)
    assert found.where("error is not null").count() == 0
    got = sorted((tuple(r) for r in warc.page_rows(found).collect()), key=repr)
    want = []
    for i, _, t in rows():
        raw = (t or "").encode()
        same = [j for j, _, u in rows() if j is not None and (u or "").encode() == raw]
        top = max(same) if len(raw) >= 1000 and same else None
        other = top is not None and i is not None and top != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if other else "response", top if other else None))
    assert got == sorted(want, key=repr)
    assert {r.target for r in found.where("record_id = 'urn:x-page:2'").collect()} == {"http://a/2%20b%0D%0A"}
    listed = warc.list_archives(spark, manifest.first().path.rsplit("/", 1)[0])
    assert warc.read_archives(listed).count() == len(rows())


def test_empty_table(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.page_rows(warc.read_archives(warc.write_archives(warc.plan_records(pages), new_folder(spark, "warc")))).count() == 0


def good(text=b"payload"):
    return warc.record(1, "http://x/", text, hashlib.sha1(text).hexdigest(), None)


@pytest.mark.parametrize(
    "change, error",
    [
        (lambda r: r.replace(b"WARC/1.1", b"WARC/9"), "version"),
        (lambda r: r.replace(b"WARC-Date: 1970-01-01T00:00:00Z\r\n", b""), "without warc-date"),
        (lambda r: r[:-1], "doesn't match the record"),
        (lambda r: r + b"x", "doesn't match the record"),
        (lambda r: r.replace(b"payload", b"paXload"), "digest doesn't match"),
        (lambda r: r.replace(b"WARC-Type: response", b"WARC-Type: other"), "unknown type"),
        (lambda r: r.replace(b"WARC-Record-ID: ", b"WARC-Record-ID "), "without warc-record-id"),
    ],
)
def test_validation(change, error):
    assert error in (warc.parse(change(good()))["error"] or "")
    assert warc.parse(good())["error"] is None


def test_frames_and_dictionaries():
    records = [good(b"text %d " % k * 40) for k in range(64)]
    raw = b"".join(b"".join(p) for p in warc._archives(iter(records), 3))
    assert raw[:4] == warc.DICTIONARY_FRAME
    assert [r for _, r, _ in warc.decode(io.BytesIO(raw))] == records
    n = int.from_bytes(raw[4:8], "little")
    packed = zstandard.compress(raw[8 : 8 + n])
    again = warc.DICTIONARY_FRAME + len(packed).to_bytes(4, "little") + packed + raw[8 + n :]
    assert [r for _, r, _ in warc.decode(io.BytesIO(again))] == records
    *_, last = warc.decode(io.BytesIO(raw[:-3]))
    assert last[1] is None and "ends inside" in last[2]
    *_, last = warc.decode(io.BytesIO(raw + b"junk!"))
    assert last[2] == "no frame here"
