"""WARC archives under Zstandard: a dictionary in the leading skippable frame, then one frame per record.

``plan_records`` decides which pages become responses and which revisits; ``write_archives`` lets each task write archives of its own to a
folder that all executors share and returns a manifest; ``read_archives`` decodes the archives that a manifest (or any table
of paths) names and validates every record. A task that is retried writes new files, and only those of the attempt
that Spark accepted are in the manifest, so lost executors leave no doubled records.

The dictionary of an archive is trained on its first records, ``SAMPLE_BYTES`` at most; compression is all that
depends on it. Archives with too few records to train on have no dictionary.

Defined results: a null payload is empty; a null url leaves the target out; control characters in urls are percent-encoded;
repeated page ids give a record each; pages with a null id are responses with id ``null``; an empty table gives
no archives and no rows. A record that fails validation is returned with ``error`` set, and decoding goes on with the next
frame; a truncated or undecodable rest of a file gives one last row with ``error``.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shotledger.sources.shared import broadcast_if_small, materialise

#: Fixed values of the formats: skippable frame of a dictionary, frame of data, dictionary, revisit profile.
DICTIONARY_FRAME, ZSTD_MAGIC = b"\x5d\x2a\x4d\x18", b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
TYPES = ("warcinfo", "response", "resource", "request", "metadata", "revisit", "conversion", "continuation")
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")

SAMPLE_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES, CHUNK = 1 << 20, 32 << 10, 64 << 20, 64 << 10
RECORDS = (
    "path string, at long, record_id string, record_type string, target string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary, error string"
)


def plan_records(pages: DataFrame, min_revisit_bytes: int = 1000, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: the last is the largest id of an equal payload, where that is another page.

    The table joined has one row per repeated payload and no payload, so as a rule it is broadcast and payloads aren't shuffled; beyond the bound on its
    bytes, a payload that a third of all pages share is one key on the large side only, which adaptive execution splits.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"),
        F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumns({"digest": F.sha1("payload"), "n": F.octet_length("payload")})
    long_ones = rows.where(F.col("n") >= min_revisit_bytes)
    first = long_ones.groupBy("digest", "n").agg(F.max("page_id").alias("kept_id"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    found = rows.join(broadcast_if_small(materialise(first, "repeated")), ["digest", "n"], "left")
    return found.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") != F.col("kept_id"), F.col("kept_id")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """The bytes of one response or revisit record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    name = lambda x: f"<urn:x-page:{'null' if x is None else x}>"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    lines += [
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode(),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    if len(samples) < 8:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


def _archives(records: Iterator[bytes], level: int) -> Iterator[Iterator[bytes]]:
    """Per archive its pieces in order: the dictionary, if any, then a frame per record. Each must be used up before the next."""
    held = next(records, None)
    while held is not None:
        first, size = [], 0
        while held is not None and size < SAMPLE_BYTES:
            first.append(held)
            size += len(held)
            held = next(records, None)
        dictionary = trained([x[:16384] for x in first])

        def pieces() -> Iterator[bytes]:
            nonlocal held
            if dictionary is not None:
                raw = dictionary.as_bytes()
                yield DICTIONARY_FRAME + struct.pack("<I", len(raw)) + raw
            press = zstandard.ZstdCompressor(level=level, dict_data=dictionary, write_checksum=True)
            written = 0
            for x in first:
                yield (out := press.compress(x))
                written += len(out)
            first.clear()
            while held is not None and written < ARCHIVE_BYTES:
                yield (out := press.compress(held))
                written += len(out)
                held = next(records, None)

        yield pieces()


def write_archives(planned: DataFrame, folder: str, level: int = 3) -> DataFrame:
    """Write the planned records below ``folder`` and return the manifest: ``path, n_records, n_bytes`` of every archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        records = (record(*row) for b in batches for row in zip(*(c.to_pylist() for c in b.columns)))
        for pieces in _archives(records, level):
            name = f"{uuid.uuid4().hex}.warc.zst"
            count = size = 0
            with store.open_output_stream(f"{base}/{name}", compression=None) as out:
                for piece in pieces:
                    out.write(piece)
                    count += piece[:4] != DICTIONARY_FRAME
                    size += len(piece)
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "n_records": count, "n_bytes": size}])

    cols = planned.select("page_id", "url", "payload", "digest", "refers_to")
    return materialise(cols.mapInArrow(run, "path string, n_records long, n_bytes long"), "manifest")


def parse(raw: bytes) -> dict:
    """One record's fields; ``error`` says what is wrong with it."""
    found: dict = {"error": None}

    def wrong(what: str) -> dict:
        return found | {"error": what}

    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        return wrong("no version line or no end of header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            return wrong(f"not a header line: {line[:80]}")
        fields[name.strip().lower()] = value.strip()
    found |= {"record_type": fields.get("warc-type"), "target": fields.get("warc-target-uri")}
    found |= {"record_id": fields.get("warc-record-id", "").strip("<>") or None, "refers_to": fields.get("warc-refers-to", "").strip("<>") or None}
    if missing := [x for x in NEEDED if not fields.get(x)]:
        return wrong(f"header without {', '.join(missing)}")
    if fields["warc-type"] not in TYPES:
        return wrong(f"unknown type {fields['warc-type'][:40]}")
    if not re.fullmatch(r"\d+", fields["content-length"]):
        return wrong("length isn't a number")
    n = int(fields["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        return wrong(f"length {n} doesn't match the record's {max(0, len(rest) - 4)} bytes")
    block = rest[:n]
    payload, size = block, n
    if fields.get("content-type", "").startswith("application/http"):
        http, gap, payload = block.partition(b"\r\n\r\n")
        stated = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
        if not gap:
            return wrong("no end of the HTTP header")
        size = int(stated[1]) if stated else len(payload)
        if fields["warc-type"] != "revisit" and size != len(payload):
            return wrong(f"HTTP length {size} doesn't match the payload's {len(payload)} bytes")
    digest = None
    if "warc-payload-digest" in fields:
        kind, _, value = fields["warc-payload-digest"].partition(":")
        try:
            digest = (bytes.fromhex(value) if len(value) == 40 else base64.b32decode(value)).hex()
        except ValueError:
            return wrong("digest can't be read")
        if kind.lower() == "sha1" and fields["warc-type"] != "revisit" and digest != hashlib.sha1(payload).hexdigest():
            return wrong("digest doesn't match the payload")
    return found | {"payload_digest": digest, "payload_bytes": size, "payload": payload}


def decode(stream) -> Iterator[tuple[int, bytes | None, str | None]]:
    """(offset, record, error) per frame of an archive read in chunks; memory holds one record."""
    at, buf, dictionary = 0, stream.read(CHUNK), None

    def more(n: int) -> bool:
        nonlocal buf
        while len(buf) < n:
            if not (x := stream.read(max(CHUNK, n - len(buf)))):
                return False
            buf += x
        return True

    press = None
    while more(1):
        if not more(4):
            yield at, None, "the file ends inside a frame's magic"
            return
        magic = buf[:4]
        if magic[1:] == DICTIONARY_FRAME[1:] and 0x50 <= magic[0] <= 0x5F:
            if not more(8) or not more(8 + (n := struct.unpack("<I", buf[4:8])[0])):
                yield at, None, "the file ends inside a skippable frame"
                return
            if at == 0 and magic == DICTIONARY_FRAME:
                raw = buf[8 : 8 + n]
                dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(raw) if raw[:4] == ZSTD_MAGIC else raw)
            at, buf = at + 8 + n, buf[8 + n :]
            continue
        if magic != ZSTD_MAGIC:
            yield at, None, "no frame here"
            return
        press = press or zstandard.ZstdDecompressor(dict_data=dictionary)
        one, out, used = press.decompressobj(), [], 0
        try:
            while True:
                out.append(one.decompress(buf))
                used += len(buf)
                if one.eof:
                    break
                if not (buf := stream.read(CHUNK)):
                    yield at, None, "the file ends inside a frame"
                    return
        except zstandard.ZstdError as e:
            yield at, None, f"frame can't be decoded: {e}"
            return
        buf = one.unused_data
        yield at, b"".join(out), None
        at += used - len(buf)


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives in ``paths.path``, which may lie in any store that pyarrow opens; see ``RECORDS``."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    fields = pa.schema([(n, {"long": pa.int64(), "binary": pa.binary()}.get(t, pa.string())) for n, t in (x.split() for x in RECORDS.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for path in (p for b in batches for p in b.column(0).to_pylist()):
            store, name = fs.FileSystem.from_uri(path)
            rows: list[dict] = []
            size = 0
            with store.open_input_stream(name, compression=None) as stream:
                for at, raw, error in decode(stream):
                    row = {"error": error} if raw is None else parse(raw)
                    if not payloads:
                        row["payload"] = None
                    rows.append({n: row.get(n) for n in names} | {"path": path, "at": at})
                    size += len(row.get("payload") or b"") + 200
                    if size > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, fields)
                        rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, fields)

    spread = paths.select("path").repartition(max(1, paths.sparkSession.sparkContext.defaultParallelism), "path")
    return spread.mapInArrow(run, RECORDS)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of the archives in a folder, found by Spark without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder).select("path")


def page_rows(records: DataFrame) -> DataFrame:
    """Per record of a page: id, payload size and digest, type, and the page it refers to; a record that fails validation stops the query."""
    number = lambda c: F.regexp_extract(c, r"^urn:x-page:(-?\d+)$", 1).try_cast("long")
    checked = F.when(F.col("error").isNotNull(), F.raise_error(F.concat("path", F.lit(" at "), "at", F.lit(": "), "error")).cast("string")).otherwise(F.col("record_type"))
    return records.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", checked.alias("record_type"), number("refers_to").alias("refers_to"))


def oracle_sql(min_revisit_bytes: int = 1000) -> str:
    return f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest, h FROM p),
r AS (SELECT *, CASE WHEN payload_bytes >= {min_revisit_bytes} THEN max(page_id) OVER (PARTITION BY h) END AS top FROM q)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM r"""
