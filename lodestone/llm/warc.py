"""WARC archives: a deduplicating writer and a splittable reader.

Every record is a gzip member of its own. The reader gives each task a byte range
of a file. It looks for the gzip magic from the range's start, takes a place as a
member only if what it inflates to begins with a WARC version line and parses as a
header block, and then goes on from member end to member start. A task owns the
records that start inside its range and reads past its end to finish the last one.

Of records with equal payloads of at least ``min_bytes`` bytes, the one with the
smallest id is written as response; others are revisits without payload that name
it and keep its payload digest and, in their HTTP header, its length.

Files are written and read through pyarrow's file systems under the shared folder.
A failed or repeated task leaves a file that no manifest row names.

Defined cases: null pages have an empty payload; a null address leaves out the
target header; a page without an id is written under no number and comes back without
one, as a revisit if a page with an id has its payload, else as a response; repeated rows are written again and the first is the response for
all; text is written as UTF-8 at any length; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import cut, join_groups, shared_path

MAGIC = b"\x1f\x8b\x08"
#: Reading tasks at most; beyond it a task reads several ranges.
MOST_TASKS = 100_000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a qualified path (``shared_path``), and the path there."""
    return (pafs.LocalFileSystem(), path[5:].replace("//", "", 1)) if path.startswith("file:") else pafs.FileSystem.from_uri(path)


def member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n") + packer.flush()


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, first: int | None) -> bytes:
    name = "<urn:page:{}>".format
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Type", "response" if first == page_id else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", DATE)]
    if url is not None:
        headers.append(("WARC-Target-URI", quote(url, safe="%/:?#[]@!$&'()*+,;=~")))
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if first != page_id:
        headers += [("WARC-Refers-To", name(first)), ("WARC-Profile", PROFILE)]
        return member(headers, http)
    return member(headers, http + payload)


def _writer(folder: str, file_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        done, out, name, size, records = [], None, "", 0, 0

        def close():
            if out:
                out.close()
                done.append((f"{folder}/{name}", size, records))

        for batch in batches:
            for page_id, url, html, first in zip(*batch.columns, strict=True):
                if out is None or size >= file_bytes:
                    close()
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                    info = member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE)], b"format: WARC File Format 1.1\r\n")
                    size += out.write(info) or len(info)
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                packed = _record(page_id.as_py(), url.as_py(), payload, digest, first.as_py())
                size += out.write(packed) or len(packed)
                records += 1
        close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "size", "records"])

    return write


def write_archives(pages: DataFrame, min_bytes: int = 0, file_bytes: int = 64 << 20) -> DataFrame:
    """Write ``pages`` (page_id, url, html) to new files in the shared folder; the manifest (path, size, records)."""
    payload = F.coalesce("html", F.lit(""))
    sized = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.sha1(payload.cast("binary")).alias("_sha"), F.octet_length(payload).alias("_n")
    )
    # Only payloads that occur again need their first page; the pages themselves are shuffled by payload only if those are many.
    firsts = cut(sized.groupBy("_sha", "_n").agg(F.count("*").alias("n_rows"), F.min("page_id").alias("_first")).where("n_rows > 1"), "warc-firsts")
    linked = join_groups(sized, firsts, ["_sha", "_n"], F.xxhash64("page_id", "url"))
    first = F.when(F.col("_n") >= min_bytes, F.coalesce("_first", "page_id")).otherwise(F.col("page_id"))
    folder = shared_path(pages.sparkSession, "warc")
    manifest = linked.select("page_id", "url", "html", first.alias("first")).mapInArrow(
        _writer(folder, file_bytes), "path string, size bigint, records bigint"
    )
    return cut(manifest, "warc-manifest")


class _Window:
    """Bytes of a file from a moving place on."""

    def __init__(self, file, start: int, step: int = 1 << 18) -> None:
        self.file, self.base, self.step, self.data = file, start, step, b""

    def more(self) -> bool:
        self.file.seek(self.base + len(self.data))
        new = self.file.read(self.step)
        self.data += new
        return bool(new)

    def skip_to(self, place: int) -> None:
        cut = place - self.base
        self.data, self.base = (self.data[cut:], place) if cut <= len(self.data) else (b"", place)


def _inflate(window: _Window, place: int) -> tuple[bytes, int] | None:
    """(content, end) of the member at ``place``, or None if none is there."""
    unpack, content, at = zlib.decompressobj(31), [], place - window.base
    try:
        while not unpack.eof:
            if at >= len(window.data) and not window.more():
                return None
            content.append(unpack.decompress(window.data[at:]))
            at = len(window.data)
            if len(content) == 1 and len(content[0]) >= 7 and not content[0].startswith(b"WARC/1."):
                return None
    except zlib.error:
        return None
    return b"".join(content), window.base + at - len(unpack.unused_data)


def parse(content: bytes) -> tuple[dict[str, str], bytes] | None:
    """Headers (names in lower case) and block of a record; None if it isn't one."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        return None
    headers = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            return None
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not {"warc-type", "warc-record-id"} <= headers.keys() or not length.isdigit() or int(length) > len(rest):
        return None
    return headers, rest[: int(length)]


def records(path: str, start: int, end: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records of a file that start in [start, end)."""
    fs, name = _open(path)
    with fs.open_input_file(name) as file:
        window, place = _Window(file, start), start
        while place < end:
            window.skip_to(place)
            found = window.data.find(MAGIC)
            if found < 0:
                kept = max(0, len(window.data) - len(MAGIC) + 1)
                if window.base + kept >= end or not window.more():
                    return
                place = window.base + kept
                continue
            place = window.base + found
            if place >= end:
                return
            got = _inflate(window, place)
            record = got and parse(got[0])
            if not record:
                place += 1
                continue
            yield place, *record
            place = got[1]


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema(
        [("path", pa.string()), ("offset", pa.int64()), ("warc_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string())]
        + [("refers_to", pa.string()), ("declared_digest", pa.string()), ("http_length", pa.int64()), ("payload", pa.binary())]
    )

    def flush(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)

    for batch in batches:
        rows, size = [], 0
        for path, start, end in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for offset, head, block in records(path, start, end):
                http, _, payload = block.partition(b"\r\n\r\n")
                length = re.search(rb"(?im)^content-length: *(\d+)\r?$", http)
                digest = head.get("warc-payload-digest", "").removeprefix("sha1:") or None
                rows.append(
                    (path, offset, head["warc-type"], head["warc-record-id"], head.get("warc-target-uri"), head.get("warc-refers-to"), digest, int(length[1]) if length else None, payload)
                )
                size += len(payload)
                if size > 8 << 20:
                    yield flush(rows)
                    rows, size = [], 0
        if rows:
            yield flush(rows)


RECORDS = "path string, offset bigint, warc_type string, record_id string, target_uri string, refers_to string, declared_digest string, http_length bigint, payload binary"


def read_archives(manifest: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """All records of the files in ``manifest`` (path, size), read by byte ranges of ``split_bytes``."""
    starts = manifest.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(split_bytes))).alias("start"))
    ranges = starts.select("path", "start", F.least(F.col("start") + split_bytes, F.col("size")).alias("stop"))
    n = manifest.agg(F.sum(F.ceil(F.col("size") / split_bytes))).first()[0]
    # A stated number of partitions is not coalesced: the rows are tiny, the work behind them isn't.
    return ranges.repartition(max(1, min(int(n or 1), MOST_TASKS))).mapInArrow(_reader, RECORDS)


def _base32(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [base64.b32encode(hashlib.sha1(p.as_py()).digest()).decode() for p in batch.column("payload")]
        yield pa.RecordBatch.from_arrays(
            [*batch.columns, pa.array(digests, pa.string())], names=[*batch.schema.names, "payload_digest"]
        )


def digest(pages: DataFrame, split_bytes: int = 8 << 20) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every page, after writing and reading archives.

    A response's length and digest come from the payload read; a revisit has none and declares its own."""
    manifest = write_archives(pages.select("page_id", "url", "html"))
    read = read_archives(manifest, split_bytes).where("warc_type IN ('response', 'revisit')").mapInArrow(_base32, RECORDS + ", payload_digest string")
    response = F.col("warc_type") == "response"
    number = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("bigint")
    return read.select(
        number("record_id").alias("page_id"),
        F.when(response, F.octet_length("payload").cast("bigint")).otherwise(F.col("http_length")).alias("payload_bytes"),
        F.when(response, F.col("payload_digest")).otherwise(F.col("declared_digest")).alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.when(~response, number("refers_to")).alias("refers_to"),
    )
