"""WARC archives: a writer with revisit records and a salvage reader.

The writer puts one gzip member per record into its files.  Records whose payload equals
that of a record with a smaller id are revisits and refer to it.

The reader checks every record: its member inflates to the checksum, the version line and
header are whole, the block has the stated length and is followed by two line ends, and the
payload has the stated digest.  Where a check fails it looks for the next member or version
line at which a valid record begins, goes on from there, and logs the bytes in between as
a gap with the check that failed.  It does so in the content of a member, too, and a damaged
member is read as far as it inflates.  Members and plain records may stand in one file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from holdfast.llm import textbytes as tb
from holdfast.llm.files import read_binary, write_binary
from holdfast.session import discard, materialize

#: Compressed bytes that a task gathers before it hands them to the writer.
CHUNK = 4 << 20
#: Bytes by which a damaged member is inflated.
STEP = 4096
#: Bytes by which a sound one is: what stands behind a member is copied up to the end of such a piece, not of the file.
PIECE = 16 << 10
#: Payloads of fewer bytes are never stored as revisits.
MIN_REVISIT = 0
#: Up to so many revisit ids are broadcast (about 64 bytes each); more are joined by an exchange.
BROADCAST_IDS = 200_000
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
VERSION = b"WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
_MEMBER = b"\x1f\x8b\x08"
_START = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r?\n")
_LINE = re.compile(rb"WARC/\d\.\d\r?\n")
_HEADER_END = re.compile(rb"\r\n(?:\r\n|WARC/\d\.\d\r?\n)")


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


#: Ends a file's row in the writer: a gzip member without content.
EMPTY_MEMBER = _member(b"")


def payload_digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, without a prefix."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id, url, payload: bytes, digest: str, refers_to=None) -> bytes:
    """A response record, or a revisit record without the payload, in plain form."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{quote(str(page_id))}>")
    if url is not None:
        head.append("WARC-Target-URI: " + quote(url, safe="%/:=&?~#+!$,;'@()*[]"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{quote(str(refers_to))}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _payloads(column):
    """Payloads of a string or binary column, in slices; NULL is empty."""
    column = column.cast(pa.large_binary())
    for low, high, _, _ in tb.slices(column):
        yield low, high, [v or b"" for v in column.slice(low, high - low).to_pylist()]


def _digests(batches):
    for batch in batches:
        for low, high, values in _payloads(batch.column(1)):
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(low, high - low).cast(pa.int64()), pa.array([len(v) for v in values], pa.int64()),
                pa.array([payload_digest(v) for v in values])], names=["page_id", "size", "digest"])


def _records(batches):
    """Gzip members of the rows' records, many to a row."""
    parts, size = [], 0
    for batch in batches:
        for low, high, values in _payloads(batch.column(2)):
            others = (c.slice(low, high - low).to_pylist() for c in (batch.column(0), batch.column(1), batch.column(3)))
            for page_id, url, seen, payload in zip(*others, values):
                digest = payload_digest(payload)
                parts.append(_member(record(page_id, url, payload, digest, dict(seen or ()).get(digest))))
                size += len(parts[-1])
                if size >= CHUNK:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["members"])
                    parts, size = [], 0
    if parts:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(parts)], pa.binary())], names=["members"])


def write_archive(pages: DataFrame, path: str, min_revisit: int = MIN_REVISIT) -> None:
    """Write a record for each row of ``pages`` (``page_id``, ``url``, ``html``) to files below ``path``.

    Of rows with equal payloads of at least ``min_revisit`` bytes, those with the smallest id are responses and the
    others revisits.  A NULL page has an empty payload; a row without id is a response without a record id; without
    URL there is no target.  Rows that repeat an id and a page are equal records.  Other columns are not read.  Every
    task's rows are one file.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    sums = pages.select("page_id", "html").mapInArrow(_digests, "page_id long, size long, digest string")
    # Read four times; the pages only for this and for the records.
    sums = written = materialize(sums.where((F.col("size") >= min_revisit) & F.col("page_id").isNotNull()), "digests", "zstd")
    first = sums.groupBy("digest", "size").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
    repeats = sums.join(first.where("first < last"), ["digest", "size"]).where("page_id <> first")
    seen = repeats.groupBy("page_id").agg(F.map_from_entries(F.collect_set(F.struct("digest", "first"))).alias("seen"))
    if seen.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS:
        seen = F.broadcast(seen)
    rows = pages.join(seen, "page_id", "left").select("page_id", "url", "html", "seen")
    write_binary(rows.mapInArrow(_records, "members binary"), "members", EMPTY_MEMBER, path)
    discard(written)


class Broken(Exception):
    """A check that failed."""


def _parse(data: bytes, at: int) -> tuple[dict, int]:
    """The plain record at ``at`` and where it ends."""
    line = _LINE.match(data, at)
    if not line:
        raise Broken("no version line")
    # Find the blank line that ends the header, however long that is, but not beyond the next version line.
    blank = _HEADER_END.search(data, at)
    if not blank or blank[0] != b"\r\n\r\n":
        raise Broken("header does not end")
    stop = blank.start()
    head = {}
    for row in data[line.end() : stop].split(b"\r\n"):
        name, colon, value = row.partition(b":")
        if not colon or not re.fullmatch(rb"[!-9;-~]+", name):
            raise Broken("bad header line")
        key = name.decode().lower()
        if key in head and key != "warc-concurrent-to":
            raise Broken("header field stands twice")
        head[key] = value.strip().decode("utf-8", "replace")
    if not re.fullmatch(r"\d{1,18}", head.get("content-length", "")):
        raise Broken("no content length")
    begin, end = stop + 4, stop + 4 + int(head["content-length"])
    if end > len(data) - 4 or data[end : end + 4] != b"\r\n\r\n":
        raise Broken("block does not end where it should")
    block, payload, stated = data[begin:end], None, None
    if head.get("content-type", "").startswith("application/http"):
        http, found, payload = block.partition(b"\r\n\r\n")
        if not found:
            raise Broken("HTTP header does not end")
        length = re.search(rb"^content-length:[ \t]*(\d+)", http, re.I | re.M)
        stated = int(length[1]) if length else None
    else:
        payload = block
    kind = head.get("warc-type", "")
    digest = head.get("warc-payload-digest", "")
    if kind != "revisit" and digest.startswith("sha1:") and digest[5:] != payload_digest(payload):
        raise Broken("payload has another digest")
    return {
        "type": kind, "record_id": head.get("warc-record-id"), "refers_to": head.get("warc-refers-to"),
        "target_uri": head.get("warc-target-uri"), "payload_digest": digest[5:] if digest.startswith("sha1:") else None,
        "payload_bytes": stated if kind == "revisit" else len(payload), "payload": payload if kind != "revisit" else None,
    }, end + 4


DAMAGED, OTHER_SUM = "member does not inflate", "member has another checksum"


def _steps(data: bytes, at: int):
    """What a member's bytes inflate to, piece by piece, each with where it ends; one byte at a time before an error."""
    unpack, view = zlib.decompressobj(31), memoryview(data)
    for i in range(at, len(data), STEP):
        before = unpack.copy()
        try:
            out = unpack.decompress(view[i : i + STEP])
        except zlib.error:
            break
        yield out, before, i, min(i + STEP, len(data))
        if unpack.eof:
            return
    else:
        return
    for k in range(i, min(i + STEP, len(data))):
        try:
            held = before.copy()
            yield before.decompress(view[k : k + 1]), held, k, k + 1
        except zlib.error:
            return


def _inflate(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """Content of the gzip member at ``at``, where it ends, and what is wrong with it; content up to there."""
    unpack, view, out, end = zlib.decompressobj(31), memoryview(data), [], at
    try:
        while end < len(data) and not unpack.eof:
            out.append(unpack.decompress(view[end : end + PIECE]))
            end = min(end + PIECE, len(data))
    except zlib.error as error:
        whole = any(check in str(error) for check in ("incorrect data check", "incorrect length check"))
        return b"".join(piece for piece, *_ in _steps(data, at)), at, OTHER_SUM if whole else DAMAGED
    if not unpack.eof:
        return b"".join(out), at, "member is cut off"
    return b"".join(out), end - len(unpack.unused_data), None


def _consumed(data: bytes, at: int, size: int) -> int:
    """Where the bytes of the member at ``at`` end that inflate to the first ``size`` bytes."""
    got = 0
    for out, before, low, high in _steps(data, at):
        if got + len(out) < size:
            got += len(out)
            continue
        for k in range(low, high):
            got += len(before.decompress(data[k : k + 1]))
            if got >= size:
                return k + 1
    return len(data)


def _within(content: bytes, failure: str | None) -> tuple[list[dict], list[dict], int]:
    """Valid records of a member's content, the gaps in between, both by place in the content, and where the last ends.

    In a damaged member a record is valid only if the version line of another stands behind it, or the content ends.
    """
    records, gaps, at, end = [], [], 0, 0
    while at < len(content):
        try:
            one, behind = _parse(content, at)
            ends = failure != DAMAGED and behind == len(content)
            if failure in (DAMAGED, OTHER_SUM) and not ends and not _LINE.match(content, behind):
                raise Broken("no record follows")
            records.append(one | {"inner_offset": at})
            at = end = behind
        except Broken as error:
            begin, line = at, _LINE.search(content, at + 1)
            at = line.start() if line else len(content)
            # Version lines at which no record begins lengthen the gap.
            if gaps and gaps[-1]["inner_offset"] + gaps[-1]["length"] == begin:
                gaps[-1]["length"] += at - begin
            else:
                gaps.append({"inner_offset": begin, "length": at - begin, "reason": str(error)})
    return records, gaps, end


def _open(data: bytes, at: int) -> tuple[list[dict], list[dict], int, str | None]:
    """Records and gaps of the member, or the plain record, that begins at ``at``, where it ends, and what ends it early."""
    if not data.startswith(_MEMBER, at):
        one, end = _parse(data, at)
        return [one | {"inner_offset": None}], [], end, None
    content, end, failure = _inflate(data, at)
    records, gaps, inner = _within(content, failure)
    if not records and (failure or gaps):
        raise Broken(failure or gaps[0]["reason"])
    if failure:  # what follows the last record is a gap of the file
        end, gaps = _consumed(data, at, inner), [g for g in gaps if g["inner_offset"] < inner]
    return records, gaps, end, failure


def _salvaged(data: bytes) -> Iterator[tuple[list[dict], list[dict]]]:
    """Records and gaps of :func:`salvage`, a member and what stands before the next one at a time."""
    at, opened = 0, None
    while at < len(data):
        try:
            found, inner, end, failure = opened or _open(data, at)
        except Broken as error:
            found, inner, end, failure = [], [], at, str(error)
        opened = None
        yield [one | {"offset": at, "length": end - at} for one in found], [gap | {"offset": at} for gap in inner]
        if failure is None:
            at = end
            continue
        begin, at = end, max(at + 1, end)
        while opened is None:
            start = _START.search(data, at)
            at = start.start() if start else len(data)
            if not start:
                break
            try:
                opened = _open(data, at)
            except Broken:
                at += 1
        yield [], [{"offset": begin, "length": at - begin, "inner_offset": None, "reason": failure}]


def salvage(data: bytes) -> tuple[list[dict], list[dict]]:
    """All valid records of a file, with ``offset`` and ``length``, and the gaps between them, with a ``reason``.

    Records of a member, and gaps inside one, have the member's ``offset`` and their own ``inner_offset`` in its content;
    the ``length`` of such a gap counts bytes of the content.  Of a member that is cut off the
    records that are whole stay; of one that does not inflate, or has another checksum, those behind which the next one
    begins, since damage shows late, or whose end is that of the member.  The bytes after them are a gap.  Records that stand twice are given twice.  No
    bytes give nothing.
    """
    records, gaps = [], []
    for found, between in _salvaged(data):
        records += found
        gaps += between
    return records, gaps


_FIELDS = [("type", "string"), ("record_id", "string"), ("refers_to", "string"), ("target_uri", "string"),
           ("payload_digest", "string"), ("payload_bytes", "long"), ("payload", "binary"), ("offset", "long"),
           ("length", "long"), ("inner_offset", "long"), ("reason", "string")]
_ARROW = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}


def _rows(data: bytes, with_payload: bool) -> Iterator[dict]:
    for records, gaps in _salvaged(data):
        for one in records:
            yield one | {"reason": None} | ({} if with_payload else {"payload": None})
        for gap in gaps:
            yield {"type": "gap", **{n: None for n, _ in _FIELDS[1:7]}, **gap}


def _read(with_payload: bool):
    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                rows = _rows(content.as_py() or b"", with_payload)
                while some := list(islice(rows, 256)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path.as_py()] * len(some)), *(pa.array([r[n] for r in some], _ARROW[t]) for n, t in _FIELDS)],
                        names=["path", *(n for n, _ in _FIELDS)])

    return run


def read_archive(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archive files below ``path``, one row each.

    ``type`` is the record's type, or ``gap`` for bytes that hold no valid record, with ``reason``; ``offset`` and
    ``length`` are bytes of the file (of the member a record is in), and ``inner_offset`` the place in that member's
    content (see :func:`salvage`); ``payload_bytes`` of a revisit is that of the
    page it stands for.  An empty file has no rows.  A file is read by one task.
    """
    schema = "path string, " + ", ".join(f"{n} {t}" for n, t in _FIELDS)
    return read_binary(spark, path).mapInArrow(_read(payloads), schema)


def page_of(column: str):
    """The page id of a record id that :func:`record` made."""
    return F.expr(f"CAST(regexp_extract({column}, '^<urn:page:([^>]*)>$', 1) AS BIGINT)")
