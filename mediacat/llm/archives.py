"""Answers of the title service (the lookup cache) as WARC archives, and a reader that salvages damaged ones."""

from __future__ import annotations

import hashlib
import io
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mediacat.llm.shared import shared_folder, written

LEAST_PAYLOAD = 100
ARCHIVE_BYTES = 16 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = b"\x1f\x8b\x08"
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
MEMBER_OR_VERSION = re.compile(re.escape(GZIP) + b"|" + VERSION.pattern)
HEAD_END = re.compile(rb"\r\n\r\n")
SIGN_BYTES = 10
WINDOW = 4 << 20
LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$")

RECORDS = (
    "path string, start bigint, end bigint, kind string, key string, url string, payload_bytes bigint,"
    " payload_digest string, refers_to string, value string, reason string"
)
FIELDS = [f.strip().split() for f in RECORDS.split(",")]
ARROW = pa.schema([(n, pa.int64() if t == "bigint" else pa.string()) for n, t in FIELDS])


def digest(payload: bytes) -> str:
    return hashlib.sha256(payload).hexdigest()


def _plain(text: str, safe: str = "") -> str:
    """A header value: nothing in it can end the line."""
    return quote(text, safe=safe, encoding="utf-8", errors="surrogatepass")


URL_SIGNS = "!#$%&'()*+,/:;=?@[]~"


def record(key: str, url: str | None, payload: bytes, refers_to: str | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:lookup:{_plain(key)}>", f"WARC-Date: {date}", f"WARC-Target-URI: {_plain(url or 'about:blank', URL_SIGNS)}",
        f"WARC-Block-Digest: sha256:{digest(block)}", f"WARC-Payload-Digest: sha256:{digest(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:lookup:{_plain(refers_to)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(data) + squeeze.flush()


def _key(text: str) -> str:
    return unquote(text.strip().removeprefix("<urn:lookup:").removesuffix(">"), errors="surrogatepass")


class _Window:
    """Bytes of an open file by their place; WINDOW of them, or one longer record, are held at a time."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()
        self.base, self.held = 0, b""

    def _offset(self, at: int, n: int) -> int:
        """Where `at` lies in what is held, after reading what of its next n bytes is not."""
        n = max(0, min(n, self.size - at))
        if at < self.base or at + n > self.base + len(self.held):
            self.base, self.held = at, self.file.read_at(max(n, min(WINDOW, self.size - at)), at)
        return at - self.base

    def come_to(self, at: int) -> None:
        """Hold a sixteenth of a window from `at` on, so that a header is not read in two halves."""
        self._offset(at, WINDOW // 16)

    def bytes(self, at: int, n: int) -> bytes:
        if at >= self.size:
            return b""
        start = self._offset(at, n)
        return self.held[start : start + n]

    def peek(self, at: int, n: int) -> bytes:
        """As `bytes`, for a place to which the reading may not come: what is held stays."""
        if self.base <= at and at + n <= self.base + len(self.held):
            return self.bytes(at, n)
        return self.file.read_at(min(n, self.size - at), at) if at < self.size else b""

    def find(self, sign: re.Pattern, at: int) -> int:
        """Where the next `sign` (of at most SIGN_BYTES) begins, the file's end if there is none."""
        while at < self.size:
            start = self._offset(at, SIGN_BYTES)  # may read, so before what is held is looked at
            hit = sign.search(self.held, start)
            if hit:
                return self.base + hit.start()
            end = self.base + len(self.held)
            if end >= self.size:
                break
            at = max(at + 1, end - SIGN_BYTES + 1)
        return self.size


def _parse(source: _Window, at: int) -> tuple[dict, int]:
    """The record at `at` and where it ends; ValueError says which check it failed."""
    if not VERSION.match(source.bytes(at, SIGN_BYTES)):
        raise ValueError("no version line")
    head_end = source.find(HEAD_END, at)
    if head_end >= source.size:
        raise ValueError("header does not end")
    fields = {}
    for line in source.bytes(at, head_end + 2 - at).decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            fields[name.strip().lower()] = value.strip()
    if not fields.get("content-length", "").isdigit():
        raise ValueError("no content length")
    start, end = head_end + 4, head_end + 4 + int(fields["content-length"])
    if source.peek(end, 4) != b"\r\n\r\n":
        raise ValueError("block does not end where its length says")
    block = source.bytes(start, end - start)
    want = fields.get("warc-block-digest", "")
    if want.startswith("sha256:") and want[7:] != digest(block):
        raise ValueError("block digest differs")
    http_end = block.find(b"\r\n\r\n")
    payload = block[http_end + 4 :] if http_end >= 0 else block
    kind = fields.get("warc-type", "")
    told = fields.get("warc-payload-digest", "")
    size = len(payload)
    if kind == "revisit":
        length = LENGTH.search(block)
        size = int(length[1]) if length else None
    elif told.startswith("sha256:") and told[7:] != digest(payload):
        raise ValueError("payload digest differs")
    refers = fields.get("warc-refers-to")
    return {
        "kind": kind, "key": _key(fields.get("warc-record-id", "")), "url": fields.get("warc-target-uri", ""),
        "payload_bytes": size, "payload_digest": told.removeprefix("sha256:") or digest(payload),
        "refers_to": None if refers is None else _key(refers),
        "value": None if kind == "revisit" else payload.decode("utf-8", "replace"),
    }, end + 4


def _member_at(source: _Window, at: int) -> tuple[bytes, int]:
    """The gzip member at `at`, checked, and where it ends; it must begin as a record does."""
    inflate, out, pos = zlib.decompressobj(31), bytearray(), at
    try:
        while not inflate.eof and pos < source.size:
            part = source.bytes(pos, 1 << 16)
            out += inflate.decompress(part)
            pos += len(part)
            if len(out) >= SIGN_BYTES and not VERSION.match(out):
                raise ValueError("no record in a gzip member")
    except zlib.error as e:
        raise ValueError("gzip member is damaged") from e
    if not inflate.eof:
        raise ValueError("gzip member is cut short")
    return bytes(out), pos - len(inflate.unused_data)


def salvage(archive: bytes | pa.NativeFile, members: bool = True) -> Iterator[tuple[int, int, dict]]:
    """(start, end, record) of all records of an archive in order; a quarantined gap has kind 'gap' and a reason.

    A record stands by itself or in a gzip member, also in turns; all records of a member have the member's
    start and end, and what is unreadable in a member that holds others is a gap with its place. Where a check
    fails, the next gzip member or version line, whichever comes first, that reads as a whole record
    is looked for, from one byte further on; what lies between is the gap. The file is read in windows:
    held are WINDOW bytes, the longest record and the longest member, whatever the length of the archive. A length that damage
    made larger is checked by the four bytes at its end before the block is read.
    """
    source = _Window(pa.BufferReader(archive) if isinstance(archive, bytes) else archive)
    sign = MEMBER_OR_VERSION if members else VERSION
    at, gap, why = 0, None, ""
    while at < source.size:
        source.come_to(at)
        try:
            if members and source.bytes(at, len(GZIP)) == GZIP:
                inside, end = _member_at(source, at)
                found = [r for _, _, r in salvage(inside, members=False)]
                if all(r["kind"] == "gap" for r in found):
                    raise ValueError(found[0]["reason"] if found else "no record in a gzip member")
            else:
                one, end = _parse(source, at)
                found = [one]
        except ValueError as e:
            if gap is None:
                gap, why = at, str(e)
            at = source.find(sign, at + 1)
            continue
        if gap is not None:
            yield gap, at, {"kind": "gap", "reason": why}
            gap = None
        for r in found:
            yield at, end, r
        at = end
    if gap is not None:
        yield gap, source.size, {"kind": "gap", "reason": why}


def _repeats(lookups: DataFrame, folder: str) -> DataFrame:
    """Of equal values of LEAST_PAYLOAD bytes or more: digest, first (the smallest key with it)."""
    payload = F.coalesce(F.col("value"), F.lit(""))
    known = lookups.where(F.octet_length(payload) >= LEAST_PAYLOAD).groupBy(F.sha2(payload, 256).alias("digest"))
    counted = known.agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("n"))
    return written(counted.where("n > 1").select("digest", "first"), folder, "repeats")


def write_archives(
    lookups: DataFrame, folder: str, key: str = "key", url: str = "url", value: str = "value",
    date: str = "1970-01-01T00:00:00Z",
) -> DataFrame:
    """Write a WARC record for each cached answer, in gzip members of archives below `folder`: path, records.

    Equal values of 100 bytes or more are written once, with the smallest key; the others become
    revisits that refer to it (repeated rows of that key are all responses). NULL values are empty, a
    NULL url is about:blank, a NULL key is the empty one. An archive ends after ARCHIVE_BYTES, so that
    a reader needs no more memory than that and its longest record. A task writes files of its own
    attempt and names them when it ends; the list is a written table, so files of lost tasks are in no
    list. No rows, no archives.
    """
    lookups = lookups.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(value).alias("value"))
    payload = F.coalesce(F.col("value"), F.lit(""))
    ready = (
        lookups.withColumn("digest", F.when(F.octet_length(payload) >= LEAST_PAYLOAD, F.sha2(payload, 256)))
        .join(_repeats(lookups, folder), "digest", "left")
        .select(
            F.coalesce(F.col("key").cast("string"), F.lit("")).alias("key"), "url", "value",
            F.when(F.col("first") != F.col("key"), F.col("first").cast("string")).alias("refers_to"),
        )
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        task, paths, counts = TaskContext.get(), [], []
        out, held, n = io.BytesIO(), 0, 0
        fs = root = None

        def close() -> None:
            nonlocal out, held, n, fs, root
            if fs is None:
                fs, root = FileSystem.from_uri(f"{folder}/warc")
                fs.create_dir(root, recursive=True)
            name = f"{task.partitionId():06d}-{task.taskAttemptId()}-{len(paths):05d}.warc.gz"
            with fs.open_output_stream(f"{root}/{name}", compression=None) as f:
                f.write(out.getvalue())
            paths.append(f"{folder}/warc/{name}")
            counts.append(n)
            out, held, n = io.BytesIO(), 0, 0

        for batch in batches:
            for at in range(0, len(batch), 64):
                for k, u, v, r in zip(*[c.to_pylist() for c in batch.slice(at, 64).columns]):
                    data = record(k, u, (v or "").encode("utf-8", "surrogatepass"), r, date)
                    out.write(member(data))
                    held, n = held + len(data), n + 1
                    if held >= ARCHIVE_BYTES:
                        close()
        if n:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    return written(ready.mapInArrow(write, "path string, records bigint"), folder, "archives")


def read_archives(archives: DataFrame, path: str = "path") -> DataFrame:
    """All records of WARC archives, and the gaps that could not be read.

    A row for each record: path, start and end (bytes in the file), kind (response, revisit or another
    WARC type), key, url, payload_bytes and payload_digest (of the full payload, also for revisits),
    refers_to, value. A stretch that fails its checks is a row of kind 'gap' with a reason; the records
    after it are read. An empty file has no rows. A file is read by one task, in windows (see `salvage`).
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSystem

        for batch in batches:
            for name in batch.column(0).to_pylist():
                fs, place = FileSystem.from_uri(name)
                with fs.open_input_file(place) as f:
                    rows = []
                    for start, end, found in salvage(f):
                        rows.append({"path": name, "start": start, "end": end} | found)
                        if len(rows) == 500:
                            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return archives.select(F.col(path).alias("path")).mapInArrow(read, RECORDS)


def archive_lookups(lookups: DataFrame, key: str = "key", url: str = "url", value: str = "value") -> DataFrame:
    """Cached answers written to WARC archives in the shared folder and read back from them."""
    archives = write_archives(lookups, shared_folder(lookups.sparkSession), key, url, value)
    return read_archives(archives.repartition(archives.sparkSession.sparkContext.defaultParallelism * 2, "path"))
