"""WARC archives: writing with revisit records, and a reader that salvages damaged files.

Writing: each task rolls gzip-per-record files in a shared folder under names of its own
attempt; the list of files that its commit returns is what counts, so a lost or repeated task
leaves no file that is read twice.

Reading: records are read member by member (plain files: version line by version line).  When
a check fails - gzip CRC, header block, Content-Length, block digest - the reader looks for the
next gzip magic or version line from which a whole record can be read, goes on there, and logs
the bytes between as quarantined.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import new_uri, written

VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ROLL = 16 << 20
CHUNK = 1 << 20
#: Header of a plain record, at most; that of a gzip member ends with its member.
MOST_HEADER = 1 << 16
#: Header of a gzip member, at most.
MOST_MEMBER_HEADER = 64 << 20
_START = re.compile(rb"WARC/1\.[01]\r?\n")
_MARK = re.compile(rb"\x1f\x8b\x08|WARC/1\.[01]\r?\n")


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    offset: int = 0
    length: int = 0


@dataclass
class Gap:
    """Bytes that no record was made of."""

    offset: int
    length: int
    reason: str


def digest(data: bytes) -> str:
    """Base32 SHA-1, as in WARC digests."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value).strip()


def encode_record(headers: dict[str, str], block: bytes) -> bytes:
    lines = [VERSION, *(f"{k}: {_clean(v)}".encode() for k, v in headers.items()), f"Content-Length: {len(block)}".encode(), b"", b""]
    return b"\r\n".join(lines) + block + b"\r\n\r\n"


def parse_record(data: bytes) -> Record:
    """A record from exactly its bytes; ValueError says what is wrong."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("no end of header")
    lines = head.split(b"\r\n")
    if not _START.fullmatch(lines[0] + b"\n"):
        raise ValueError("no version line")
    headers = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.decode("utf-8", "replace").strip()] = value.decode("utf-8", "replace").strip()
    length = {k.lower(): v for k, v in headers.items()}.get("content-length", "")
    if not length.isdigit():
        raise ValueError("bad content length")
    block = rest[: int(length)]
    if len(block) != int(length) or rest[int(length) :].strip(b"\r\n"):
        raise ValueError("content length does not fit")
    want = headers.get("WARC-Block-Digest", "")
    if want.startswith("sha1:") and want[5:] != digest(block):
        raise ValueError("block digest differs")
    return Record(headers, block)


class _Archive:
    """A file that can be read at any place, through one buffer of ``CHUNK`` bytes; ``after`` finds where records may begin."""

    def __init__(self, file):
        self.file, self.size = file, file.seek(0, 2) or file.tell()
        self._buffer, self._from = b"", 0
        self._hits: deque[int] = deque()
        self._scanned = 0

    def read(self, offset: int, n: int) -> bytes:
        if self._from <= offset and offset + n <= self._from + len(self._buffer):
            return self._buffer[offset - self._from : offset - self._from + n]
        self.file.seek(offset)
        if n >= CHUNK:
            return self.file.read(n)
        self._buffer, self._from = self.file.read(CHUNK), offset
        return self._buffer[:n]

    def after(self, offset: int) -> int:
        """The next place behind ``offset`` with a gzip magic or a version line, or the end.  Every byte is searched once."""
        while True:
            while self._hits and self._hits[0] <= offset:
                self._hits.popleft()
            if self._hits:
                return self._hits[0]
            start = max(self._scanned, offset + 1)
            if start >= self.size:
                return self.size
            self.file.seek(start)
            data = self.file.read(CHUNK + 16)  # a mark may lie across the end of the piece
            self._hits.extend(start + m.start() for m in _MARK.finditer(data) if m.start() < CHUNK)
            self._scanned = start + CHUNK


def _length(head: bytes) -> int:
    m = re.search(rb"\r\ncontent-length:[ \t]*(\d{1,18})(?!\d)", head, re.I)
    if not m:
        raise ValueError("bad content length")
    return int(m[1])


def _member(a: _Archive, offset: int) -> tuple[bytes, int]:
    """The gzip member at a place, unpacked, and its packed length.

    No more is unpacked than its header says the record has; pieces are small at first, as most false magics fail at once.
    """
    unpack, out, held, at, piece, whole = zlib.decompressobj(31), [], 0, offset, 512, None
    while not unpack.eof:
        part = a.read(at, min(piece, CHUNK))
        if not part:
            raise ValueError("member is cut off")
        at, piece = at + len(part), piece * 2
        while part and not unpack.eof:
            try:
                data = unpack.decompress(part, CHUNK)
            except zlib.error as e:
                raise ValueError(f"gzip: {e}") from None
            out.append(data)
            held, part = held + len(data), unpack.unconsumed_tail
            if whole is None:
                head = b"".join(out)
                out = [head]
                if (end := head.find(b"\r\n\r\n")) >= 0:
                    whole = end + 4 + _length(head[:end])
                elif held > MOST_MEMBER_HEADER:
                    raise ValueError("no end of header")
            if whole is not None and held > whole + 4:
                raise ValueError("content length does not fit")
    return b"".join(out), at - offset - len(unpack.unused_data)


def _plain(a: _Archive, offset: int) -> tuple[bytes, int]:
    """The plain record at a place, and its length with the blank lines behind.

    Whether a record ends where its header says is looked up there before its block is read, and a large block's digest
    is taken piece by piece, so that a false length costs no memory.
    """
    n = 4096
    while (end := (head := a.read(offset, n)).find(b"\r\n\r\n")) < 0:
        if n > MOST_HEADER or len(head) < n:
            raise ValueError("no end of header")
        n *= 2
    if end > MOST_HEADER:
        raise ValueError("no end of header")
    length = _length(head[:end])
    size = end + 4 + length
    if offset + size > a.size:
        raise ValueError("record is cut off")
    behind = a.read(offset + size, 16)
    last = offset + size + len(behind) >= a.size
    if not (behind[:4] == b"\r\n\r\n" or behind[:2] == b"\r\n" and (behind[2:7] == b"WARC/" or behind[2:5] == b"\x1f\x8b\x08") or last and behind in (b"", b"\r\n")):
        raise ValueError("content length does not fit")
    want = re.search(rb"\r\nWARC-Block-Digest:[ \t]*sha1:([A-Z2-7]+)", head[:end])
    if length > CHUNK and want:
        seen = hashlib.sha1()
        for at in range(0, length, CHUNK):
            seen.update(a.read(offset + end + 4 + at, min(CHUNK, length - at)))
        if base64.b32encode(seen.digest()) != want[1]:
            raise ValueError("block digest differs")
    tail = 4 if behind[:4] == b"\r\n\r\n" else 2 if behind[:2] == b"\r\n" else 0
    return a.read(offset, size), size + tail


def salvage(file) -> Iterator[Record | Gap]:
    """Records and gaps of an archive in file order.

    ``file`` can seek.  Memory holds one record, as long as its header says and its checks bear out, beside two buffers of
    ``CHUNK`` bytes; a header of more than ``MOST_HEADER`` bytes (``MOST_MEMBER_HEADER`` in a gzip member) isn't taken for one.
    Time is linear in the bytes and in the number of places that look like a start.
    """
    a, offset, bad, why = _Archive(file), 0, None, ""
    while offset < a.size:
        try:
            start = a.read(offset, 16)
            if len(start) < 3:
                raise ValueError("trailing bytes")
            if start[:2] == b"\x1f\x8b":
                data, size = _member(a, offset)
            elif _START.match(start):
                data, size = _plain(a, offset)
            else:
                raise ValueError("neither a gzip member nor a version line")
            record = parse_record(data)
        except ValueError as e:
            if bad is None:
                bad, why = offset, str(e)
            offset = a.after(offset)
            continue
        if bad is not None:
            yield Gap(bad, offset - bad, why)
            bad = None
        record.offset, record.length = offset, size
        offset += size
        yield record
    if bad is not None:
        yield Gap(bad, a.size - bad, why)


def record_id(number: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, 'row:' + number)}>"


def _records_of(batch: pa.RecordBatch) -> Iterator[bytes]:
    columns = [batch.column(c).to_pylist() for c in ("row", "url", "payload", "ref")]
    for row, url, payload, ref in zip(*columns):
        data = (payload or "").encode("utf-8", "surrogatepass")
        headers = {"WARC-Type": "response" if ref is None else "revisit", "WARC-Record-ID": record_id(str(row)), "WARC-Date": "2024-01-01T00:00:00Z"}
        if url is not None:
            headers["WARC-Target-URI"] = url
        headers |= {"X-Row": str(row), "X-Payload-Length": str(len(data)), "WARC-Payload-Digest": "sha1:" + digest(data), "Content-Type": "text/html"}
        if ref is not None:
            headers |= {"WARC-Profile": REVISIT_PROFILE, "WARC-Refers-To": record_id(str(ref)), "X-Refers-To-Row": str(ref)}
            data = b""
        headers["WARC-Block-Digest"] = "sha1:" + digest(data)
        yield encode_record(headers, data)


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI of the shared folder or of a listed archive."""
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri) if ":" in uri else "file://" + uri)


def _write(uri: str, level: int):
    def run(batches):
        fs, base = _filesystem(uri)
        fs.create_dir(base, recursive=True)
        out, path, size, count = None, "", 0, 0
        done = []
        for batch in batches:
            for record in _records_of(batch):
                if out is None:
                    path = f"part-{uuid.uuid4().hex}.warc.gz"
                    out, size, count = fs.open_output_stream(f"{base}/{path}", compression=None), 0, 0
                pack = zlib.compressobj(level, zlib.DEFLATED, 31)
                data = pack.compress(record) + pack.flush()
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= ROLL:
                    out.close()
                    done.append((path, count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((path, count, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.int64())], names=["file", "records", "bytes"])

    return run


def plan_revisits(pages: DataFrame, id_col: str, payload_col: str, least: int = 0) -> DataFrame:
    """(row, ref): the row whose payload equals that of ``row`` and has the largest id, null for that row itself.

    Only digests are shuffled.  Payloads under ``least`` bytes stay responses.
    """
    data = F.encode(F.coalesce(F.col(payload_col).cast("string"), F.lit("")), "UTF-8")
    small = pages.select(F.col(id_col).cast("long").alias("row"), F.sha1(data).alias("digest"), F.octet_length(data).alias("size"))
    small = written(small.where("row is not null").groupBy("row").agg(F.min("digest").alias("digest"), F.countDistinct("digest").alias("kinds"), F.max("size").alias("size")), "digests")
    small = small.where((F.col("kinds") == 1) & (F.col("size") >= least))
    last = small.groupBy("digest").agg(F.max("row").alias("ref"), F.count("*").alias("n")).where("n > 1")
    return small.join(last, "digest").where("row <> ref").select("row", "ref")


def write_warc(pages: DataFrame, uri: str, id_col="page_id", url_col="url", payload_col="html", least: int = 0, level: int = 1) -> DataFrame:
    """Writes a record for each row under ``uri``; returns the table of files (file, records, bytes) that make up the archive.

    A null payload is empty; a null url gives no target header.  Rows with a null id are all
    responses.  Rows that repeat an id with one payload are written as often as they occur, each
    a revisit if the largest id of the payload is another; with different payloads they stay responses.
    """
    refs = plan_revisits(pages, id_col, payload_col, least)
    rows = pages.select(F.col(id_col).cast("long").alias("row"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("payload")).join(refs, "row", "left")
    rows = rows.select(F.coalesce(F.col("row").cast("string"), F.lit("null")).alias("row"), "url", "payload", F.col("ref").cast("string").alias("ref"))
    return written(rows.mapInArrow(_write(uri, level), "file string, records long, bytes long"), "manifest")


def _read(uri: str, keep_block: bool):
    def run(batches):
        for batch in batches:
            for file in batch.column("file").to_pylist():
                fs, path = _filesystem(f"{uri}/{file}")
                rows: list[tuple] = []
                size = 0
                with fs.open_input_file(path) as stream:
                    for x in salvage(stream):
                        if isinstance(x, Gap):
                            rows.append((file, x.offset, x.length, None, None, x.reason))
                        else:
                            rows.append((file, x.offset, x.length, list(x.headers.items()), x.block if keep_block else None, None))
                            size += len(x.block) if keep_block else 500
                        if size > 8 << 20:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return run


_ROW = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary()), ("quarantine", pa.string())])
ROW = "file string, offset long, length long, headers map<string,string>, block binary, quarantine string"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _ROW)], schema=_ROW)


def read_warc(files: DataFrame, uri: str, keep_block: bool = True) -> DataFrame:
    """Records and quarantined gaps of the archives named in column ``file`` of ``files``, below ``uri``.

    A record has headers and block; a gap has only its place, length and reason (``quarantine``).
    Of a header that repeats the last stays.  No files give no rows.
    """
    n = max(1, min(files.count(), 4096))
    return files.select("file").repartition(n).mapInArrow(_read(uri, keep_block), ROW)


def warc_round_trip(pages: DataFrame, id_col="page_id", url_col="url", payload_col="html", least: int = 0) -> DataFrame:
    """Writes ``pages`` as archives and gives what their records say: a row for each.

    Columns: id, payload_bytes, payload_digest, record_type, refers_to.  Of a response both
    are computed anew from the block read; a revisit has them in its headers.
    """
    uri = new_uri(pages.sparkSession, "warc")
    rows = read_warc(write_warc(pages, uri, id_col, url_col, payload_col, least), uri).where("quarantine is null")
    return rows.mapInArrow(_payload_facts, "row string, kind string, size long, digest string, ref string").select(
        F.expr("try_cast(row as bigint)").alias(id_col),
        F.col("size").alias("payload_bytes"),
        F.col("digest").alias("payload_digest"),
        F.col("kind").alias("record_type"),
        F.col("ref").cast("long").alias("refers_to"),
    )


def _payload_facts(batches):
    for batch in batches:
        out = []
        for headers, block in zip(batch.column("headers").to_pylist(), batch.column("block").to_pylist()):
            h = dict(headers)
            if h["WARC-Type"] == "response":
                out.append((h["X-Row"], "response", len(block), digest(block), None))
            else:
                out.append((h["X-Row"], "revisit", int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["X-Refers-To-Row"]))
        columns = list(zip(*out)) if out else [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()))], names=["row", "kind", "size", "digest", "ref"])
