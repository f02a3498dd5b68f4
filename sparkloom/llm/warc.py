"""WARC archives: a writer, and a reader that salvages what is left of damaged files.

Archives hold one gzip member per record; the reader takes members of any
number of records, and plain records between them.  It checks every member and
record.  After a failed check it searches for the next version line in the
member's content, and for the next gzip member or version line in the file,
goes on where a record can be read and reports the bytes in between as a
quarantined gap.  Of a member that is cut off, the whole records before the cut
are kept; of one whose bytes are damaged, only those that a digest vouches for.

Files are read in windows and members are decompressed piece by piece: a reader
holds one record, and after a wrong length what was read for it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.scratch import materialize, new_path

VERSION = b"WARC/1.1"
_LINE = re.compile(rb"WARC/\d\.\d\r?\n")
_BLANK = re.compile(rb"\r?\n\r?\n")
MEMBER = b"\x1f\x8b\x08"
WINDOW = 1 << 20
PIECE = 1 << 14
#: Bytes of a record's headers, and decompressed bytes of a member that are kept until its checksum is known; a longer member is decompressed twice.
HEAD_BYTES, HELD_BYTES = 1 << 20, 1 << 22
#: Bytes after which a writer begins its next archive.
ARCHIVE_BYTES = 64 << 20
#: Digests of repeated payloads up to which they are broadcast: about 6 MB. Beyond, pages are joined by a shuffle.
BROADCAST_DIGESTS = 100_000


def payload_digest(payload: bytes) -> str:
    """Base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Record:
    """One WARC record: header names are lower case."""

    headers: dict[str, str]
    body: bytes
    start: int = 0
    end: int = 0


@dataclass
class Salvage:
    """What a reader found: `gaps` are (start, end, reason) of quarantined bytes."""

    gaps: list[tuple[int, int, str]] = field(default_factory=list)


def _clean(value: object) -> str:
    return re.sub(r"[\r\n]+", " ", str(value))


def _head_digest(lines: list[bytes]) -> str:
    return f"{zlib.crc32(b'|'.join(lines)):08x}"


def write_record(headers: dict[str, object], body: bytes, compress: bool = True) -> bytes:
    """The record's bytes; Content-Length and a checksum of the header lines are added."""
    lines = [*(f"{k}: {_clean(v)}".encode() for k, v in headers.items()), f"Content-Length: {len(body)}".encode()]
    raw = b"\r\n".join([VERSION, *lines, f"X-Header-Digest: {_head_digest(lines)}".encode(), b"", b""]) + body + b"\r\n\r\n"
    if not compress:
        return raw
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def payload_of(r: Record) -> bytes:
    """The body without the head of an HTTP message, if it is one."""
    if not r.headers.get("content-type", "").startswith("application/http"):
        return r.body
    cut = _BLANK.search(r.body)
    return r.body[cut.end() :] if cut else b""


class _Content:
    """Bytes that come piece by piece, addressed by their offset; what lies before `base` is forgotten."""

    def __init__(self, pieces: Iterator[bytes], base: int = 0, end: int | None = None):
        self.pieces, self.base, self.end = pieces, base, end
        self.data, self.over = bytearray(), False

    def fill(self, upto: int) -> bool:
        """All bytes before an offset are there, or have been."""
        while not self.over and self.base + len(self.data) < upto:
            piece = next(self.pieces, None)
            if piece is None:
                self.over = True
            else:
                self.data += piece
        return self.base + len(self.data) >= upto

    def cut(self, lo: int, hi: int) -> bytes:
        return bytes(self.data[lo - self.base : hi - self.base])

    def search(self, pattern: re.Pattern, at: int, span: int, limit: int | None = None) -> re.Match | None:
        """First match from an offset on, of at most `span` bytes, that ends within `limit` bytes."""
        step = PIECE
        while True:
            more = self.fill(at + step)
            found = pattern.search(self.data, max(0, at - self.base))
            if found and (found.end() < len(self.data) or not more):
                return found
            if not more or (limit and step > limit):
                return found
            if not limit and not found:  # only the edge can be the beginning of a match
                at = max(at, self.base + len(self.data) - span)
                self.forget(at)
            step = 2 * step if limit else step

    def forget(self, upto: int) -> None:
        del self.data[: max(0, upto - self.base)]
        self.base = max(self.base, upto)


def parse_record(c: _Content, at: int) -> tuple[Record, int] | str:
    """The record at an offset and where it ends, or what is wrong with it."""
    c.fill(at + 10)
    line = _LINE.match(c.data, at - c.base)
    if not line:
        return "no version line"
    begin = c.base + line.end()
    blank = c.search(_BLANK, begin - 2, 4, HEAD_BYTES)
    if not blank:
        return "record cut off" if c.over else "bad header"
    body = c.base + blank.end()
    headers, lines = {}, c.cut(begin, c.base + blank.start()).splitlines()
    for h in lines:
        name, colon, value = h.decode("utf-8", "replace").partition(":")
        if not colon:
            return "bad header"
        headers[name.strip().lower()] = value.strip()
    size = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]{1,15}", size):
        return "bad length"
    end = body + int(size)
    if c.end is not None and end > c.end or not c.fill(end + 4):
        return "record cut off"
    if c.cut(end, end + 4) != b"\r\n\r\n":
        return "length disagrees"
    said = headers.pop("x-header-digest", None)
    if said is not None and said != _head_digest([x for x in lines if not x.lower().startswith(b"x-header-digest:")]):
        return "header digest disagrees"
    return Record(headers, c.cut(body, end)), end + 4


def _digests(r: Record) -> list[bool]:
    """Whether each digest that the record carries of its own bytes agrees."""
    out = []
    for name, value in (("warc-payload-digest", payload_of), ("warc-block-digest", lambda r: r.body)):
        digest = r.headers.get(name, "")
        if digest.lower().startswith("sha1:") and (name == "warc-block-digest" or r.headers.get("warc-type") != "revisit"):
            out.append(payload_digest(value(r)) == digest[5:].upper())
    return out


def _records(c: _Content, at: int, gaps: list, only: bytes | None = None, vouched: bool = False) -> Iterator[tuple[Record, int, int]]:
    """(record, offset, end) of the records from an offset on; gaps gets (lo, hi, reason) of what lies between.

    Ends before bytes that begin with `only`.  With vouched=True records need a
    digest that agrees over bytes of their own.
    """
    bad, reason = None, ""
    while c.fill(at + 1):
        if only and c.fill(at + len(only)) and c.cut(at, at + len(only)) == only:
            break
        got = parse_record(c, at)
        if not isinstance(got, str):
            record, end = got
            agree = _digests(record)
            if all(agree) and (not vouched or agree and record.body):
                if bad is not None:
                    gaps.append((bad, at, reason))
                    bad = None
                yield record, at, end
                at = end
                c.forget(at)
                continue
            got = "digest disagrees" if agree and not all(agree) else "no digest vouches for it"
            more = c.fill(end + 10)
            if not more and not c.fill(end + 1) or _LINE.match(c.data, end - c.base) or only and c.cut(end, end + len(only)) == only:
                # its length is right: what follows begins a record
                bad, reason = (at, got) if bad is None else (bad, reason)
                gaps.append((bad, end, reason))
                bad, at = None, end
                c.forget(at)
                continue
        if bad is None:
            bad, reason = at, got
        if only:
            break  # in a file, members count as well: the caller searches
        line = c.search(_LINE, at + 1, 10)
        at = c.base + line.start() if line else c.base + len(c.data)
    if bad is not None:
        gaps.append((bad, at, reason))


def read_records(file: BinaryIO, salvage: Salvage) -> Iterator[Record]:
    """The records that pass their checks, in file order; everything else goes to salvage.gaps.

    A gap inside a member that is whole otherwise has the member's bounds, and
    its reason tells which bytes of the content are lost.
    """
    buffer = {"at": 0, "data": b"", "last": False}
    file.seek(0, 2)
    size = file.tell()

    def read(at: int, n: int = PIECE) -> bytes:
        """The bytes from a position on: n of them, fewer only at the end of the file."""
        lo, data = buffer["at"], buffer["data"]
        if not (lo <= at and (at + n <= lo + len(data) or buffer["last"])):
            file.seek(at)
            data = file.read(WINDOW)
            buffer.update(at=at, data=data, last=len(data) < WINDOW)
            lo = at
        return data[at - lo : at - lo + n]

    def pieces(at: int) -> Iterator[bytes]:
        while piece := read(at):
            yield piece
            at += len(piece)

    def unpacked(at: int, fine: int | None = None) -> Iterator[bytes]:
        """What a member's bytes decompress to; from position `fine` on a few bytes at a time, to have all before an error."""
        z = zlib.decompressobj(31)
        while not z.eof:
            piece = read(at, 16 if fine is not None and at >= fine else PIECE)
            if not piece:
                return
            try:
                out = z.decompress(piece)
            except zlib.error:
                return
            at += len(piece)
            if out:
                yield out

    def member(at: int) -> tuple[str, int, int, bytes | None]:
        """What is wrong with a member (nothing: ''), its end, where to read finely, and its content if that is short."""
        z, pos, out, total = zlib.decompressobj(31), at, [], 0
        while not z.eof:
            piece = read(pos)
            if not piece:
                return "member cut off", pos, pos, None
            try:
                got = z.decompress(piece)
            except zlib.error as e:
                return f"bad member: {str(e)[:60]}", pos, pos, None
            total += len(got)
            out = out + [got] if total <= HELD_BYTES else []
            pos += len(piece)
        return "", pos - len(z.unused_data), pos, b"".join(out) if total <= HELD_BYTES else None

    def next_start(at: int) -> int:
        """The next position at which a member or a version line may begin, or the end of the file."""
        while data := read(at, WINDOW // 2):
            line = _LINE.search(data)
            spots = [x for x in (data.find(MEMBER), line.start() if line else -1) if x >= 0]
            if spots:
                return at + min(spots)
            if len(data) < 16:
                return at + len(data)
            at += len(data) - 15  # a mark may lie across the edge
        return at

    at, bad, reason = 0, None, ""
    given: set[str] = set()  # records of damaged members, whose stored parts the search may meet again
    while at < size:
        start, wrong = at, ""
        if read(at, 3) == MEMBER:
            wrong, end, fine, content = member(at)
            inner: list[tuple[int, int, str]] = []
            source = iter([content]) if content is not None else unpacked(at, fine if wrong else None)
            found = ((r, start, end) for r, _, _ in _records(_Content(source), 0, inner, vouched=wrong.startswith("bad")))
        else:
            inner = []
            found = _records(_Content(pieces(at), at, size), at, inner, MEMBER)
            end = None
        for r, lo, hi in found:
            if r.headers.get("warc-record-id") in given:
                continue
            if wrong:
                given.add(r.headers.get("warc-record-id", ""))
                given.discard("")
            elif bad is not None:
                salvage.gaps.append((bad, lo, reason))
                bad = None
            r.start, r.end = lo, hi
            yield r
            at = hi
        if end is None:  # plain records: up to a member, the end of the file or damage
            salvage.gaps += [g for g in inner if g[1] > g[0]]
            at = max([at, *(hi for _, hi, _ in inner)])
            wrong = inner[-1][2] if inner and inner[-1][0] == inner[-1][1] else ""
        elif not wrong:
            if bad is not None:
                salvage.gaps.append((bad, start, reason))
                bad = None
            salvage.gaps += [(start, end, f"{why}: bytes {lo} to {hi} of the content") for lo, hi, why in inner]
            at = end
        if wrong:
            if bad is None:
                bad, reason = at if end is None else start, wrong
            at = next_start((at if end is None else start) + 1)
    if bad is not None:
        salvage.gaps.append((bad, size, reason))
    salvage.gaps = _outermost(salvage.gaps)


def _outermost(gaps: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """In file order, without gaps that lie in a longer one."""
    out: list[tuple[int, int, str]] = []
    for g in sorted(gaps, key=lambda g: (g[0], -g[1])):
        if not out or g[1] > out[-1][1] or g[:2] == out[-1][:2]:
            out.append(g)
    return out


def _open(path: str):
    return fs.FileSystem.from_uri(path)


def _writer(folder: str, min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # each attempt of a task writes files of its own; only those of attempts that succeed are listed
        out, name, size, n = None, "", 0, 0
        where, base = _open(folder)

        def close() -> Iterator[pa.RecordBatch]:
            if out is not None:
                out.close()
                yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"]), pa.array([size]), pa.array([n])], ["path", "bytes", "records"])

        for b in batches:
            for page, url, html, first in zip(*(b.column(i) for i in range(4))):
                if out is None:
                    name, size, n = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = where.open_output_stream(f"{base}/{name}", compression=None)  # records are compressed already
                page, first = page.as_py(), first.as_py()
                payload = (html.as_py() or "").encode("utf-8", "surrogatepass")
                digest = payload_digest(payload)
                repeat = len(payload) >= min_bytes and first is not None and first != page
                urn = lambda i: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"
                headers = {
                    "WARC-Type": "revisit" if repeat else "response",
                    "WARC-Record-ID": urn(page),
                    "Content-Type": "application/http; msgtype=response",
                    "WARC-Date": "1970-01-01T00:00:00Z",
                    "WARC-Target-URI": url.as_py() or "",
                    "WARC-Payload-Digest": f"sha1:{digest}",
                    "X-Payload-Bytes": len(payload),
                }
                if page is not None:
                    headers["X-Page-ID"] = page
                if repeat:
                    headers |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": urn(first), "X-Refers-To-Page-ID": first}
                block = b"" if repeat else b"\r\n".join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload), b"", payload])
                record = write_record(headers, block)
                out.write(record)
                size, n = size + len(record), n + 1
                if size >= ARCHIVE_BYTES:
                    yield from close()
                    out = None
        yield from close()

    return run


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("gap_reason", pa.string())])
    number = lambda h, k: int(h[k]) if k in h and re.fullmatch(r"-?[0-9]+", h[k]) else None
    for b in batches:
        for path in b.column(0).to_pylist():
            where, name = _open(path)
            salvage, rows = Salvage(), []
            with where.open_input_file(name) as file:
                for r in read_records(file, salvage):
                    h = r.headers
                    if h.get("warc-type") not in ("response", "revisit"):
                        continue
                    own = h["warc-type"] == "response"
                    payload = payload_of(r)
                    size = len(payload) if own else number(h, "x-payload-bytes")
                    digest = payload_digest(payload) if own else h.get("warc-payload-digest", "").removeprefix("sha1:")
                    rows.append((path, r.start, r.end, number(h, "x-page-id"), h.get("warc-target-uri"), h["warc-type"], size, digest, number(h, "x-refers-to-page-id"), None))
                    if len(rows) == 2000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                        rows = []
            rows += [(path, lo, hi, None, None, "gap", None, None, None, why) for lo, hi, why in salvage.gaps]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


def write_archives(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each page to archives in the shared folder; (path, bytes, records) of each archive.

    Of pages with equal payloads of at least min_bytes the one with the smallest
    page_id is a response, the others revisit it; null payloads are empty ones.
    A page whose id is null is always a response.  Of rows that share the
    smallest page_id each is a response.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    digest = F.sha1(F.coalesce("html", F.lit("")).cast("binary"))
    firsts = rows.select("page_id", digest.alias("digest")).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("page_id").alias("n"))
    firsts = materialize(firsts.where("n > 1").select("digest", "first"), "warc-firsts")
    small = firsts.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    met = rows.withColumn("digest", digest).join(F.broadcast(firsts) if small else firsts, "digest", "left")
    folder = new_path(spark, "warc")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(target)
    first = F.when(F.col("page_id").isNotNull(), F.col("first"))
    written = met.select("page_id", "url", "html", first.alias("first")).mapInArrow(_writer(folder, min_bytes), "path string, bytes long, records long")
    return materialize(written, "warc-list")


def read_archives(paths: DataFrame) -> DataFrame:
    """All records and gaps of the archives whose `path`s are given.

    Columns: path, start, end (bytes in the file), page_id, url, record_type
    (response, revisit or gap), payload_bytes, payload_digest, refers_to,
    gap_reason (of gaps only).  A path is one task's work, read in windows.
    """
    spark = paths.sparkSession
    n = max(1, min(paths.count(), 1000 * spark.sparkContext.defaultParallelism))
    schema = 'path string, start long, `end` long, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, gap_reason string'
    return paths.select("path").repartition(n).mapInArrow(_reader, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0, **columns) -> DataFrame:
    """Write the pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to.

    One row per page, repeated rows included; empty and null html are empty
    payloads; other columns are ignored; an empty table gives no rows.  Raises
    if not every record comes back.
    """
    archives = write_archives(pages, min_bytes, **columns)
    records = materialize(read_archives(archives), "warc-records")
    written = archives.agg(F.coalesce(F.sum("records"), F.lit(0))).first()[0]
    gaps = records.where("record_type = 'gap'")
    if records.count() - gaps.count() != written:
        raise RuntimeError(f"{written} records were written; of those not read back: {gaps.select('path', 'start', 'end', 'gap_reason').take(5)}")
    return records.where("record_type <> 'gap'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
