"""WARC archives: writing pages as records with revisits for equal payloads, and a reader that salvages damaged files.

Archives are gzip files of one member per record, cut at a size so that no task holds more than one record and one
member. Tasks write under names of their own and report them; the written list of names, committed by Spark, says which
archives count, so a repeated or lost task leaves nothing that is read.
"""

from __future__ import annotations

import base64
import copy
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filesystem, map_batches, materialise, text_of, work_path

LEAST_BYTES, ARCHIVE_BYTES, CHUNK = 1000, 16 << 20, 1 << 20
PIECE, HEADER, HOLD = 1 << 14, 1 << 20, 8 << 20  # compressed bytes inflated at a time; longest header of a record; longest block held before it has passed the checks
VERSION, GZIP, END = b"WARC/1.", b"\x1f\x8b\x08", b"\r\n\r\n"
ID = "urn:page:"
DATE = "1970-01-01T00:00:00Z"  # records carry no clock, so a repeated task writes the same bytes


# ---- records


def payload_digest(payload: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(kind: str, page_id: int | None, url: str | None, digest: str, length: int, payload: bytes = b"", refers_to: int | None = None) -> bytes:
    """One record: a response holds the payload, a revisit only its HTTP head, whose Content-Length still tells the payload's size."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url:
        lines.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: {digest}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{ID}{refers_to}>"]
    lines.append(f"Content-Length: {len(head) + len(payload)}")
    return "\r\n".join(lines).encode() + END + head + payload + END


def member(raw: bytes, level: int = 3) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


# ---- salvage reader

ReadAt = Callable[[int, int], bytes]


class Damaged(Exception):
    pass


def _headers(raw: bytes) -> dict[str, str]:
    lines = raw.split(b"\r\n")
    if not lines[0].startswith(VERSION):
        raise Damaged("no version line")
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def parse(headers: dict[str, str], block: bytes) -> None:
    """Damaged if the block isn't what the headers tell of its payload."""
    if headers.get("warc-type") == "response" and (told := headers.get("warc-payload-digest")):
        if payload_digest(block.partition(END)[2]) != told:
            raise Damaged("payload digest")


def check_long(pieces: Iterator[bytes], headers: dict[str, str], length: int) -> None:
    """Damaged if pieces, a block of this length and what follows, don't end as told or fail the payload digest; holds one piece at a time."""
    digest, before, inside, left = hashlib.sha1(), b"", False, length
    after = b""
    for piece in pieces:
        block, after = piece[:left], after + piece[left:]
        left -= len(block)
        if inside:
            digest.update(block)
        else:
            before += block
            if (cut := before.find(END)) >= 0:
                inside = True
                digest.update(before[cut + len(END) :])
            before = before[1 - len(END) :]
        if len(after) >= len(END):
            break
    if left or not after.startswith(END):
        raise Damaged("block not ended")
    if headers.get("warc-type") == "response" and (told := headers.get("warc-payload-digest")):
        if "sha1:" + base64.b32encode(digest.digest()).decode() != told:
            raise Damaged("payload digest")


class Member:
    """The bytes of the gzip member at `at`, inflated as they are asked for; those before `base` are forgotten."""

    def __init__(self, read_at: ReadAt, at: int, size: int):
        self._read, self._pos, self._size = read_at, at, size
        self._packer, self._raw = zlib.decompressobj(31), b""
        self.held, self.base, self.end, self.error = bytearray(), 0, at, ""

    def more(self) -> bool:
        """Inflate some more; False once the member has ended, soundly or with an error."""
        if self.error or self._packer.eof:
            return False
        if not self._raw:
            self._raw = self._read(self._pos, min(CHUNK, self._size - self._pos)) if self._pos < self._size else b""
            self._pos += len(self._raw)
            if not self._raw:
                self.error = "member not ended"
                return False
        piece, self._raw = self._raw[:PIECE], self._raw[PIECE:]
        try:
            self.held += self._packer.decompress(piece)
        except zlib.error as e:
            self.error = f"gzip: {str(e)[:60]}"
            return False
        if self._packer.eof:
            self.end = self._pos - len(self._raw) - len(self._packer.unused_data)
        return True

    def drop(self, to: int) -> None:
        del self.held[: to - self.base]
        self.base = to

    def pieces(self, at: int) -> Iterator[bytes]:
        """The inflated bytes from `at` on, which must not be forgotten yet, read by a copy that holds none of them; the member stays where it is."""
        yield bytes(self.held[at - self.base :])
        ahead = copy.copy(self)
        if not self._packer.eof and not self.error:
            ahead._packer = self._packer.copy()
        ahead.held = bytearray()
        while ahead.more():
            yield bytes(ahead.held)
            ahead.held.clear()


def _record(source: Member, at: int) -> tuple[dict[str, str], bytes, int]:
    """The record at `at` of the inflated bytes: headers, block, end. Damaged if its frame or payload digest doesn't hold."""

    def until(n: int) -> bool:
        while source.base + len(source.held) < n and source.more():
            pass
        return source.base + len(source.held) >= n

    until(at + len(VERSION))
    here = at - source.base
    if not source.held.startswith(VERSION, here):
        raise Damaged("no version line")
    while (head := source.held.find(END, here, here + HEADER)) < 0:
        if len(source.held) - here >= HEADER or not source.more():
            raise Damaged("header not ended")
    headers = _headers(bytes(source.held[here:head]))
    told = headers.get("content-length", "")
    if not told.isdigit():
        raise Damaged("no content length")
    start = source.base + head + len(END)
    end = start + int(told) + len(END)
    if int(told) > HOLD:
        check_long(source.pieces(start), headers, int(told))  # a false length must not make the reader hold what follows
    if not until(end) or source.held[end - len(END) - source.base : end - source.base] != END:
        raise Damaged("block not ended")
    block = bytes(source.held[start - source.base : end - len(END) - source.base])
    parse(headers, block)
    return headers, block, end


def _members_records(source: Member) -> Iterator[tuple[str, int, int, object]]:
    """Records and gaps of the inflated bytes. After a failed check the next version line is searched for; what follows the last sound record of a broken member is left to the caller."""
    at, gap, reason = 0, -1, ""
    while True:
        while source.base + len(source.held) <= at and source.more():
            pass
        if source.base + len(source.held) <= at:
            break
        try:
            headers, block, end = _record(source, at)
        except Damaged as e:
            if gap < 0:
                gap, reason = at, str(e)
            at += 1
            while (found := source.held.find(VERSION, at - source.base)) < 0:
                # all but a version line's beginning is done with
                at = max(at, source.base + len(source.held) - len(VERSION) + 1)
                source.drop(at)
                if not source.more():
                    break
            at = source.base + (found if found >= 0 else len(source.held))
            continue
        if gap >= 0:
            yield "gap", gap, at, reason
            gap = -1
        yield "record", at, end, (headers, block)
        at = end
        source.drop(at)
    if gap >= 0 and not source.error:
        yield "gap", gap, at, reason


def _plain(read_at: ReadAt, at: int, size: int) -> tuple[dict[str, str], bytes, int]:
    """The uncompressed record at `at`, read as far as its own length says: headers, block, end."""
    raw = read_at(at, min(HEADER, size - at))
    head_end = raw.find(END)
    if head_end < 0:
        raise Damaged("header not ended")
    headers = _headers(raw[:head_end])
    told = headers.get("content-length", "")
    if not told.isdigit():
        raise Damaged("no content length")
    end = head_end + len(END) + int(told) + len(END)
    if at + end > size:
        raise Damaged("record not ended")
    if int(told) > HOLD:
        start = at + head_end + len(END)
        check_long((read_at(p, min(CHUNK, at + end - p)) for p in range(start, at + end, CHUNK)), headers, int(told))
    while len(raw) < end:
        raw += read_at(at + len(raw), end - len(raw))
    if raw[end - len(END) : end] != END:
        raise Damaged("block not ended")
    block = raw[head_end + len(END) : end - len(END)]
    parse(headers, block)
    return headers, block, at + end


def _next_start(read_at: ReadAt, at: int, size: int) -> int:
    """The next place at or after `at` where a member or a version line may begin; size if there is none."""
    while at < size:
        raw = read_at(at, min(CHUNK, size - at))
        found = [p for p in (raw.find(GZIP), raw.find(VERSION)) if p >= 0]
        if found:
            return at + min(found)
        if at + len(raw) >= size:
            break
        at += max(1, len(raw) - len(VERSION) + 1)
    return size


def salvage(read_at: ReadAt, size: int) -> Iterator[tuple[str, int, int, object, tuple[int, int] | None]]:
    """('record', start, end, (headers, block), inner) for each sound record and ('gap', start, end, reason, inner) for each quarantined range.

    start and end are bytes of the file; inner is the range in the inflated bytes of a member, null for plain records and
    for gaps between members. Records of one member share its range. After a failed check the search goes on: within a
    member from the next version line of its inflated bytes, else from the next byte at which a gzip member or a version
    line begins. A candidate counts only if it passes the checks itself, so gaps end exactly where sound records begin
    again. A block longer than HOLD is read once without holding it and taken only when it has passed, so a false length
    costs time and no memory; a header longer than HEADER is quarantined. Of a member that breaks off or fails its checksum the sound records before that are kept, and its gap tells
    with inner where the rest begins.
    """
    at, gap, reason = 0, -1, ""
    while at < size:
        first = read_at(at, min(len(VERSION), size - at))
        found: list[tuple[str, int, int, object]] = []
        start, end, last = at, at, 0
        try:
            if first.startswith(GZIP):
                source = Member(read_at, at, size)
                for one in _members_records(source):
                    # one is held back, so that the last of a sound member can tell the member's end
                    if gap >= 0:
                        yield "gap", gap, at, reason, None
                        gap = -1
                    for kind, a, b, what in found:
                        yield kind, start, source.end if source.end > start else min(size, source._pos), what, (a, b)
                    found = [one]
                    last = one[2]
                if source.error:
                    raise Damaged(source.error)
                end = source.end
            elif first == VERSION:
                headers, block, end = _plain(read_at, at, size)
                found = [("record", 0, 0, (headers, block))]
            else:
                raise Damaged("neither member nor version line")
        except Damaged as e:
            after = _next_start(read_at, at + 1, size)
            for kind, a, b, what in found:
                yield kind, start, after, what, (a, b)
            if found:
                yield "gap", at, after, str(e), (last, last)
            elif gap < 0:
                gap, reason = at, str(e)
            at = after
            continue
        if gap >= 0:
            yield "gap", gap, at, reason, None
            gap = -1
        for kind, a, b, what in found:
            yield kind, start, end, what, (a, b) if b else None
        at = end
    if gap >= 0:
        yield "gap", gap, size, reason, None


# ---- Spark


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write a record per row into archives under folder; returns the written list: path, bytes, records.

    Of rows with equal payloads of LEAST_BYTES or more, that with the largest id is a response, the others revisit it;
    rows that tie on it are all responses, as are rows without an id that meet no id in their group. Null bodies are
    empty payloads. Equal means equal SHA-256.
    """
    body = F.encode(text_of(body_col), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("body"))
    large = F.octet_length("body") >= LEAST_BYTES
    # small payloads have no group; a key of their own spreads them over the tasks of the join
    rows = rows.withColumn("sha", F.when(large, F.sha2("body", 256)).otherwise(F.concat(F.lit("-"), F.xxhash64("id", "url").cast("string"))))
    groups = rows.filter(large).groupBy("sha").agg(F.max("id").alias("owner"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    groups = materialise(groups, "payloads")  # so that the planner may split the rows of a hot payload
    rows = rows.join(groups, "sha", "left").withColumn("owner", F.when(~F.col("id").eqNullSafe(F.col("owner")), F.col("owner"))).drop("sha")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = filesystem(folder)
        store.create_dir(top, recursive=True)
        out, path, n, done = None, "", 0, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                page_id, url, payload, owner = row
                if out is None:
                    path, n = f"{top}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(path, compression=None)
                kind = "response" if owner is None else "revisit"
                digest = payload_digest(payload)
                out.write(member(record(kind, page_id, url, digest, len(payload), payload if owner is None else b"", owner)))
                n += 1
                if out.tell() >= archive_bytes:
                    done.append((path, out.tell(), n))
                    out.close()
                    out = None
        if out is not None:
            done.append((path, out.tell(), n))
            out.close()
        names, sizes, counts = zip(*done, strict=True) if done else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())], ["path", "bytes", "records"])

    listed = map_batches(rows.select("id", "url", "body", "owner"), write, "path string, bytes long, records long")
    prefix = folder.split(filesystem(folder)[1])[0] if "://" in folder or folder.startswith("file:") else ""
    return materialise(listed.withColumn("path", F.concat(F.lit(prefix), "path")), "archives")


READ = "path string, kind string, start long, end long, inner_start long, inner_end long, reason string, record_type string, page_id long, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(listed: DataFrame, payloads: bool = False) -> DataFrame:
    """Salvage every archive in listed (column path): a row per record, and a row of kind gap per quarantined byte range.

    Only response and revisit records are rows; a record without payload digest has it computed. With payloads, the
    payload of responses is returned too. An empty archive has no rows.
    """
    spark = listed.sparkSession
    names = [x.split()[0] for x in READ.split(", ")]
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def number(value: str | None) -> int | None:
        bare = (value or "").strip("<>").removeprefix(ID)
        return int(bare) if bare.lstrip("-").isdigit() else None

    def row(path: str, what: tuple) -> tuple | None:
        kind, start, end, found, inner = what
        where = (path, kind, start, end, *(inner or (None, None)))
        if kind == "gap":
            return (*where, found, *[None] * 6)
        headers, block = found
        if (record_type := headers.get("warc-type")) not in ("response", "revisit"):
            return None
        head, _, payload = block.partition(END)
        size, told = len(payload), headers.get("warc-payload-digest", "")
        if record_type == "revisit":
            sizes = [v for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")) if k.lower() == b"content-length"]
            size = int(sizes[0]) if sizes else None
        elif not told:
            told = payload_digest(payload)
        digest = base64.b32decode(told[5:]).hex() if told.startswith("sha1:") and len(told) == 37 else told.removeprefix("sha1:").lower()
        refers = number(headers.get("warc-refers-to")) if record_type == "revisit" else None
        return (*where, None, record_type, number(headers.get("warc-record-id")), refers, size, digest, payload if payloads and record_type == "response" else None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = filesystem(path)
                with store.open_input_file(at) as f:
                    rows, held = [], 0
                    for what in salvage(lambda pos, n, f=f: f.read_at(n, pos), f.size()):
                        if one := row(path, what):
                            rows.append(one)
                            held += len(one[-1] or b"") + 200
                        if held > CHUNK:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return listed.select("path").repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))).mapInArrow(read, READ)


def roundtrip(pages: DataFrame) -> DataFrame:
    """Write pages into archives in the shared folder and read them back: records and gaps."""
    return read_archives(write_archives(pages, work_path(pages.sparkSession, "warc")))
