"""Web archives: writing WARC records with revisits, and a salvaging reader.

Records are gzip members of their own, in archives of bounded size. The reader checks
each member (gzip CRC), version line, header lines, length, terminator and payload
digest. Where a check fails, it searches for the next valid member or version line, in the
archive or in what a member holds, goes on there, and logs the bytes between as a
quarantined gap, so one damaged record costs that record only. (What follows damage inside
a compressed member cannot be unpacked; what stands before it is read.)
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BATCH_ROWS, fresh_path, pick, shuffle_parts, slices, tune

#: Payloads of fewer bytes are stored each time.
LEAST = 100
#: Salts that records of one payload are dealt to.
SALTS = 32
#: Bytes of an archive, about; more in it go to the next. A reader holds one at a time.
ARCHIVE_BYTES = 8 << 20
#: Bytes that the reader unpacks at once, and of a record's head at most.
STEP, HEAD_BYTES = 1 << 20, 1 << 20
#: Bytes of records without digests that wait for the check at their member's end.
WAIT_BYTES = 16 << 20

_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
_REVISIT = b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page: int | None) -> bytes:
    return b"<urn:x-page:%s>" % (b"null" if page is None else b"%d" % page)


def page_of(id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", id or "")
    return int(found[1]) if found else None


def record(page: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, not compressed. A revisit has the payload's HTTP head but no payload."""
    block = _HTTP % len(payload) + (b"" if revisit else payload)
    head = [
        b"WARC/1.1", b"WARC-Type: " + (b"revisit" if revisit else b"response"), b"WARC-Record-ID: " + record_id(page),
        b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: sha256:" + digest.encode(),
    ]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url).encode())
    if revisit:
        head += [b"WARC-Profile: " + _REVISIT, b"WARC-Refers-To: " + record_id(refers_to)]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(block)]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member without a time, so equal records have equal bytes."""
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


@dataclass
class Found:
    """A record (reason empty), or a gap or damaged record that was quarantined. begin and
    end are places in the archive; inner_begin and inner_end those in the unpacked member."""

    begin: int
    end: int
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""
    reason: str = ""
    inner_begin: int = 0
    inner_end: int = 0

    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2] if self.block.startswith(b"HTTP/") else self.block

    def payload_length(self) -> int:
        """Bytes of the payload; of a revisit's, which is elsewhere, what its HTTP head states."""
        if self.headers.get("warc-type") == "revisit":
            head, sep, _ = self.block.partition(b"\r\n\r\n")
            if told := re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", head) if sep else None:
                return int(told[1])
        return len(self.payload())


_HEADER = re.compile(rb"[!-9;-~]+:[^\x00-\x08\x0a-\x1f\x7f]*")
_VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_GZIP = b"\x1f\x8b\x08"
_NEXT = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d\r\n")
_LENGTH = re.compile(rb"(?im)^content-length:[ \t]*(\d{1,18})[ \t]*\r$")
_WARC_LINE = re.compile(rb"(?im)^WARC-(?:Type|Record-ID|Date):")


class _Text:
    """Bytes that are there, or that come as they are unpacked. Places count from the start;
    what lies before a place that was left behind is forgotten."""

    def __init__(self, data: bytes | bytearray, pull: Callable[[], bytes] | None = None):
        self.data, self.pull, self.base = data, pull, 0

    def _more(self) -> bool:
        got = self.pull() if self.pull else b""
        if not got:
            self.pull = None
            return False
        self.data += got
        return True

    def has(self, end: int) -> bool:
        while self.base + len(self.data) < end:
            if not self._more():
                return False
        return True

    def find(self, what: bytes | re.Pattern, at: int, most: int | None = None) -> int:
        """The next place of `what`, -1 if there is none (or none in the next `most` bytes)."""
        begin = at
        while True:
            if isinstance(what, bytes):
                found = self.data.find(what, begin - self.base)
            else:
                match = what.search(self.data, begin - self.base)
                found = match.start() if match else -1
            if found >= 0:
                return found + self.base
            if most is not None and self.base + len(self.data) - at > most:
                return -1
            begin = max(begin, self.base + len(self.data) - 16)
            if most is None:
                self.forget(begin)
            if not self._more():
                return -1

    def get(self, begin: int, end: int) -> bytes:
        return bytes(self.data[max(0, begin - self.base) : end - self.base])

    def forget(self, before: int) -> None:
        if self.pull and before - self.base > STEP:
            del self.data[: before - self.base]
            self.base = before


def _record(text: _Text, at: int) -> tuple[Found, int]:
    """The uncompressed record at a place, and the place after it."""
    if not text.has(at + 10) or not _VERSION.match(text.get(at, at + 10)):
        raise ValueError("no version line")
    stop = text.find(b"\r\n\r\n", at, HEAD_BYTES)
    if stop < 0:
        raise ValueError("header lines do not end")
    headers: dict[str, str] = {}
    for line in text.get(at, stop).split(b"\r\n")[1:]:
        name, _, value = line.partition(b":")
        if not _HEADER.fullmatch(line):
            raise ValueError("bad header line")
        headers[name.strip().decode("latin-1").lower()] = value.strip().decode("utf-8", "replace")
    if "warc-type" not in headers or "warc-record-id" not in headers:
        raise ValueError("no type or record id")
    if not headers.get("content-length", "").isdecimal():
        raise ValueError("no content length")
    begin = stop + 4
    end = begin + int(headers["content-length"])
    if not text.has(end + 4) or text.get(end, end + 4) != b"\r\n\r\n":
        raise ValueError("no terminator where the length ends")
    return Found(at, end + 4, headers, text.get(begin, end), inner_begin=at, inner_end=end + 4), end + 4


def _after_damage(text: _Text, at: int) -> int | None:
    """Where a damaged record ends by the length that its head still states, if it ends there."""
    stop = text.find(b"\r\n\r\n", at, HEAD_BYTES)
    told = _LENGTH.search(text.get(at, stop + 2)) if stop >= 0 else None
    if not told:
        return None
    end = stop + 4 + int(told[1])
    fits = text.has(end + 4) and text.get(end, end + 4) == b"\r\n\r\n" and _ends_well(text, end + 4)
    return end + 4 if fits else None


def _ends_well(text: _Text, end: int) -> bool:
    """Whether a record that ends here is followed by another, by the end, or by what is left of
    a damaged head; a record that lies inside another's payload is not."""
    if not text.has(end + 1):
        return True
    text.has(end + 2048)
    after = text.get(end, end + 2048)
    if after.startswith(_GZIP) or _VERSION.match(after):
        return True
    later = _VERSION.search(after)
    return bool(_WARC_LINE.search(after, 0, later.start() if later else len(after)))


def _resume(text: _Text, at: int, gzip: bool) -> int | None:
    """The next place after a damaged one where a record stands, or (gzip) a member may."""
    known = _after_damage(text, at)
    if known is not None:
        return known
    at += 1
    while (at := text.find(_NEXT if gzip else _VERSION, at)) >= 0:
        if gzip and text.get(at, at + 3) == _GZIP:
            return at
        try:
            if _ends_well(text, _record(text, at)[1]):
                return at
        except ValueError:
            pass
        at += 1
    return None


def _until_damage(unpack, piece: bytes) -> bytes:
    """What can be unpacked of a piece before the place where that fails."""
    out = []
    try:
        for k in range(len(piece)):
            out.append(unpack.decompress(piece[k : k + 1]))
    except zlib.error:
        pass
    return b"".join(out)


def _members(data: bytes, at: int) -> Iterator[Found | tuple[int, str]]:
    """The records and gaps of the gzip member at a place, then the place after it and what
    is wrong with the member, if anything. Records before the damage are given."""
    unpack = zlib.decompressobj(31)
    left, fed, wrong = memoryview(data)[at:], 0, ""

    def pull() -> bytes:
        nonlocal left, fed, wrong, unpack
        while not unpack.eof and not wrong:
            piece = unpack.unconsumed_tail
            if not piece:
                piece = left[: max(1, STEP // 16)]
                left, fed = left[len(piece) :], fed + len(piece)
            if not len(piece):
                wrong = "gzip member does not end"
                break
            before = unpack.copy()
            try:
                if got := unpack.decompress(piece, STEP):
                    return got
            except zlib.error as e:
                wrong = f"gzip: {e}"
                return _until_damage(before, piece)
        return b""

    text, place, good = _Text(bytearray(), pull), 0, 0
    found_any = False
    while text.has(place + 1):
        try:
            one, end = _record(text, place)
        except ValueError as e:
            later = _resume(text, place, False)
            if later is None and wrong:
                break
            text.has(1 << 62) if later is None else None
            stop = text.base + len(text.data) if later is None else later
            if found_any or later is not None:
                yield Found(at, at + fed, reason=str(e), inner_begin=place, inner_end=stop)
            else:
                wrong = wrong or str(e)
                break
            place = stop
            continue
        found_any = True
        one.begin, one.end, good = at, at + fed, fed
        yield one
        place = end
        text.forget(place)
    if not wrong and not unpack.eof:
        wrong = "gzip member does not end"
    if not wrong and not place:
        wrong = "empty gzip member"
    if wrong:
        yield (at + max(0, good - STEP // 16) if found_any else at), wrong
    else:
        yield len(data) - len(unpack.unused_data) - len(left), ""


def _damaged(found: Found) -> str | None:
    """Why a well-framed record is not what its digests say; empty if it is, null if it has none
    that can be checked. A revisit's payload digest is that of another record."""
    said = None
    checks = [("block", found.block)]
    if found.headers.get("warc-type") != "revisit":
        checks.append(("payload", found.payload()))
    for what, content in checks:
        name, _, told = found.headers.get(f"warc-{what}-digest", "").partition(":")
        name = name.strip().lower().replace("-", "")
        if name in ("md5", "sha1", "sha256", "sha384", "sha512") and told:
            own = hashlib.new(name, content, usedforsecurity=False)
            if told.strip().lower() != own.hexdigest() and told.strip().upper().rstrip("=") != base64.b32encode(own.digest()).decode().rstrip("="):
                return f"{what} digest differs"
            said = ""
    return said


def salvage(data: bytes) -> Iterator[Found]:
    """All records of an archive, compressed or not or both, and gaps with their reasons.

    A gap goes from where a check failed to the next place where a member or a record stands
    that is followed by another (so a record inside a damaged one's payload is not taken for
    one of the archive's own). Inside a member, too, only the damaged record is lost; of a
    member that breaks off or cannot be unpacked further, the records before are given; those
    without a digest then have a reason, as nothing vouches for them (the last WAIT_BYTES).
    """
    whole = _Text(data)
    at, gap, reason = 0, -1, ""
    while at < len(data):
        broken = ""
        if data[at : at + 3] == _GZIP:
            end, some, waiting = at, False, []
            for one in _members(data, at):
                if isinstance(one, tuple):
                    end, broken = one
                    continue
                if gap >= 0:
                    yield Found(gap, at, reason=reason)
                    gap = -1
                some = True
                said = one.reason or _damaged(one)
                one.reason = said or ""
                if said is None or waiting:  # only the member's own check, at its end, can tell
                    waiting.append((one, said))
                    if sum(len(w.block) for w, _ in waiting) <= WAIT_BYTES:
                        continue
                    one, said = waiting.pop(0)
                yield one
            for one, said in waiting:
                if broken and said is None:
                    one.reason = "member's check failed, no digest"
                yield one
            if broken and some:
                gap, reason = end, broken
        else:
            try:
                one, end = _record(whole, at)
                if gap >= 0:
                    yield Found(gap, at, reason=reason)
                    gap = -1
                one.reason = _damaged(one) or ""
                yield one
            except ValueError as e:
                broken = str(e)
        if broken:
            if gap < 0:
                gap, reason = at, broken
            if data[at : at + 3] == _GZIP:
                later = _NEXT.search(data, at + 1)
                while later and later[0] != _GZIP and not _stands(whole, later.start()):
                    later = _NEXT.search(data, later.start() + 1)
                at = later.start() if later else len(data)
            else:
                later = _resume(whole, at, True)
                at = len(data) if later is None else later
        else:
            at = end
    if gap >= 0:
        yield Found(gap, len(data), reason=reason)


def _stands(text: _Text, at: int) -> bool:
    try:
        return _ends_well(text, _record(text, at)[1])
    except ValueError:
        return False


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, html binary, digest, refers_to): of equal payloads of at least `least`
    bytes, the smallest page_id's row has a null refers_to and the others have its id.

    Null html is empty. Rows that repeat the smallest page_id are responses too; rows with
    a null page_id revisit their group's smallest id, or are responses if it has none.
    """
    rows = pick(pages, "page_id", "url", "html").toDF("page_id", "url", "html")
    rows = rows.withColumn("html", F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    firsts = (
        rows.where(F.octet_length("html") >= least).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
        .select(F.col("digest").alias("same"), "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    )
    # Short payloads match nothing and are dealt by id; equal long ones are dealt to SALTS keys.
    long = F.octet_length("html") >= least
    rows = rows.withColumn("key", F.when(long, F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id"), F.lit(0)))))
    rows = rows.withColumn("deal", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    joined = rows.join(firsts, (rows.key == firsts.same) & (rows.deal == firsts.salt), "left")
    refers = F.when(F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def _filesystem(path: str):
    """pyarrow's file system of a folder that the executors share, and the folder in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write(pages: DataFrame, path: str, least: int = LEAST, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES, level: int = 6) -> DataFrame:
    """Write the archives of all pages under the folder `path`; their manifest (file,
    records, bytes), which Spark commits. A task that runs twice writes files of
    different names and only those of the attempt that counts are in the manifest."""

    def run(batches):
        from pyspark import TaskContext

        task, number, out, size, count, name = TaskContext.get(), 0, None, 0, 0, ""
        fs, folder = _filesystem(path)
        fs.create_dir(f"{folder}/data", recursive=True)
        done = []
        for batch in batches:
            for part in slices(batch, "html"):
                for page, url, html, digest, refers in zip(*(c.to_pylist() for c in part.columns)):
                    if out is None:
                        name = f"data/{task.partitionId():06d}-{task.taskAttemptId()}-{number:05d}.warc.gz"
                        out, size, count, number = fs.open_output_stream(f"{folder}/{name}", compression=None), 0, 0, number + 1
                    data = member(record(page, url, html, digest, refers, refers is not None, date), level)
                    out.write(data)
                    size, count = size + len(data), count + 1
                    if size >= archive_bytes:
                        out.close()
                        done.append((name, count, size))
                        out = None
        if out is not None:
            out.close()
            done.append((name, count, size))
        if done:
            yield pa.record_batch([pa.array(c) for c in zip(*done)], ["file", "records", "bytes"])

    tune(pages.sparkSession)
    rows = decided(pages, least).mapInArrow(run, "file string, records long, bytes long")
    rows.write.parquet(f"{path}/manifest")
    return pages.sparkSession.read.schema("file string, records long, bytes long").parquet(f"{path}/manifest")


RECORD = (
    "file string, begin long, end long, inner_begin long, inner_end long, reason string, warc_type string, page_id long, target_uri string,"
    " refers_to long, payload_bytes long, payload_digest string"
)


def _rows(archives: Iterator[tuple[str, bytes]], payloads: bool, log: Callable[[str, list[dict]], None] | None = None) -> Iterator[pa.RecordBatch]:
    """RECORD of the records and gaps of (name, content) archives, in batches of bounded size.
    log: takes an archive's name and what was quarantined of it, if anything."""
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    fields = [c.split() for c in (RECORD + (", payload binary" if payloads else "")).split(",")]
    rows: list[tuple] = []
    held = 0

    def batch() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [n for n, _ in fields])

    for file, data in archives:
        lost = []
        for f in salvage(data):
            if f.reason:
                lost.append({"begin": f.begin, "end": f.end, "inner_begin": f.inner_begin, "inner_end": f.inner_end, "reason": f.reason, "record": f.headers.get("warc-record-id")})
            h = f.headers
            told = h.get("warc-payload-digest", "")
            row = (
                file, f.begin, f.end, f.inner_begin, f.inner_end, f.reason or None, h.get("warc-type"), page_of(h.get("warc-record-id")),
                h.get("warc-target-uri"), page_of(h.get("warc-refers-to")), f.payload_length() if h else None, told.removeprefix("sha256:").lower() or None,
            )
            rows.append((*row, f.payload()) if payloads else row)
            held += len(f.block) if payloads else 1
            if len(rows) >= BATCH_ROWS or held > 8 << 20:
                yield batch()
                rows, held = [], 0
        if log and lost:
            log(file, lost)
    if rows:
        yield batch()


def read(spark: SparkSession, archives: str | list[str], payloads: bool = False) -> DataFrame:
    """RECORD (and with payloads, `payload binary`) for each record and quarantined gap of
    the archives of a folder or of the named files, read by Spark's own file source from any
    store. Gaps and damaged records have a reason; no archive gives no row."""
    tune(spark)
    kind = RECORD + (", payload binary" if payloads else "")
    if not archives:
        return spark.createDataFrame([], kind)

    def run(batches):
        for batch in batches:
            yield from _rows(((batch.column(0)[k].as_py(), batch.column(1)[k].as_py()) for k in range(batch.num_rows)), payloads)

    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(archives)
    return found.select("path", "content").mapInArrow(run, kind)


def read_written(manifest: DataFrame, path: str, payloads: bool = False) -> DataFrame:
    """As read(), for the archives that a manifest of write() names: executors open them, so no
    list of them comes to the driver, and files of attempts that do not count are not read.
    What is quarantined is logged too, a file of JSON lines for each damaged archive in the
    folder `quarantine` (a task that runs again writes the same file)."""
    tune(manifest.sparkSession)

    def run(batches):
        fs, folder = _filesystem(path)

        def content(name: str) -> bytes:
            with fs.open_input_stream(f"{folder}/{name}", compression=None) as f:
                return f.read()

        def log(name: str, lost: list[dict]) -> None:
            fs.create_dir(f"{folder}/quarantine", recursive=True)
            with fs.open_output_stream(f"{folder}/quarantine/{name.rpartition('/')[2]}.jsonl", compression=None) as f:
                f.write("".join(json.dumps({"file": name, **one}) + "\n" for one in lost).encode())

        for batch in batches:
            yield from _rows(((name, content(name)) for name in batch.column(0).to_pylist()), payloads, log)

    files = manifest.select("file").repartition(shuffle_parts(manifest.sparkSession), "file")
    return files.mapInArrow(run, RECORD + (", payload binary" if payloads else ""))


def round_trip(pages: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of each page, read
    back from archives written to the shared folder, where damage is logged beside them."""
    path = fresh_path(pages.sparkSession, "warc")
    good = read_written(write(pages, path), path).where("reason IS NULL")
    return good.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to")
