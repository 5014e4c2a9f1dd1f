"""WARC archives of a gzip member a record, and a reader that salvages what is left of damaged ones.

Writing: each partition of pages becomes one archive file through Spark's text
writer, so any file system that Spark reaches will do: a row is a whole gzip
member, and what stands between rows is an empty member, which readers pass
over. A payload of at least ``least`` bytes that others share is stored once,
with the smallest page; the others revisit it. Reading: ``salvage`` walks an
archive member by member. Where a check fails (gzip CRC, version line, header,
length, block digest) it looks for the next place where a member or a version
line begins, in a member's inflated bytes too, and reads on from there; bytes
that belong to no good record are logged as gaps.

Defined cases: a null html is an empty payload; null urls give no target line;
rows without a page id are written but can't be first of equal ones unless all
lack it; repeated rows are records each, all of one type; an empty table gives
no records. Extra columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common as C

LEVEL = 3
#: Bytes after which an archive ends: a reader takes one as a whole.
ARCHIVE_BYTES = 32 << 20
_BEGIN = b"\x1f\x8b\x08"
_VERSION = b"WARC/1."
_EMPTY = zlib.compress(b"", 6, 31)
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: F.Column) -> F.Column:
    """The bare upper-case base32 SHA-1 of a binary column, by SQL functions: 20 bits at a time."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, k, 5), 16, 32), 4, "0") for k in range(1, 41, 5)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def typed(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages with payload, payload_digest, record_type and refers_to.

    Copies of one payload may be a third of all rows: the shared digests are
    broadcast where they are few, else hot ones are joined apart.
    """
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumn("payload_digest", base32_sha1(F.col("payload")))
    known = rows.where(F.length("payload") >= least).groupBy("payload_digest")
    many = known.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies")).where("copies > 1")
    many = C.written(many, "copies")
    hot = [r[0] for r in many.orderBy(F.desc("copies")).limit(512).where("copies > 200").select("payload_digest").collect()]
    joined = C.checked_join(rows, many.select("payload_digest", "first"), "payload_digest", "left", hot=hot)
    again = F.coalesce((F.length("payload") >= least) & (F.col("page_id") != F.col("first")), F.lit(False))
    kind = F.when(again, "revisit").otherwise("response")
    return joined.select("page_id", "url", "payload", "payload_digest", kind.alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


# ------------------------------------------------------------------ records

def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """The bytes of a record; a revisit keeps the payload's length and digest, not the payload."""
    block = b"" if kind == "revisit" else payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z",
        *([f"WARC-Target-URI: {' '.join(url.split())}"] if url is not None else []),
        *([f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_REVISIT}"] if kind == "revisit" else []),
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{_digest(block)}", f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html", f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    return zlib.compress(data, LEVEL, 31)


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


class Marks:
    """Where markers come next in some bytes: each is searched for on from where it was found last, so that all
    searches together go through the bytes once."""

    def __init__(self, data: bytes):
        self.data, self.found = data, {}

    def next(self, mark: bytes, at: int) -> int:
        """The first place from ``at`` on, or the length of the bytes."""
        begin, place = self.found.get(mark, (0, -1))
        if not begin <= at <= place:
            place = self.data.find(mark, at)
            place = len(self.data) if place < 0 else place
            self.found[mark] = (at, place)
        return place


def parse(data: bytes, at: int = 0, marks: Marks | None = None) -> tuple[dict[str, str], bytes, int]:
    """Header, block and end of the record that begins at ``at``; ValueError where a check fails.

    A header is read line by line, each of any length, and given up at the first line that can't be one.
    """
    marks = marks or Marks(data)
    if not data.startswith(_VERSION, at):
        raise ValueError("version")
    fields: dict[str, str] = {}
    line = marks.next(b"\r\n", at)
    if marks.next(_VERSION, at + 1) < line:  # another version before this line's end: no header here
        raise ValueError("header")
    while True:
        k = line + 2
        line = marks.next(b"\r\n", k)
        if line >= len(data):
            raise ValueError("header")
        if line == k:
            break
        colon = data.find(b":", k, line)
        if colon < 0 or data.startswith(_VERSION, k):
            raise ValueError("header")
        fields[data[k:colon].decode("utf-8", "strict").strip().lower()] = data[colon + 1 : line].decode("utf-8", "strict").strip()
    head = line - 2
    size = fields.get("content-length", "")
    end = head + 4 + int(size) if size.isdigit() and len(size) < 19 else len(data) + 1
    if end + 4 > len(data) or data[end : end + 4] != b"\r\n\r\n":
        raise ValueError("length")
    block = data[head + 4 : end]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + _digest(block):
        raise ValueError("digest")
    return fields, block, end + 4


def _body(data: bytes, at: int, marks: Marks) -> int:
    """Where the deflated bytes of the gzip member that begins at ``at`` begin; the length of the bytes if nowhere."""
    flags, k = data[at + 3] if at + 10 < len(data) else 0xE0, at + 10
    if flags & 0xE0:
        return len(data)
    if flags & 4:
        k += 2 + int.from_bytes(data[k : k + 2], "little")
    for bit in (8, 16):  # a name and a comment, each up to a zero
        if flags & bit:
            k = marks.next(b"\0", k) + 1
    return min(len(data), k + (2 if flags & 2 else 0))


def inflated(data: bytes, at: int, marks: Marks | None = None, step: int = 1 << 16) -> tuple[bytes, int, str]:
    """What the gzip member that begins at ``at`` holds, its end, and what is wrong: then as much of it as there is.

    It is fed part by part, as what follows it is copied; where a part fails, halves of it show how far it is good.
    """
    at = _body(data, at, marks or Marks(data))
    inflate, out, size = zlib.decompressobj(-15), [], 32  # most places that only look like a member fail at once
    while not inflate.eof:
        if at >= len(data):
            return b"".join(out), at, "member"
        before, part = inflate.copy(), data[at : at + size]
        try:
            out.append(inflate.decompress(part))
        except zlib.error as e:
            while len(part) > 1 and size > 32:
                half, trial = part[: len(part) // 2], before.copy()
                try:
                    out.append(trial.decompress(half))
                except zlib.error:
                    part = half
                else:
                    before, part, at = trial, part[len(half) :], at + len(half)
            return b"".join(out), at + 1, str(e)[:60]
        at, size = at + len(part), min(step, 4 * size)
    at -= len(inflate.unused_data)
    plain, check = b"".join(out), data[at : at + 8]
    if check != zlib.crc32(plain).to_bytes(4, "little") + (len(plain) & 0xFFFFFFFF).to_bytes(4, "little"):
        return plain, min(len(data), at + 8), "check"
    return plain, at + 8, ""


def _within(plain: bytes, whole: bool) -> tuple[list, str]:
    """The good records of an inflated member, and why others aren't; of a damaged member those with a digest of their own."""
    found, why, k, marks = [], "", 0, Marks(plain)
    while k < len(plain):
        try:
            fields, block, end = parse(plain, k, marks)
            if not whole and "warc-block-digest" not in fields:
                raise ValueError("member")
            found.append((fields, block))
            k = end
        except ValueError as e:
            why = why or str(e)[:60]
            k = marks.next(_VERSION, k + 1)
    return found, why


def salvage(data: bytes):
    """Yield ("record", begin, end, fields, block) and ("gap", begin, end, reason, None) over all of an archive.

    Plain and compressed records may be mixed. Good empty members yield nothing. A member with good and bad records
    yields the good ones and a gap, each with the member's places.
    """
    at, bad, why, marks = 0, -1, "", Marks(data)
    while at < len(data):
        lines = at + 1
        try:
            if data.startswith(_BEGIN, at):
                plain, end, wrong = inflated(data, at, marks)
                found, lost = _within(plain, not wrong)
                if found and bad >= 0:
                    yield "gap", bad, at, why, None
                    bad = -1
                for fields, block in found:
                    yield "record", at, end, fields, block
                if found and lost and not wrong:
                    yield "gap", at, end, lost, None
                if wrong or (lost and not found):
                    lines = end if found else lines  # what stands there unpacked has been read
                    raise ValueError(wrong or lost)
                found = []
            elif data.startswith(_VERSION, at):
                fields, block, end = parse(data, at, marks)
                found = [(fields, block)]
            else:
                raise ValueError("begin")
        except ValueError as e:
            if bad < 0:
                bad, why = at, str(e)[:60] or "member"
            at = min(marks.next(_BEGIN, at + 1), marks.next(_VERSION, lines))
            continue
        if bad >= 0:
            yield "gap", bad, at, why, None
            bad = -1
        for fields, block in found:
            yield "record", at, end, fields, block
        at = end
    if bad >= 0:
        yield "gap", bad, len(data), why, None


# ------------------------------------------------------------------ archives

def _members(batches):
    """Members, and the number of the partition's archive that each goes to."""
    names = ("page_id", "url", "payload", "payload_digest", "record_type", "refers_to")
    number = size = 0
    for batch in batches:
        out, archive = [], []
        for row in zip(*(batch.column(n) for n in names), strict=True):
            out.append(member(record(*(x.as_py() for x in row))))
            if size and size + len(out[-1]) > ARCHIVE_BYTES:
                number, size = number + 1, 0
            size += len(out[-1]) + len(_EMPTY)
            archive.append(number)
            if len(out) == 256:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(archive)], ["value", "archive"])
                out, archive = [], []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary()), pa.array(archive)], ["value", "archive"])


def write_archives(rows: DataFrame, path: str) -> None:
    """Write typed pages as archives below ``path``, of ``ARCHIVE_BYTES`` at most or of a single record."""
    members = rows.mapInArrow(C.tidied(_members), "value binary, archive long").select(F.col("value").cast("string").alias("value"), "archive")
    members.write.option("lineSep", _EMPTY.decode("latin-1")).option("encoding", "ISO-8859-1").partitionBy("archive").text(path)


def _records(batches):
    schema = pa.schema([
        ("path", pa.string()), ("begin", pa.int64()), ("end", pa.int64()), ("gap", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
        ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ])
    number = lambda x: int(x[10:-1]) if x and x[10:-1].lstrip("-").isdigit() else None
    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
            out, size = [], 0
            for kind, begin, end, said, block in salvage(content.as_py()):
                if kind == "gap":
                    out.append((path, begin, end, said, *[None] * 7))
                else:
                    length = said.get("x-payload-length", "")
                    out.append((
                        path, begin, end, None, number(said.get("warc-record-id")), said.get("warc-target-uri"), said.get("warc-type"),
                        len(block) if said.get("warc-type") == "response" else int(length) if length.isdigit() else None,
                        said.get("warc-payload-digest", "").removeprefix("sha1:") or None, number(said.get("warc-refers-to")),
                        block if said.get("warc-type") == "response" else None,
                    ))
                    size += len(block)
                if len(out) == 1024 or size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Records and gaps of all archives below ``path``: path, begin, end; gap (why, else null); the record's fields.

    ``payloads`` false leaves them in the Python workers: they are checked, not returned.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "path string, begin long, end long, gap string, page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    if payloads:
        return files.mapInArrow(C.tidied(_records), schema)

    def without(batches):
        for batch in _records(batches):
            yield batch.drop_columns(["payload"])

    return files.mapInArrow(C.tidied(without), schema.removesuffix(", payload binary"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as archives in shared storage and read back."""
    path = f"{C.shared_dir(spark)}/archives-{C.uuid.uuid4().hex[:8]}"
    pages = C.table(spark, sf_dir, "pages")
    write_archives(typed(pages), path)
    found = C.written(read_archives(spark, path, payloads=False), "records")
    wrote, read, gaps = pages.count(), found.where("gap IS NULL").count(), found.where("gap IS NOT NULL").count()
    if (read, gaps) != (wrote, 0):
        raise ValueError(f"{wrote} pages were written, {read} records and {gaps} gaps read back")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_BASE32 = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (('0x' || substr(h, 5 * (k // 4) + 1, 5))::BIGINT >> (5 * (3 - k % 4)) & 31)::INT + 1, 1)"
OP5_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha1(b) AS h FROM p),
d AS (SELECT page_id, payload_bytes, list_aggregate(list_transform(generate_series(0, 31), lambda k: {_BASE32}), 'string_agg', '') AS payload_digest FROM h),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f"""
