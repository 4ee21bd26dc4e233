"""WARC archives: a writer with revisits, and a reader that salvages what damage leaves.

Archives are plain files of one gzip member a record (or plain records).  Spark
has no sink for binary files, but its text sink writes a string's bytes as they
are and then a separator.  The last byte of a gzip member is the highest byte of
its length, 0 for members of less than 16 MB, so with the separator "\\0" the
rows are members without their last byte.  A longer record is cut into several
members in a row, which the reader joins again.  Plain records end in CR LF.

The reader takes each archive in one go, member by member.  Where a check fails
(gzip's sum, the version line, the length, the end of the record, the block's
digest) it searches for the next place where a whole valid record begins, and
logs what it passed over as a gap with its first and last byte.
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
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortica.llm._store import save, shared_dir, small

MEMBER_BYTES = 1 << 23  # of a member's content
BATCH_BYTES = 1 << 24  # of the payloads that are handed on at once
ROWS_PER_FILE = 20_000
SALTS = 16
MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d")
_LINE = re.compile(rb"WARC/\d+\.\d+\r?\n")
_END = re.compile(rb"\r?\n\r?\n")
#: Headers that every record has.
NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")
#: Headers of a record are no longer than this.
HEADER_BYTES = 1 << 20


def base32(digest: Column) -> Column:
    """Upper-case base32 (without padding) of a hexadecimal text of 40 digits."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for i in range(8):  # 20 bits at a time
        v = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [letters.substr(F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def revisits(pages: DataFrame, least: int = 0) -> DataFrame:
    """Adds payload (bytes), payload_bytes, payload_digest, record_type and refers_to to pages (page_id, url, html).

    Of pages with equal payloads (by SHA-256) of at least ``least`` bytes the one
    of largest page_id is a 'response', the others 'revisit' it.  A null html is
    an empty payload; a null page_id comes before all others, and rows that share
    the largest page_id are all responses.  Only payloads that occur twice are
    looked up: by a counted broadcast, or salted, so that a frequent one spreads.
    """
    body = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), body.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("bigint").alias("payload_bytes"), F.unhex(F.sha2("payload", 256)).alias("same"))
    several = save(rows.where(F.col("payload_bytes") >= least).groupBy("same").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("last")).where("n > 1").select("same", "last"), "payloads")
    table = small(several)
    if table is several:
        rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)))
        table = several.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint"))))
    joined = rows.join(table, ["same", "salt"] if "salt" in rows.columns else "same", "left")
    again = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return joined.select("page_id", "url", "payload", "payload_bytes", base32(F.sha1("payload")).alias("payload_digest"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("last")).alias("refers_to"))


def _uri(page: object, digest: str) -> str:
    return f"urn:page:{'' if page is None else quote(str(page), safe='')}:{digest}"


def record(page: object, url: str | None, payload: bytes, size: int, digest: str, refers_to: object, date: str) -> bytes:
    """A record as it stands in an archive.  A revisit holds the HTTP header alone."""
    again = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size + (b"" if again else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: <{_uri(page, digest)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    head.append(f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}")
    if again:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_uri(refers_to, digest)}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write(rows: DataFrame, folder: str, compress: bool = True, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes the rows of ``revisits`` as archives into a new folder of any file system that Spark knows.

    A partition's rows make a file, or several of ``ROWS_PER_FILE`` records.  The
    files have the names of Spark's text sink and appear when all are whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                data = record(*r, date)
                out.append(b"".join(_member(data[i : i + MEMBER_BYTES]) for i in range(0, len(data), MEMBER_BYTES))[:-1] if compress else data[:-2])
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["value"])

    made = rows.select("page_id", "url", F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"), "payload_bytes", "payload_digest", "refers_to").mapInArrow(run, "value binary")
    end = made.select(F.col("value").cast("string")).write.option("lineSep", "\0" if compress else "\r\n").option("maxRecordsPerFile", ROWS_PER_FILE)
    end.option("compression", "none").text(folder)


class _Bad(Exception):
    pass


class _Short(_Bad):
    """The record goes on behind the bytes at hand."""


def _parse(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and end of the record at a place of data; all checks hold."""
    line = _LINE.match(data, at)
    if not line:
        raise _Short("version line") if len(data) - at < 16 and b"WARC/".startswith(data[at : at + 5]) else _Bad("version line")
    end = _END.search(data, line.end() - 2, at + HEADER_BYTES)
    if not end:
        raise _Short("header") if len(data) - at < HEADER_BYTES else _Bad("header")
    head: dict[str, str] = {}
    for h in data[line.end() : end.start()].split(b"\n"):
        name, colon, value = h.partition(b":")
        if colon:
            head[name.strip().lower().decode("utf-8", "replace")] = value.strip().decode("utf-8", "replace")
        elif h.strip():
            raise _Bad("header")
    size = head.get("content-length", "")
    if not all(head.get(name) for name in NEEDED):
        raise _Bad("header")
    if not (size.isascii() and size.isdigit()):
        raise _Bad("length")
    a, b = end.end(), end.end() + int(size)
    if b > len(data):
        raise _Short("length")
    last = _END.match(data, b)
    if not last:
        raise _Short("end of record") if len(data) - b < 4 and b"\r\n\r\n".startswith(data[b:]) else _Bad("end of record")
    block = data[a:b]
    kind, _, want = head.get("warc-block-digest", "").partition(":")
    if kind.lower() == "sha1":
        got = hashlib.sha1(block).digest()
        if want.upper() != base64.b32encode(got).decode() and want.lower() != got.hex():
            raise _Bad("digest")
    return head, block, last.end()


def _inflated(data: bytes, at: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at a place of data."""
    z = zlib.decompressobj(31)
    out = []
    for a in range(at, len(data), 1 << 16):
        try:
            out.append(z.decompress(data[a : a + (1 << 16)]))
        except zlib.error as e:
            raise _Bad("gzip") from e
        if z.eof:
            return b"".join(out), min(a + (1 << 16), len(data)) - len(z.unused_data)
    raise _Bad("gzip")


def _whole(data: bytes) -> bool:
    try:
        _parse(data, 0)
    except _Bad:
        return False
    return True


def _at(data: bytes, at: int) -> tuple[list[tuple[dict[str, str] | None, bytes | str]], int]:
    """What begins at a place, and where it ends: a plain record, or the records of a member, with (None, failed check) for what is broken between them."""
    if not data.startswith(MAGIC, at):
        head, block, end = _parse(data, at)
        return [(head, block)], end
    text, end = _inflated(data, at)
    found: list[tuple[dict[str, str] | None, bytes | str]] = []
    a = 0
    while a < len(text) or not found:
        try:
            head, block, a = _parse(text, a)
            found.append((head, block))
        except _Bad as e:
            if isinstance(e, _Short) and data.startswith(MAGIC, end):
                more, behind = _inflated(data, end)
                if not _whole(more):  # a record of several members goes on
                    text, a, end = text[a:] + more, 0, behind
                    continue
            b = _version(text, a + 1, len(text))
            if not found and b == len(text):
                raise
            found.append((None, str(e)))
            a = b
    return found, end


def _version(data: bytes, at: int, end: int) -> int:
    """Where a version line may begin (within a line too, where bytes are missing before it), or the end."""
    m = _VERSION.search(data, at, end)
    return m.start() if m else end


def _next(data: bytes, at: int) -> int:
    """Where a member or a version line may begin next."""
    a = data.find(MAGIC, at)
    return _version(data, at, len(data) if a < 0 else a)


def salvage(data: bytes) -> Iterator[tuple[int, int, dict[str, str] | None, bytes | None, str | None]]:
    """(first byte, end, headers, block, None) of each valid record, and (first byte, end, None, None, failed check) of each gap."""
    at, gap, why = 0, -1, ""
    while at < len(data):
        try:
            found, end = _at(data, at)
        except _Bad as e:
            if gap < 0:
                gap, why = at, str(e)
            at = _next(data, at + 1)
            continue
        if gap >= 0:
            yield gap, at, None, None, why
            gap = -1
        for head, block in found:
            yield (at, end, head, block, None) if head is not None else (at, end, None, None, block)
        at = end
    if gap >= 0:
        yield gap, len(data), None, None, why


SCHEMA = "archive string, first_byte bigint, end_byte bigint, failed string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"
_ARROW = pa.schema([("archive", pa.string()), ("first_byte", pa.int64()), ("end_byte", pa.int64()), *((c, pa.string()) for c in ("failed", "record_type", "record_id", "target_uri", "refers_to", "payload_digest")), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def _row(archive: str, first: int, end: int, head: dict[str, str] | None, block: bytes | None, failed: str | None) -> tuple:
    if head is None:
        return (archive, first, end, failed, *[None] * 7)
    kind = head.get("warc-type")
    payload, size = block, len(block)
    if head.get("content-type", "").lower().startswith("application/http"):
        cut = _END.search(block)
        top, payload = (block[: cut.start()], block[cut.end() :]) if cut else (block, b"")
        size = len(payload)
        said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", top)
        if kind == "revisit" and said:  # the payload is elsewhere
            size = int(said[1])
    if kind == "revisit":
        digest, payload = head.get("warc-payload-digest", "").rpartition(":")[2].upper() or None, None
    else:
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    bare = lambda name: head[name].strip("<>") if name in head else None
    return archive, first, end, None, kind, bare("warc-record-id"), bare("warc-target-uri"), bare("warc-refers-to"), digest, size, payload


def read(spark: SparkSession, folder: str) -> DataFrame:
    """A row for each valid record of the archives of a folder, and for each gap that damage left (``failed`` names the check).

    Where several records share a gzip member, first_byte and end_byte are the
    member's.  payload_digest is worked out from the payload; a revisit, which has
    none, gives the digest and the length that it states.  An empty archive gives
    no row.  An archive is whole in one task, so it has to be smaller than 2 GB,
    which is the most that Spark reads as one value.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            for i in range(b.num_rows):
                archive, data = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                for found in salvage(data):
                    held.append(_row(archive, *found))
                    size += 256 + len(held[-1][-1] or b"")
                    if size > BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _ARROW, strict=True)], schema=_ARROW)

    return spark.read.format("binaryFile").load(folder).select("path", "content").mapInArrow(run, SCHEMA)


def page_of(uri: Column, kind: str) -> Column:
    """The page_id in a record's name."""
    part = F.split(uri, ":")[2]
    return F.when(part != "", F.url_decode(part)).cast(kind)


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, archive, first_byte: pages written as archives and read back.

    The archives stay in the shared folder, as the rows are read from them.  See
    ``revisits`` for nulls, ties and repeated rows; of no pages there are no rows.
    """
    spark = pages.sparkSession
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(revisits(pages, least), folder)
    kind = pages.schema["page_id"].dataType.simpleString()
    rows = read(spark, folder).where("failed is null")
    return rows.select(page_of(F.col("record_id"), kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to"), kind).alias("refers_to"), "archive", "first_byte")
