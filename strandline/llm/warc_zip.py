"""ZIP-packaged WARC archives: writing, and reading by ranges without extraction.

An archive is a ZIP file whose members are stored, not compressed: any number of ``.warc.gz`` (every record a gzip member of its own) or
``.warc`` files, and any number of indexes of their records, ``.cdx`` (whose first line names its fields) or ``.cdxj``, plain or
``.gz``.  The reader parses the end record, the ZIP64 end record and its locator, the central directory with its ZIP64 fields and
the members' local headers; it reads the indexes and then single records by their byte ranges.  Where these cover a member
without a gap, its checksum is compared too.  The writer makes one member of each kind.

Archives lie as files in a folder that driver and executors share.  Where that isn't a mounted folder, they are rows of a table
(path, content) in it, and ranges are cut from the content.  An archive is closed when it reaches ``ARCHIVE_BYTES``, so neither form needs
more memory than that.  A retried task writes under other names; only archives that a finished task has listed are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import os
import re
import struct
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, cut, fresh_path, qualified, table

ARCHIVE_BYTES = 32 << 20
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LEAST_REVISIT = 1000
# Letters of a CDX file's first line that are read here.
CDX_FIELDS = {"V": "offset", "S": "length", "g": "filename"}
# Signatures and the ZIP64 extra field of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR64, EXTRA64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50, 1
MAX16, MAX32 = 0xFFFF, 0xFFFFFFFF


class Ranges:
    """A file or bytes, read by ranges."""

    def __init__(self, path: str | None, content: bytes | None = None):
        self.content, self.file = content, None if content is not None else open(local_path(path), "rb")  # noqa: SIM115
        self.size = len(content) if content is not None else os.fstat(self.file.fileno()).st_size

    def read(self, start: int, n: int) -> bytes:
        if start < 0 or n < 0 or start + n > self.size:
            raise ValueError(f"range {start}+{n} is outside of {self.size} bytes")
        if self.content is not None:
            return bytes(self.content[start : start + n])
        self.file.seek(start)
        return self.file.read(n)

    def close(self) -> None:
        if self.file:
            self.file.close()


@dataclass
class Member:
    name: str
    method: int
    crc: int
    packed: int
    size: int
    header: int


def local_path(path: str) -> str:
    return urllib.parse.unquote(path.removeprefix("file://").removeprefix("file:")) if path.startswith("file:") else path


def is_mounted(path: str) -> bool:
    return path.startswith("file:")


def directory(src: Ranges) -> dict[str, Member]:
    """The members by name, from the central directory; the last of equal names counts."""
    tail_at = max(0, src.size - 22 - MAX16)
    tail = src.read(tail_at, src.size - tail_at)
    at = len(tail) - 22
    while at >= 0 and not (tail[at : at + 4] == struct.pack("<I", END) and struct.unpack_from("<H", tail, at + 20)[0] == len(tail) - at - 22):
        at -= 1
    if at < 0:
        raise ValueError("no end of central directory: not a ZIP file, or a truncated one")
    _, disk, start_disk, _, count, size, start, _ = struct.unpack_from("<IHHHHIIH", tail, at)
    end_at = tail_at + at
    if MAX16 in (disk, start_disk, count) or MAX32 in (size, start):
        sign, _, end64, _ = struct.unpack("<IIQI", src.read(end_at - 20, 20))
        if sign != LOCATOR64:
            raise ValueError("no ZIP64 locator")
        sign, _, _, _, disk, start_disk, _, count, size, start = struct.unpack("<IQHHIIQQQQ", src.read(end64, 56))
        if sign != END64:
            raise ValueError("no ZIP64 end of central directory")
    if disk or start_disk:
        raise ValueError("archives of several disks are not supported")
    raw, at, out = src.read(start, size), 0, {}
    for _ in range(count):
        sign, _, _, flags, method, _, _, crc, packed, full, n, extra_n, note_n, _, _, _, header = struct.unpack_from("<IHHHHHHIIIHHHHHII", raw, at)
        if sign != CENTRAL:
            raise ValueError("broken central directory")
        name = raw[at + 46 : at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        extra, at = raw[at + 46 + n : at + 46 + n + extra_n], at + 46 + n + extra_n + note_n
        k = 0
        while k + 4 <= len(extra):
            tag, m = struct.unpack_from("<HH", extra, k)
            if tag == EXTRA64:  # holds only the values that don't fit, in this order
                values = iter(struct.unpack_from(f"<{m // 8}Q", extra, k + 4))
                full = next(values) if full == MAX32 else full
                packed = next(values) if packed == MAX32 else packed
                header = next(values) if header == MAX32 else header
            k += 4 + m
        out[name] = Member(name, method, crc, packed, full, header)
    return out


def stored_at(src: Ranges, m: Member) -> int:
    """Where a stored member's bytes begin: behind its local header, whose fields have sizes of their own."""
    if m.method != 0:
        raise ValueError(f"{m.name} is compressed: its records have no byte ranges")
    head = src.read(m.header, 30)
    if struct.unpack_from("<I", head)[0] != LOCAL:
        raise ValueError(f"{m.name} has no local header")
    n, extra = struct.unpack_from("<HH", head, 26)
    return m.header + 30 + n + extra


def stored_bytes(src: Ranges, m: Member) -> bytes:
    raw = src.read(stored_at(src, m), m.size)
    if zlib.crc32(raw) != m.crc:
        raise ValueError(f"{m.name} is damaged")
    return zlib.decompress(raw, 31) if m.name.endswith(".gz") else raw


def read_index(src: Ranges, members: dict[str, Member]) -> list[tuple[Member, int, int]]:
    """(member, start, length) of each record that any index names, by member and start; one that several name stands once."""
    data = {n: m for n, m in members.items() if n.endswith((".warc", ".warc.gz"))}
    base = {n.rsplit("/", 1)[-1]: n for n in data}
    found = set()
    indexes = [m for n, m in members.items() if n.removesuffix(".gz").endswith((".cdx", ".cdxj"))]
    if data and not indexes:
        raise ValueError("no index of the records")
    for m in indexes:
        fields: list[str] | None = None
        for line in stored_bytes(src, m).decode().split("\n"):
            if not line.strip() or line.startswith("!"):
                continue
            if line.lstrip().startswith("CDX "):
                fields = line.split()[1:]
                continue
            if fields is None:  # CDXJ: key, time and a JSON object
                entry = json.loads(line[line.index("{") :])
            else:
                entry = {CDX_FIELDS.get(f, f): x for f, x in zip(fields, line.split(), strict=True)}
            name = entry.get("filename") or (next(iter(data)) if len(data) == 1 else None)
            name = name if name in data else base.get((name or "").rsplit("/", 1)[-1])
            if name is None:
                raise ValueError(f"{m.name} names a member that isn't there")
            found.add((name, int(entry["offset"]), int(entry["length"])))
    return [(data[n], start, size) for n, start, size in sorted(found)]


def write_zip(members: list[tuple[str, list[bytes]]], zip64: bool = False) -> list[bytes]:
    """Chunks of a ZIP file of stored members; with ZIP64 fields and records where sizes need them, or everywhere."""
    out, central, at = [], [], 0
    for name, chunks in members:
        raw, size, crc = name.encode(), sum(map(len, chunks)), 0
        for c in chunks:
            crc = zlib.crc32(c, crc)
        big = zip64 or size >= MAX32 or at >= MAX32
        s, extra = (MAX32, struct.pack("<HHQQ", EXTRA64, 16, size, size)) if big else (size, b"")
        head = struct.pack("<IHHHHHIIIHH", LOCAL, 45 if big else 20, 0x800, 0, 0, 33, crc, s, s, len(raw), len(extra)) + raw + extra
        extra = struct.pack("<HHQQQ", EXTRA64, 24, size, size, at) if big else b""
        central.append(struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45 if big else 20, 0x800, 0, 0, 33, crc, s, s, len(raw), len(extra), 0, 0, 0, 0, MAX32 if big else at) + raw + extra)
        out += [head, *chunks]
        at += len(head) + size
    n = sum(map(len, central))
    out += central
    if zip64 or at >= MAX32 or len(members) >= MAX16:
        out.append(struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, len(members), len(members), n, at))
        out.append(struct.pack("<IIQI", LOCATOR64, 0, at + n, 1))
        out.append(struct.pack("<IHHHHIIH", END, MAX16, MAX16, MAX16, MAX16, MAX32, MAX32, 0))
    else:
        out.append(struct.pack("<IHHHHIIH", END, 0, 0, len(members), len(members), n, at, 0))
    return out


def record_bytes(kind: str, record_id: str, url: str | None, payload: bytes | None, payload_bytes: int, digest: str, refers_to: str | None) -> bytes:
    """A WARC record as a gzip member.  A revisit has the HTTP head of its response, without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:  # one that no header line can hold is quoted, and says so
        plain = url == url.strip() and url.isprintable()
        head.append(("WARC-Target-URI", url) if plain else ("X-Quoted-Target-URI", urllib.parse.quote(url)))
    if kind == "revisit":
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", refers_to)]
    head.append(("Content-Length", str(len(block))))
    raw = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw.encode() + block + b"\r\n\r\n") + z.flush()


def parse_record(raw: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers and HTTP headers, names in lower case, and the payload of a record, a gzip member or plain."""
    data = zlib.decompress(raw, 31) if raw[:2] == b"\x1f\x8b" else raw
    head, sep, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not sep or not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    warc = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    n = int(warc["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record's length is wrong")
    http_head, _, payload = rest[:n].partition(b"\r\n\r\n")
    return warc, {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http_head.decode().split("\r\n")[1:])}, payload


def record_name(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(name: str | None) -> int | None:
    """The number in a record's name; null in the names that other writers give."""
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", name or "")
    return int(found[1]) if found else None


def digest_hex(header: str | None) -> str | None:
    """A SHA-1 digest as lower-case hexadecimals, of a header that has it so or in base 32; null of none and of other kinds."""
    kind, _, value = (header or "").partition(":")
    if kind.lower() != "sha1":
        return None
    return value.lower() if len(value) == 40 else base64.b32decode(value.upper()).hex()


def plan_records(pages: DataFrame) -> DataFrame:
    """``pages`` with payload_bytes, payload_digest, record_type and refers_to.

    The largest page_id of each payload is found by a maximum combined before the shuffle.  Payloads below the limit join under keys
    of their own, which match nothing and spread evenly; so do very common ones, which a broadcast serves.
    """
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", "html", F.octet_length(html).cast("long").alias("payload_bytes"), F.sha1(html.cast("binary")).alias("payload_digest"))
    large = F.col("payload_bytes") >= LEAST_REVISIT
    # Equal digests of two kinds and equal sizes stand for equal payloads.
    name = F.concat_ws("-", "payload_digest", F.xxhash64(html).cast("string"), F.col("payload_bytes").cast("string"))
    first = cut(rows.where(large).groupBy(name.alias("key")).agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    lone = F.concat(F.lit("-"), F.xxhash64("page_id", "payload_digest").cast("string"))
    keyed = rows.withColumn("key", F.when(large, name).otherwise(lone))
    if first.count() <= BROADCAST_ROWS:
        out = keyed.join(F.broadcast(first), "key", "left")
    else:
        # Payloads with more copies than a partition has rows, no more than there are partitions, go by a broadcast; the others can't be hot.
        share = max(2, -(-pages.count() // int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
        hot = first.where(F.col("n") > share).select("key", F.struct("first").alias("hot"))
        keyed = keyed.join(F.broadcast(hot), "key", "left").withColumn("key", F.when(F.col("hot").isNotNull(), lone).otherwise(F.col("key")))
        out = keyed.join(first, "key", "left").withColumn("first", F.when(F.col("hot").isNotNull(), F.col("hot.first")).otherwise(F.col("first")))
    again = F.col("first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("first"), F.lit(False))
    return out.select("page_id", "url", "html", "payload_bytes", "payload_digest", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes rows as ``plan_records`` gives them; the archives as (path, content), content null where the folder is mounted."""
    folder = qualified(records.sparkSession, folder)
    mounted = is_mounted(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data: list[bytes] = []
        index: list[str] = []
        at = 0

        def close() -> pa.RecordBatch:
            nonlocal at
            chunks = write_zip([(DATA, data), (INDEX, ["".join(index).encode()])], zip64=True)
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            if mounted:
                os.makedirs(local_path(folder), exist_ok=True)
                with open(local_path(path) + ".part", "wb") as f:
                    f.writelines(chunks)
                os.replace(local_path(path) + ".part", local_path(path))
            content = None if mounted else b"".join(chunks)
            data.clear()
            index.clear()
            at = 0
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.binary())], ["path", "content"])

        for batch in batches:
            for k in range(batch.num_rows):
                page, url, html, n, digest, kind, first = (batch.column(c)[k].as_py() for c in ("page_id", "url", "html", "payload_bytes", "payload_digest", "record_type", "refers_to"))
                raw = record_bytes(kind, record_name(page), url, (html or "").encode(), n, digest, record_name(first))
                data.append(raw)
                index.append(f"{urllib.parse.quote(url or '-')} 19700101000000 " + json.dumps({"url": url, "digest": f"sha1:{digest}", "mime": "warc/revisit" if kind == "revisit" else "text/html", "offset": at, "length": len(raw), "filename": DATA.rsplit("/", 1)[-1]}) + "\n")
                at += len(raw)
                if at >= archive_bytes:
                    yield close()
        if data:
            yield close()

    out = records.mapInArrow(write, "path string, content binary")
    if mounted:
        return cut(out)
    out.write.parquet(f"{folder}/table")
    return records.sparkSession.read.parquet(f"{folder}/table")


def archives_in(spark, glob: str) -> DataFrame:
    """Archives of a store that Spark reads, as (path, content)."""
    return spark.read.format("binaryFile").load(glob).select("path", "content")


FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_archives(archives: DataFrame, payloads: bool = False) -> DataFrame:
    """A row per response and revisit of each archive: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and the payload if wanted.

    A response's digest is computed from what was read, and must be the one in its header if that has one.  A revisit has its
    response's size and digest in its own headers; null where other writers leave them out, as are numbers that they don't give.  Records
    of other types are passed over.  A damaged archive, or one with records and no index, raises ValueError.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                src = Ranges(path, content)
                members = directory(src)
                rows, seen = [], {}
                for member, at, n in read_index(src, members):
                    begin, end, crc = seen.get(member.name) or (stored_at(src, member), 0, 0)
                    if at + n > member.size:
                        raise ValueError(f"{path}: the index points behind {member.name}")
                    raw = src.read(begin + at, n)
                    seen[member.name] = (begin, at + n, zlib.crc32(raw, crc)) if end == at else (begin, -1, 0)
                    if seen[member.name][1:] != (member.size, member.crc) and seen[member.name][1] == member.size:
                        raise ValueError(f"{path}: {member.name} is damaged")
                    warc, http, payload = parse_record(raw)
                    kind = warc["warc-type"]
                    if kind not in ("response", "revisit"):
                        continue
                    digest, size = digest_hex(warc.get("warc-payload-digest")), http.get("content-length")
                    if kind == "response":
                        read_digest, size = hashlib.sha1(payload).hexdigest(), len(payload)
                        if digest not in (None, read_digest):
                            raise ValueError(f"{path}: a payload is damaged")
                        digest = read_digest
                    quoted = warc.get("x-quoted-target-uri")
                    url = warc.get("warc-target-uri") if quoted is None else urllib.parse.unquote(quoted)
                    rows.append((page_of(warc["warc-record-id"]), url, None if size is None else int(size), digest, kind, page_of(warc.get("warc-refers-to")), payload if payloads else None))
                    if len(rows) >= 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)
                src.close()

    return archives.mapInArrow(read, FIELDS)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in FIELDS.split(", ")])


def archive_round_trip(pages: DataFrame, payloads: bool = False) -> DataFrame:
    """Writes a WARC record per row of ``pages`` (page_id, url, html), and reads the archives.

    Null html is an empty payload; a null url leaves out the target; a null page_id is a record without number, and the response of its
    copies only if no copy has a number.  Rows that repeat a page_id and its payload are equally the largest: all of them are responses.
    Payloads of any length are one record, which a task holds whole.  Other columns aren't read.  An empty table gives no archive and an empty result.
    """
    return read_archives(write_archives(plan_records(pages), fresh_path(pages.sparkSession, "warc")), payloads)


def op1_warc_zip(spark, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


SQL = """
WITH p AS (SELECT page_id, url, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, octet_length(encode(html)) AS n, max(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha1(html) AS payload_digest,
  CASE WHEN n >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id <> first THEN first END AS refers_to, url FROM q
"""
