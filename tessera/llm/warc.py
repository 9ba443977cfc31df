"""Operator 6: WARC records in ZIP-packaged archives, written, and read back by ranges.

An archive is a ZIP file of stored members: ``archive/data.warc.gz`` (one gzip member per record),
``indexes/index.cdxj`` (one line per record with its offset and length) and ``datapackage.json``. The reader parses the
end record, the ZIP64 end record where there is one, and the central directory, finds the stored members and the
index, and reads records by range from inside the archive; nothing is extracted. Without an index it walks the gzip
members of the stored file. Neighbouring records are read in one range of about a megabyte.

Of records with equal payloads (by length and SHA-256) of ``revisit_floor`` bytes or more, that with the largest page_id is the response; the
others are revisits that refer to it and carry its digest and length, not its payload. Smaller ones are all responses.

Archives are written straight to the shared folder by the tasks, under names that no other attempt uses; the manifest
rows of the attempts that succeeded say which count. An archive closes at ``archive_bytes``.

Defined results: a null html is an empty payload; a null url is written as an empty one; rows that repeat the largest
page_id with the same payload are all responses, and with null page_ids only, all are responses; a payload longer than an
archive's size makes an archive of its own, and has to fit in a task's memory twice. Repeated rows come back
repeated; extra columns are ignored. Empty table: no archive, no rows.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import common
from tessera.session import table

# Fixed values of the ZIP format.
LOCAL, CENTRAL, END, END64, LOCATOR = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
MAX32, MAX16 = 0xFFFFFFFF, 0xFFFF
READ_AT_ONCE = 1 << 20
DATE = "2024-01-01T00:00:00Z"


# Writing


def zip_bytes(members: list[tuple[str, bytes]], zip64: bool = False) -> bytes:
    """A ZIP file of stored members; ``zip64`` uses the 64-bit records whether or not they are needed."""
    out, central = bytearray(), bytearray()
    for name, data in members:
        raw, at, size, crc = name.encode(), len(out), len(data), zlib.crc32(data)
        big = zip64 or max(size, at) >= MAX32
        extra = struct.pack("<HHQQ", 1, 16, size, size) if big else b""
        small = MAX32 if big else size
        out += struct.pack("<IHHHHHIIIHH", LOCAL, 45, 0x800, 0, 0, 33, crc, small, small, len(raw), len(extra)) + raw + extra + data
        extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if big else b""
        central += struct.pack("<IHHHHHHIIIHHHHHII", CENTRAL, 45, 45, 0x800, 0, 0, 33, crc, small, small, len(raw), len(extra), 0, 0, 0, 0, MAX32 if big else at) + raw + extra
    at, n = len(out), len(members)
    out += central
    if zip64 or n >= MAX16 or at >= MAX32:
        end = len(out)
        out += struct.pack("<IQHHIIQQQQ", END64, 44, 45, 45, 0, 0, n, n, len(central), at)
        out += struct.pack("<IIQI", LOCATOR, 0, end, 1)
        n, at, size = MAX16, MAX32, MAX32
    else:
        size = len(central)
    return bytes(out + struct.pack("<IHHHHIIH", END, 0, 0, n, n, size, at, 0))


def _digest(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record(page_id, url: str, payload: bytes, hex_digest: str, refers_to) -> bytes:
    """One WARC record: a response with its payload, or a revisit with the HTTP head alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    name = lambda i: f"<urn:x-page:{'' if i is None else i}>"
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + " ".join(url.split()), f"WARC-Payload-Digest: {_digest(hex_digest)}", "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


class Archive:
    """Collects records for one archive."""

    def __init__(self):
        self.data, self.index, self.n = bytearray(), [], 0

    def add(self, page_id, url, payload, hex_digest, refers_to):
        packed = _gzip(record(page_id, url or "", payload, hex_digest, refers_to))
        self.index.append(json.dumps({"offset": len(self.data), "length": len(packed), "filename": "data.warc.gz"}))
        self.data += packed
        self.n += 1

    def save(self, where: str) -> tuple[str, int, int]:
        out = zip_bytes([("datapackage.json", b'{"profile":"data-package"}'), ("archive/data.warc.gz", bytes(self.data)), ("indexes/index.cdxj", "\n".join(self.index).encode())])
        fs, path = common.filesystem(where)
        fs.create_dir(path, recursive=True)
        name = f"{uuid.uuid4().hex}.wacz"
        with fs.open_output_stream(f"{path}/{name}") as f:
            f.write(out)
        return f"{where}/{name}", self.n, len(out)


def write(pages: DataFrame, where: str, revisit_floor: int = 1000, archive_bytes: int = 32 << 20) -> DataFrame:
    """Writes archives of ``pages`` (page_id, url, html) to the shared folder; the manifest (path, records, bytes)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256))).withColumn("size", F.octet_length("payload"))
    # only ids and digests are gathered here; the payloads move once, in the join
    same = pages.filter(F.col("size") >= revisit_floor).groupBy("sha256", "size").agg(F.max("page_id").alias("kept"), F.count("*").alias("n"))
    same = same.filter("n > 1").select("sha256", "size", "kept")
    decided = pages.join(same, ["sha256", "size"], "left")
    refers = F.when(F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept")), F.col("kept"))

    def run(batches):
        a = Archive()
        for b in batches:
            for page_id, url, payload, digest, kept in zip(*(c.to_pylist() for c in b.columns)):
                a.add(page_id, url, payload, digest, kept)
                if len(a.data) >= archive_bytes:
                    yield common.batches_of([a.save(where)], MANIFEST)
                    a = Archive()
        if a.n:
            yield common.batches_of([a.save(where)], MANIFEST)

    rows = decided.select("page_id", "url", "payload", "digest", refers.alias("refers"))
    return common.written(rows.mapInArrow(run, "path string, records long, bytes long"), f"{where}/manifest")


MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])

# Reading


class Zip:
    """The members of a ZIP file that can be read by range."""

    def __init__(self, file):
        self.file = file
        self.size = file.size()
        self.members = self._directory()

    def at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError("the archive is cut short")
        return data

    def _directory(self) -> dict[str, tuple[int, int, int, int]]:
        """(local header, stored size, size, method) by name."""
        back = min(self.size, 22 + MAX16 + 20)
        tail, from_ = self.at(self.size - back, back), self.size - back
        i = tail.rfind(struct.pack("<I", END))
        while i >= 0 and (i + 22 > len(tail) or i + 22 + struct.unpack_from("<H", tail, i + 20)[0] != len(tail)):
            i = tail.rfind(struct.pack("<I", END), 0, i)
        if i < 0:
            raise ValueError("no end of central directory")
        n, size, offset = struct.unpack_from("<HII", tail, i + 10)
        if i >= 20 and struct.unpack_from("<I", tail, i - 20)[0] == LOCATOR:
            end64 = self.at(struct.unpack_from("<Q", tail, i - 12)[0], 56)
            if struct.unpack_from("<I", end64)[0] != END64:
                raise ValueError("bad ZIP64 end record")
            n, size, offset = struct.unpack_from("<QQQ", end64, 32)
        elif from_ + i < offset + size:
            raise ValueError("the central directory lies outside the file")
        raw, found, p = self.at(offset, size), {}, 0
        for _ in range(n):
            sign, method, packed, full = *struct.unpack_from("<I", raw, p), *struct.unpack_from("<H", raw, p + 10), *struct.unpack_from("<II", raw, p + 20)
            if sign != CENTRAL:
                raise ValueError("bad central directory")
            a, b, c = struct.unpack_from("<HHH", raw, p + 28)
            at = struct.unpack_from("<I", raw, p + 42)[0]
            name, q = raw[p + 46 : p + 46 + a].decode("utf-8", "replace"), p + 46 + a
            while q + 4 <= p + 46 + a + b:  # extra fields; number 1 holds the values that don't fit 32 bits, in order
                kind, length = struct.unpack_from("<HH", raw, q)
                if kind == 1:
                    wide = iter(struct.unpack_from(f"<{length // 8}Q", raw, q + 4))
                    full = next(wide) if full == MAX32 else full
                    packed = next(wide) if packed == MAX32 else packed
                    at = next(wide) if at == MAX32 else at
                q += 4 + length
            found[name] = (at, packed, full, method)
            p += 46 + a + b + c
        return found

    def stored(self, name: str) -> tuple[int, int]:
        """(offset, size) of a stored member's data in the archive."""
        at, packed, _, method = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed by the archive; only stored members can be read by range")
        head = self.at(at, 30)
        if struct.unpack_from("<I", head)[0] != LOCAL:
            raise ValueError("bad local header")
        a, b = struct.unpack_from("<HH", head, 26)
        return at + 30 + a + b, packed

    def read(self, name: str) -> bytes:
        """A whole member, stored or deflated."""
        at, packed, _, method = self.members[name]
        a, b = struct.unpack_from("<HH", self.at(at, 30), 26)
        data = self.at(at + 30 + a + b, packed)
        return zlib.decompress(data, -15) if method == 8 else data


def index_of(z: Zip) -> list[tuple[str, int, int]] | None:
    """(member, offset, length) of all records by the archive's indexes; None if it has none."""
    names = sorted(n for n in z.members if n.startswith("indexes/"))
    if not names:
        return None
    out = []
    for n in names:
        raw = z.read(n)
        for line in (zlib.decompress(raw, 47) if raw[:2] == b"\x1f\x8b" else raw).decode().splitlines():
            if "{" in line:
                j = json.loads(line[line.index("{") :])
                out.append(("archive/" + j["filename"], int(j["offset"]), int(j["length"])))
    return sorted(out)


def _walk(z: Zip, name: str):
    """Records of a member without an index: one gzip member after another, in bounded memory."""
    at, size = z.stored(name)
    end, d, out = at + size, zlib.decompressobj(47), []
    while at < end:
        data = z.at(at, min(READ_AT_ONCE, end - at))
        at += len(data)
        while data:
            out.append(d.decompress(data))
            data = d.unused_data
            if d.eof:
                yield b"".join(out)
                d, out = zlib.decompressobj(47), []


def records(z: Zip, first: int = 0, end: int | None = None):
    """The raw records ``first`` to ``end`` of an archive, in index order."""
    index = index_of(z)
    if index is None:
        names = sorted(n for n in z.members if n.startswith("archive/"))
        for i, r in enumerate(r for n in names for r in _walk(z, n)):
            if i >= first and (end is None or i < end):
                yield r
        return
    rows, i = index[first:end], 0
    while i < len(rows):
        name, start, size = rows[i]
        j, stop = i + 1, start + size
        while j < len(rows) and rows[j][0] == name and rows[j][1] == stop and stop - start < READ_AT_ONCE:
            stop += rows[j][2]
            j += 1
        base, whole = z.stored(name)
        if stop > whole:
            raise ValueError("an index entry lies outside its member")
        data = z.at(base + start, stop - start)
        for _, offset, length in rows[i:j]:
            piece = data[offset - start : offset - start + length]
            yield zlib.decompress(piece, 47) if piece[:2] == b"\x1f\x8b" else piece
        i = j


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers in lower case, HTTP head, payload) of a WARC record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[: int(h["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return h, http, payload


def _number(name: str | None):
    text = (name or "").removeprefix("<urn:x-page:").removesuffix(">")
    return int(text) if text else None


def result(raw: bytes):
    """(page_id, payload_bytes, payload_digest, record_type, refers_to), the payload checked against its digest."""
    h, http, payload = parse(raw)
    digest = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind = h["warc-type"]
    size = len(payload)
    if kind == "revisit":
        size = next(int(x.split(b":")[1]) for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:"))
    elif hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("a payload differs from its digest")
    return _number(h["warc-record-id"]), size, digest, kind, _number(h.get("warc-refers-to"))


ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])


def read(manifest: DataFrame, at_once: int = 1000) -> DataFrame:
    """The records of the manifest's archives, read by ranges of ``at_once`` records."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("records") - 1, F.lit(at_once).cast("long"))
    ranges = manifest.filter("records > 0").select("path", F.explode(starts).alias("first"))
    # a stated number of tasks: the rows are tiny, and by their size Spark would put all reading into one
    n, wide = ranges.count(), 4 * manifest.sparkSession.sparkContext.defaultParallelism
    ranges = ranges.repartition(max(1, min(n, max(wide, n // 64))), "path", "first")

    def run(batches):
        for b in batches:
            for path, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                fs, local = common.filesystem(path)
                with fs.open_input_file(local) as f:
                    yield common.batches_of([result(r) for r in records(Zip(f), first, first + at_once)], ROWS)

    return ranges.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through ZIP-packaged archives and back."""
    where = common.shared_dir(spark)
    return read(write(table(spark, sf_dir, "pages"), where))


ORACLE = """WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages), d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS digest FROM p),
  k AS (SELECT *, max(page_id) OVER (PARTITION BY digest) AS kept FROM d)
  SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN n >= 1000 AND page_id <> kept THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN n >= 1000 AND page_id <> kept THEN kept END AS refers_to FROM k"""
