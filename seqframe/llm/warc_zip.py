"""WARC in ZIP packages: a writer, and a reader that fetches records by byte range without extraction.

A package is a ZIP file (WACZ-like) with two stored members: archive/data.warc.gz, one gzip member a
record, and indexes/index.cdx, one line of JSON a record with its offset and length in the archive.
The reader takes the end record (ZIP64 where the plain fields are full), walks the central directory,
finds each stored member's data behind its local header, reads the index, and then each record by its
range.  All access goes through pyarrow's file systems, so packages may lie in any store they know.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .shared import Stored, join_unique, new_path, with_membership

#: Fixed values of the ZIP format (PKWARE APPNOTE): signatures and full-field marks.
LOCAL, CENTRAL, END, END64, LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MIN_REVISIT_BYTES = 100
#: Archive bytes that a reading task fetches.
TASK_BYTES = 64 << 20


#: Schemes that Hadoop names otherwise than pyarrow.
SCHEMES = {"s3a": "s3", "s3n": "s3", "viewfs": "hdfs"}


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path as Spark names it: by pyarrow, or, for schemes that it doesn't know, by fsspec where that is installed."""
    scheme, colon, rest = path.partition(":")
    if not colon or "/" in scheme:
        return pafs.LocalFileSystem(), path
    try:
        return pafs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    except pa.ArrowInvalid:
        import fsspec

        store, root = fsspec.core.url_to_fs(path)
        return pafs.PyFileSystem(pafs.FSSpecHandler(store)), root


class PackageWriter:
    """A ZIP file of stored members, written in one pass to a stream; ZIP64 where sizes or counts need it, or always if asked."""

    def __init__(self, stream, zip64: bool = False):
        self.stream, self.at, self.members, self.zip64 = stream, 0, [], zip64

    def put(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        """Sizes follow the data (flag bit 3), as they aren't known yet."""
        self.open = [name.encode(), self.at, 0, 0]
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)
        self.put(LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x0808, 0, 0, 0x21, 0, FULL32, FULL32, len(self.open[0]), len(extra)) + self.open[0] + extra)

    def write(self, data: bytes) -> None:
        self.put(data)
        self.open[2] += len(data)
        self.open[3] = zlib.crc32(data, self.open[3])

    def end(self) -> None:
        _, _, size, crc = self.open
        self.put(b"PK\x07\x08" + struct.pack("<IQQ", crc, size, size))
        self.members.append(tuple(self.open))

    def close(self) -> None:
        start = self.at
        for name, at, size, crc in self.members:
            wide = b"".join(struct.pack("<Q", x) for x, big in ((size, self.large(size)), (size, self.large(size)), (at, self.large(at))) if big)
            extra = struct.pack("<HH", 1, len(wide)) + wide if wide else b""
            low = lambda x: FULL32 if self.large(x) else x
            self.put(CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 0x0808, 0, 0, 0x21, crc, low(size), low(size), len(name), len(extra), 0, 0, 0, 0, low(at)) + name + extra)
        size, count = self.at - start, len(self.members)
        if self.zip64 or self.large(start) or count >= FULL16:
            end64 = self.at
            self.put(END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, count, count, size, start))
            self.put(LOCATOR64 + struct.pack("<IQI", 0, end64, 1))
        cap = (FULL16, FULL32, FULL32) if self.zip64 else (min(count, FULL16), min(size, FULL32), min(start, FULL32))
        self.put(END + struct.pack("<HHHHIIH", 0, 0, cap[0], cap[0], cap[1], cap[2], 0))

    def large(self, x: int) -> bool:
        return self.zip64 or x >= FULL32


class PackageReader:
    """Members of a ZIP file by name: (offset of the data, size). Compressed or encrypted members are refused on use."""

    def __init__(self, file, size: int):
        self.file = file
        tail_at = max(0, size - (FULL16 + 22))
        tail = self.read(tail_at, size - tail_at)
        at = tail.rfind(END)
        while at >= 0 and (at + 22 > len(tail) or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
            at = tail.rfind(END, 0, at)  # the signature may stand in a comment
        if at < 0:
            raise ValueError("no end of central directory: not a ZIP file, or cut short")
        count, length, start = struct.unpack_from("<HII", tail, at + 10)
        if count == FULL16 or length == FULL32 or start == FULL32:
            locator = self.read(tail_at + at - 20, 20)
            if locator[:4] != LOCATOR64:
                raise ValueError("ZIP64 fields without a ZIP64 locator")
            end64 = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
            if end64[:4] != END64:
                raise ValueError("damaged ZIP64 end of central directory")
            count, length, start = struct.unpack_from("<QQQ", end64, 32)
        self.members = dict(self._directory(self.read(start, length), count))

    def read(self, at: int, size: int) -> bytes:
        self.file.seek(at)
        data = self.file.read(size)
        if len(data) != size:
            raise ValueError(f"{size} bytes at {at} are not all there")
        return bytes(data)

    @staticmethod
    def _directory(data: bytes, count: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        at = 0
        for _ in range(count):
            if data[at : at + 4] != CENTRAL:
                raise ValueError("damaged central directory")
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, size, name_len, extra_len, comment_len = struct.unpack_from("<IIHHH", data, at + 20)
            offset = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46 : at + 46 + name_len].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = data[at + 46 + name_len : at + 46 + name_len + extra_len], 0
            while e + 4 <= len(extra):
                kind, n = struct.unpack_from("<HH", extra, e)
                if kind == 1:  # 64-bit fields, only those that are full in the plain record, in this order
                    wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                    size = next(wide) if size == FULL32 else size
                    packed = next(wide) if packed == FULL32 else packed
                    offset = next(wide) if offset == FULL32 else offset
                e += 4 + n
            yield name, (offset, size, 99 if flags & 1 else method)
            at += 46 + name_len + extra_len + comment_len

    def data_of(self, name: str) -> tuple[int, int]:
        if name not in self.members:
            raise ValueError(f"no member {name}")
        offset, size, method = self.members[name]
        if method:
            raise ValueError(f"{name} isn't stored as it is; records in it have no byte ranges")
        head = self.read(offset, 30)
        if head[:4] != LOCAL:
            raise ValueError("damaged local header")
        name_len, extra_len = struct.unpack_from("<HH", head, 26)
        return offset + 30 + name_len + extra_len, size


def record_bytes(kind: str, url: str | None, page_id: int | None, payload: bytes, digest: str, refers_to: int | None, size: int | None = None) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit holds the HTTP head only, with the payload's length, which `size` tells."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    body = http + (payload if kind == "response" else b"")
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}" if page_id is not None else f"payload:{digest}")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_one_line(url)}", f"WARC-Payload-Digest: sha256:{digest}"]
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if kind == "revisit":
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    whole = "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"
    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
    return gz.compress(whole) + gz.flush()


def _one_line(url: str | None) -> str:
    return " ".join((url or "about:blank").split())


def parse_record(data: bytes) -> dict:
    """A gzip member as its headers (lower-case names), HTTP headers and payload."""
    whole = zlib.decompress(data, 31)
    head, _, rest = whole.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    body = rest[: int(headers["content-length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    return {"headers": headers, "http": fields, "payload": payload}


def plan_records(pages: DataFrame, text: str = "html", key: str = "page_id", url: str = "url", min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """page_id, url, html (null for revisits), size, digest, refers_to: the smallest page_id of equal payloads of min_bytes at least, null for responses.

    Revisits are found among digests and ids alone; the first pages of copied payloads, a bounded number of hot ones aside, meet
    their copies by a join of narrow rows.  A payload goes from its scan to its package and is not shuffled: revisits are told
    by (page_id, digest), and their rows leave the payload behind.
    """
    html = F.coalesce(F.col(text), F.lit(""))
    base = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha2(html, 256).alias("digest"))
    ids = Stored(base.filter(F.col("size") >= min_bytes).select("page_id", "digest"), "payloads")
    firsts = Stored(ids.df.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1"), "firsts")
    again = join_unique(ids.df, firsts.df, "digest", "n").filter("first < page_id").groupBy("page_id", "digest").agg(F.min("first").alias("refers_to"))
    again = Stored(again, "revisits")
    marked = with_membership(base, again.df, ["page_id", "digest"], "again")
    whole = marked.filter("NOT again").select("page_id", "url", "html", "size", "digest", F.lit(None).cast("long").alias("refers_to"))
    copies = marked.filter("again").select("page_id", "url", F.lit(None).cast("string").alias("html"), "size", "digest").join(again.df, ["page_id", "digest"])
    return whole.unionByName(copies)


def _write(batches, folder: str, package_bytes: int, zip64: bool):
    store, root = filesystem(folder)
    store.create_dir(root, recursive=True)
    part, made = TaskContext.get().partitionId(), 0
    writer = stream = None
    index: list[str] = []

    def finish():
        writer.end()
        writer.begin(INDEX)
        writer.write("\n".join([*index, ""]).encode())
        writer.end()
        writer.close()
        stream.close()
        return pa.record_batch([pa.array([name]), pa.array([len(index)], pa.int64()), pa.array([writer.at], pa.int64())], names=["path", "records", "bytes"])

    for block in tc.blocks(batches, "html"):
        for page, url, html, size, digest, refers in zip(*(block.column(c).to_pylist() for c in ("page_id", "url", "html", "size", "digest", "refers_to")), strict=True):
            if writer is None:  # a name of its own for each attempt: a task that runs again leaves whole files only
                name = f"{root}/part-{part:06d}-{made:04d}-{uuid.uuid4().hex[:8]}.wacz"
                stream = store.open_output_stream(name)
                writer, index, made, base = PackageWriter(stream, zip64), [], made + 1, 0
                writer.begin(ARCHIVE)
                base = writer.at
            kind = "response" if refers is None else "revisit"
            data = record_bytes(kind, url, page, (html or "").encode("utf-8", "surrogatepass"), digest, refers, size)
            index.append(json.dumps({"page": page, "offset": writer.at - base, "length": len(data)}))
            writer.write(data)
            if writer.at >= package_bytes:
                yield finish()
                writer = None
    if writer is not None:
        yield finish()


def write_packages(pages: DataFrame, folder: str, package_bytes: int = 256 << 20, zip64: bool = False, **columns) -> DataFrame:
    """Writes a record for each row of pages into packages in `folder`; returns the manifest (path, records, bytes).

    The manifest is written down before anything reads it, so that packages of lost attempts are never read.
    """
    rows = plan_records(pages, **columns)
    return Stored(rows.mapInArrow(lambda it: _write(it, folder, package_bytes, zip64), "path string, records long, bytes long"), "manifest").df


def index_entries(file, size: int) -> Iterator[tuple[int, int]]:
    """(offset, length) in the package file of each record, by way of the stored index."""
    reader = PackageReader(file, size)
    base, room = reader.data_of(ARCHIVE)
    at, length = reader.data_of(INDEX)
    for line in reader.read(at, length).splitlines():
        e = json.loads(line)
        if e["offset"] < 0 or e["offset"] + e["length"] > room:
            raise ValueError("the index points out of the archive")
        yield base + e["offset"], e["length"]


def _ranges(batches, folder: str, per_row: int):
    store, _ = filesystem(folder)
    for batch in batches:
        for path, size in zip(batch.column("path").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
            with store.open_input_file(path) as file:
                entries = list(index_entries(file, size))
            for i in range(0, len(entries), per_row):
                part = entries[i : i + per_row]
                yield pa.record_batch([pa.array([path]), pa.array([[a for a, _ in part]], pa.list_(pa.int64())), pa.array([[n for _, n in part]], pa.list_(pa.int64()))], names=["path", "offsets", "lengths"])


def _fetch(batches, folder: str):
    store, _ = filesystem(folder)
    for batch in batches:
        for path, offsets, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "offsets", "lengths")), strict=True):
            out = []
            with store.open_input_file(path) as file:
                for at, n in zip(offsets, lengths, strict=True):
                    file.seek(at)
                    r = parse_record(file.read(n))
                    h, full = r["headers"], r["headers"]["warc-type"] == "response"
                    digest = hashlib.sha256(r["payload"]).hexdigest() if full else h["warc-payload-digest"].partition(":")[2]
                    if full and digest != h["warc-payload-digest"].partition(":")[2]:
                        raise ValueError(f"record at {at} of {path}: the payload doesn't match its digest")
                    page, refers = h.get("x-page-id"), h.get("x-refers-to-page-id")
                    out.append((None if page is None else int(page), h["warc-target-uri"], len(r["payload"]) if full else int(r["http"]["content-length"]), digest, h["warc-type"], None if refers is None else int(refers), r["payload"] if full else None))
            columns = list(zip(*out, strict=True)) if out else [()] * 7
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def read_packages(manifest: DataFrame, folder: str, per_row: int = 64) -> DataFrame:
    """One row a record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload (null for revisits).

    Packages are planned as ranges of per_row records from their directories and indexes; ranges are dealt to as many tasks as the
    manifest's bytes need, and each record is read by its own range.  Digests of responses are checked against their payloads.
    """
    spark = manifest.sparkSession
    files, size = manifest.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    lanes = spark.sparkContext.defaultParallelism
    # explicit numbers, which adaptive execution leaves as they are: rows here are ranges, small whatever is behind them
    found = manifest.select("path", "bytes").repartition(max(1, min(files, 4 * lanes, 10_000))).mapInArrow(lambda it: _ranges(it, folder, per_row), "path string, offsets array<long>, lengths array<long>")
    tasks = max(1, min(lanes, files), size // TASK_BYTES)
    return found.repartition(tasks, F.col("path"), F.col("offsets")[0]).mapInArrow(lambda it: _fetch(it, folder), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Writes pages into packages in the shared folder and reads them back.

    Null html is an empty payload; payloads under 100 bytes are responses all; of rows that repeat a page_id and payload
    each is a response if it is the first, since none is smaller.  Rows without a page_id are responses that nothing refers to.
    An empty table makes no package and no rows; other columns are ignored.
    """
    folder = new_path(pages.sparkSession, "packages")
    return read_packages(write_packages(pages, folder), folder)
