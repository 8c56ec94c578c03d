"""WARC archives compressed with a Zstandard dictionary.

An archive (.warc.zst) begins with a skippable frame that holds a dictionary built from its own first
SAMPLE bytes of records (rows come in the order of their payloads' hashes, so these are a sample); each
record follows as a frame of its own.  Of records with equal payloads the one with the smallest id is
a response; the others are revisits that refer to it and hold no payload.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilstone.llm.store import batches as arrow_batches
from veilstone.llm.store import fresh_path, quoted, written

#: Fixed values of the format: the skippable frame for a dictionary, and the profile of revisits.
DICTIONARY_FRAME = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Names for record ids; bytes of records that a dictionary is built from, its size, and those of an archive.
NAMES = uuid.UUID("5f0c7d1e-52a4-4f6e-9c0b-6a2f1c8f3d77")
SAMPLE, DICTIONARY, ARCHIVE = 2 << 20, 64 << 10, 128 << 20
DATE = "2000-01-01T00:00:00Z"
#: Sizes of the pieces that few or short records are cut into until a dictionary can be built from them.
PIECES = (4096, 512, 64)


def record_id(page: str | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page}|{digest}')}>"


def record(page: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None, date: str = DATE, own_id: str | None = None, names_response: bool = True) -> bytes:
    """One WARC record; with refers_to (an id) a revisit, whose block ends with the HTTP headers.

    own_id: the record's id, if its page's rows repeat; a revisit of such rows names their page, but no
    record (names_response is False), as several have the payload.
    """
    clean = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode("utf-8", "surrogatepass")) for c in url or f"urn:page:{page}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {own_id or record_id(page, digest)}", f"WARC-Date: {date}",
        f"WARC-Target-URI: {clean}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page is not None:
        head.append(f"X-Page-Id: {page}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", *[f"WARC-Refers-To: {record_id(refers_to, digest)}"] * names_response, f"X-Refers-To-Page-Id: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary built from records; few or short ones are cut into smaller and smaller pieces.

    Where nothing can be trained from any pieces (records that are hardly different, say), the end of the
    records themselves is the dictionary's content, which the format allows too.
    """
    size = min(DICTIONARY, max(256, sum(map(len, records)) // 10))
    for n in (0, *PIECES):
        parts = records if not n else [r[i : i + n] for r in records for i in range(0, len(r), n)]
        try:
            return zstandard.train_dictionary(size, parts)
        except zstandard.ZstdError:
            continue
    return zstandard.ZstdCompressionDict(b"".join(records)[-DICTIONARY:], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class ArchiveWriter:
    """One archive.  The first SAMPLE bytes of records wait until the dictionary is built from them."""

    def __init__(self, out, level: int = 3):
        self.out, self.level, self.records, self.raw, self.stored = out, level, 0, 0, 0
        self.waiting: list[bytes] = []
        self.compress = None

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.stored += len(data)

    def _begin(self) -> None:
        built = build_dictionary(self.waiting)
        inner = zstandard.ZstdCompressor(level=19).compress(built.as_bytes())
        self._put(struct.pack("<II", DICTIONARY_FRAME, len(inner)) + inner)
        self.compress = zstandard.ZstdCompressor(level=self.level, dict_data=built, write_checksum=True).compress
        for r in self.waiting:
            self._put(self.compress(r))
        self.waiting = []

    def add(self, data: bytes) -> None:
        self.records += 1
        self.raw += len(data)
        if self.compress:
            self._put(self.compress(data))
            return
        self.waiting.append(data)
        if self.raw >= SAMPLE:
            self._begin()

    def close(self) -> None:
        if not self.compress:
            self._begin()
        self.out.close()


def read_archive(raw) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an open archive, one at a time."""
    first = raw.read(8)
    dictionary = None
    if len(first) == 8 and struct.unpack("<II", first)[0] == DICTIONARY_FRAME:
        inner = raw.read(struct.unpack("<II", first)[1])
        if inner[:4] == b"\x28\xb5\x2f\xfd":
            inner = zstandard.ZstdDecompressor().decompress(inner)
        dictionary, first = zstandard.ZstdCompressionDict(inner), b""

    class Rest(io.RawIOBase):
        head = first

        def readable(self) -> bool:
            return True

        def readinto(self, into) -> int:
            got = self.head[: len(into)] or raw.read(len(into))
            self.head = self.head[len(into) :]
            into[: len(got)] = got
            return len(got)

    stream = io.BufferedReader(zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BufferedReader(Rest()), read_across_frames=True))
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            k, _, v = line.decode("utf-8").rstrip("\r\n").partition(": ")
            head[k.lower()] = v
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end as it should")
        yield head, block


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def payload(html: Column) -> Column:
    return F.coalesce(html, F.lit(""))


def _sweep(spark, folder: str, run: str, names: set[str]) -> None:
    """Deletes what lost attempts of a run have left in its folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for f in files.listStatus(path(folder)) if files.exists(path(folder)) else []:
        name = f.getPath().getName()
        if name.startswith(run) and name not in names:
            files.delete(f.getPath(), False)


def write_archives(
    pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = 0, date: str | None = None
) -> DataFrame:
    """Writes a record for each row; returns the written table of archives (path, records, raw_bytes, bytes).

    Null html is an empty payload, a null url a urn of the page; other columns aren't read.  Payloads of
    ``least`` bytes or more are compared; rows that repeat the id and payload of a response are
    responses too, as are all rows of a payload without any id.  Each record has an id of its own;
    revisits of a response whose row repeats name its page only.  date: WARC-Date of all records, by
    default the time of the call.  Each task writes archives of its own, of about 128 MB before
    compression, one record in memory at a time; only those that the returned table names count, and
    what lost attempts have left is deleted.  The folder has to be one that executors share, by a URI
    that pyarrow.fs opens.  No rows, no archives.
    """
    spark = pages.sparkSession
    folder, run = folder or fresh_path(spark, "warc"), uuid.uuid4().hex[:12]
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    html, page = F.col(quoted(html_col)), F.col(quoted(id_col))
    rows = pages.select(page.alias("id"), F.col(quoted(url_col)).alias("url"), payload(html).alias("payload"), F.unhex(F.sha1(payload(html))).alias("digest"))
    each = rows.where("id IS NOT NULL").where(F.octet_length("payload") >= least).groupBy("digest", "id").agg(F.count(F.lit(1)).alias("n"))
    first = written(each.groupBy("digest").agg(F.min(F.struct("id", "n")).alias("first")).select("digest", "first.*").withColumnRenamed("id", "first"), "warc-first")
    own = F.col("id").eqNullSafe(F.col("first"))
    dealt = rows.join(first, "digest", "left").select(
        "digest", "payload", "url", F.col("id").cast("string").alias("id"), F.when(~own, F.col("first")).cast("string").alias("first"), (own & (F.col("n") == 1)).alias("lone"), F.coalesce(F.col("n") == 1, F.lit(False)).alias("named")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, path = fs.FileSystem.from_uri(folder)
        done: list[tuple[str, int, int, int]] = []
        now: ArchiveWriter | None = None
        name = ""

        def end() -> None:
            now.close()
            done.append((name, now.records, now.raw, now.stored))

        for b in batches:
            for d, p, url, page, refers, lone, named in zip(*(b.column(c).to_pylist() for c in ("digest", "payload", "url", "id", "first", "lone", "named")), strict=True):
                if now is None:
                    where.create_dir(path, recursive=True)
                    name = f"{run}-{uuid.uuid4().hex}.warc.zst"
                    # by its name the file would be compressed once more
                    now = ArchiveWriter(where.open_output_stream(f"{path}/{name}", compression=None))
                digest = base32_sha1(d)
                own_id = None if lone and refers is None else record_id(f"{name}|{now.records}", digest)
                now.add(record(page, url, p.encode("utf-8", "surrogatepass"), digest, refers, date, own_id, named))
                if now.raw >= ARCHIVE:
                    end()
                    now = None
        if now is not None:
            end()
        names, n, raw, stored = zip(*done, strict=True) if done else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array([f"{folder}/{x}" for x in names], pa.string()), *(pa.array(x, pa.int64()) for x in (n, raw, stored))], ["path", "records", "raw_bytes", "bytes"]
        )

    with arrow_batches(spark, 64):
        archives = written(dealt.mapInArrow(write, "path STRING, records LONG, raw_bytes LONG, bytes LONG"), "warc-archives")
    _sweep(spark, folder, run, {r.path.rsplit("/", 1)[1] for r in archives.select("path").collect()})
    return archives


def read_archives(archives: DataFrame, id_type: str = "BIGINT") -> DataFrame:
    """(page_id, url, record_id, payload_bytes, payload_digest, record_type, refers_to) of each record.

    archives: a table with path; its other columns aren't read.  Records stream one by one, however
    long; a response whose payload doesn't have its digest is an error.  No archives, no rows.
    """
    names = ["page_id", "url", "record_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]

    def rows(path: str) -> Iterator[tuple]:
        where, inner = fs.FileSystem.from_uri(path)
        with where.open_input_stream(inner, compression=None) as raw:
            for head, block in read_archive(raw):
                http, _, body = block.partition(b"\r\n\r\n")
                size = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
                digest = head["warc-payload-digest"].removeprefix("sha1:")
                if head["warc-type"] == "response" and (len(body) != size or base32_sha1(hashlib.sha1(body).digest()) != digest):
                    raise ValueError(f"{path}: {head['warc-record-id']} isn't what its digest says")
                yield head.get("x-page-id"), head["warc-target-uri"], head["warc-record-id"], size, digest, head["warc-type"], head.get("x-refers-to-page-id")

    def batch(got: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64() if n == "payload_bytes" else pa.string()) for n, c in zip(names, zip(*got, strict=True), strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for b in batches:
            for path in b.column("path").to_pylist():
                for r in rows(path):
                    got.append(r)
                    if len(got) >= 2000:
                        yield batch(got)
                        got = []
        if got:
            yield batch(got)

    paths = archives.select("path")
    dealt = paths.repartition(max(1, min(paths.count(), 10_000)))
    found = dealt.mapInArrow(read, ", ".join(f"{n} {'LONG' if n == 'payload_bytes' else 'STRING'}" for n in names))
    return found.withColumns({c: F.col(c).cast(id_type) for c in ("page_id", "refers_to")})
