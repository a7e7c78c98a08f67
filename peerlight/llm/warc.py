"""WARC archives as a Spark data source, written and read in Python.

Writer: each task writes archives of bounded size; what it wrote counts only once the job commits and names it in a manifest, so that
tasks which died or ran twice leave no records behind.  A second job adds its archives and a manifest to the folder, or takes the place of all that it lists (``overwrite``).  Records are WARC/1.1: responses hold an HTTP message, revisits the profile for equal payloads.
Every record is a gzip member of its own.  Its gzip header carries two lengths in an extra field, which other readers ignore: of the whole member and of the
part that holds the WARC headers (closed by a full flush), so a reader can go from header to header without touching payloads.

Reader: partitions are archives, large ones cut into ranges of bytes at record boundaries found from the manifests; where a folder has manifests, archives that none of them lists aren't read.  Without one every ``.warc`` and
``.warc.gz`` file of the folder is a partition, or the one file that the path names, whoever wrote it: plain files are skipped over by their lengths, gzip
files without the extra field are inflated in one stream.  Equality and ``in`` filters on the record type and on header columns are evaluated on the parsed headers, and a
payload is decoded only for records that pass and only if the schema's ``payload`` column is asked for (option ``payload``).  The payload of an HTTP message is its body.

Paths are URIs that pyarrow's file systems open (local, HDFS, S3); the folder must be shared by all executors.

Cases: null html has an empty payload.  Equal payloads below ``least_bytes`` aren't tied together.  Rows that repeat the page id of
a response with the same payload are responses too.  A null url is left out of the headers.  Long payloads are held one at a time.  Other columns of ``pages`` are ignored, whatever their names.  An
empty table gives an archive folder with an empty manifest, which reads as no rows.  Record ids repeat where page ids do, and every record is dated 1970, since pages have no date.  ``payload_length`` of a record without our length header is its Content-Length.
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, In, InputPartition, WriterCommitMessage

from .common import materialize

#: Columns of a record that come from its headers.
HEADERS = {
    "record_type": "WARC-Type",
    "record_id": "WARC-Record-ID",
    "target_uri": "WARC-Target-URI",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
}
SCHEMA = "record_type string, record_id string, target_uri string, payload_digest string, refers_to string, payload_length long, payload binary"
#: Headers whose values stand in angle brackets.
BRACKETS = ("record_id", "refers_to")
#: Header columns that filters are pushed down to.
PUSHED = tuple(c for c in HEADERS if c != "payload_length")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Date of records whose capture time isn't known.
NO_DATE = "1970-01-01T00:00:00Z"
#: Each job writes a manifest of its own; together they list what the folder holds.
MANIFEST = "_manifest"
#: Payloads that several pages share are broadcast up to here, after they have been counted; a larger table is joined by shuffle.
BROADCAST_DIGESTS = 200_000
#: Bytes of an archive after which the next one begins, and about how many of them a reading task takes.
ARCHIVE_BYTES = 64 << 20
SPLIT_BYTES = 16 << 20


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else path.replace("file:", "file://", 1))


def _member(head: bytes, payload: bytes) -> bytes:
    """A gzip member; extra field ``PL``: bytes of the member, and of deflate data up to the end of the headers."""
    deflate = zlib.compressobj(1, zlib.DEFLATED, -15)
    first = deflate.compress(head) + deflate.flush(zlib.Z_FULL_FLUSH)
    rest = deflate.compress(payload) + deflate.compress(b"\r\n\r\n") + deflate.flush()
    crc = zlib.crc32(b"\r\n\r\n", zlib.crc32(payload, zlib.crc32(head)))
    size = 12 + 16 + len(first) + len(rest) + 8
    extra = b"PL" + struct.pack("<HQI", 12, size, len(first))
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H", len(extra)) + extra + first + rest + struct.pack("<II", crc, (len(head) + len(payload) + 4) & 0xFFFFFFFF)


def record(row) -> bytes:
    """A WARC/1.1 record of a row with the columns of ``SCHEMA``; revisits carry no payload."""
    revisit = row["record_type"] == "revisit"
    lines = ["WARC/1.1"]
    for column, name in HEADERS.items():
        if row[column] is not None:
            value = str(row[column]).replace("\r", " ").replace("\n", " ")
            lines.append(f"{name}: <{value}>" if column in BRACKETS else f"{name}: {value}")
    lines.append(f"WARC-Date: {NO_DATE}")
    if revisit:
        body = b""
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    else:
        payload = bytes(row["payload"] or b"")
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return _member("\r\n".join([*lines, "", ""]).encode("utf-8", "surrogatepass"), body)


def headers(head: bytes) -> dict[str, str]:
    """Header fields by lower-case name; folded lines belong to the field above."""
    out, last = {}, ""
    for line in head.decode("utf-8", "replace").splitlines()[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip()
        elif ":" in line:
            last, value = line.split(":", 1)
            last = last.strip().lower()
            out[last] = value.strip()
    return out


def columns(found: dict[str, str]) -> dict:
    """The header columns of ``SCHEMA``."""
    row = {c: found.get(h.lower()) for c, h in HEADERS.items()}
    row |= {c: row[c][1:-1] for c in BRACKETS if row[c] and row[c][0] == "<" and row[c][-1] == ">"}
    row["payload_length"] = int(row["payload_length"] or found.get("content-length", 0))
    return row


def body_of(found: dict[str, str], block: bytes) -> bytes:
    """The payload: of an HTTP message what follows its headers."""
    if found.get("content-type", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def stream(file, wanted, payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    """Records of an archive that is read from one end to the other, as (columns, payload); blocks of others are skipped."""
    while line := file.readline():
        if not line.strip():  # what closes the record before
            continue
        head = line
        while (line := file.readline()).strip():
            head += line
        found = headers(head)
        size, row = int(found.get("content-length", 0)), columns(found)
        if wanted(row) and payload:
            yield row, body_of(found, file.read(size))
            continue
        if file.seekable() and not isinstance(file, gzip.GzipFile):
            file.seek(size, 1)
        else:
            left = size
            while left and (part := file.read(min(left, 1 << 20))):
                left -= len(part)
        if wanted(row):
            yield row, None


class Written(WriterCommitMessage):
    def __init__(self, archives: list[dict]):
        self.archives = archives


def manifests(system, folder: str) -> list[str]:
    """Paths of the manifests of a folder."""
    from pyarrow.fs import FileSelector

    found = system.get_file_info(FileSelector(folder, allow_not_found=True))
    return sorted(f.path for f in found if f.is_file and f.base_name.startswith(MANIFEST) and f.base_name.endswith(".json"))


def listed(system, paths: list[str]) -> list[dict]:
    out = []
    for path in paths:
        with system.open_input_stream(path) as f:
            out += json.loads(f.read())
    return out


class WarcWriter(DataSourceWriter):
    """Adds archives to a folder, or with ``overwrite`` puts them in place of those that it lists."""

    def __init__(self, path: str, overwrite: bool = False):
        self.path, self.overwrite = path, overwrite

    def write(self, rows: Iterator) -> Written:
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        archives, out = [], None
        try:
            for row in rows:
                if out is None or archives[-1]["bytes"] >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    archives.append({"name": f"{uuid.uuid4().hex}.warc.gz", "bytes": 0, "splits": [0]})
                    out = system.open_output_stream(f"{folder}/{archives[-1]['name']}", compression=None)
                data, to = record(row), archives[-1]
                out.write(data)
                to["bytes"] += len(data)
                if to["bytes"] - to["splits"][-1] >= SPLIT_BYTES:
                    to["splits"].append(to["bytes"])
        finally:
            if out is not None:
                out.close()
        return Written(archives)

    def commit(self, messages: list[Written | None]) -> None:
        """A manifest appears as a whole, under a name of its own, so that jobs that write at once don't lose each other's archives."""
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        before = manifests(system, folder) if self.overwrite else []
        name = f"{folder}/{MANIFEST}-{uuid.uuid4().hex}.json"
        with system.open_output_stream(f"{name}.draft") as out:
            out.write(json.dumps([a for m in messages if m for a in m.archives]).encode())
        system.move(f"{name}.draft", name)
        old = listed(system, before)
        for path in before:
            system.delete_file(path)
        for a in old:
            system.delete_file(f"{folder}/{a['name']}")

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _open(self.path)
        for m in messages:
            for a in m.archives if m else []:
                system.delete_file(f"{folder}/{a['name']}")


class Range(InputPartition):
    def __init__(self, name: str, first: int, end: int):
        self.name, self.first, self.end = name, first, end


class WarcReader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload = path, payload
        self.wanted: list[tuple[str, set[str]]] = []

    def pushFilters(self, filters):
        for f in filters:
            column = ".".join(f.attribute) if isinstance(f, (EqualTo, In)) else ""
            if column in PUSHED and isinstance(f, EqualTo):
                self.wanted.append((column, {str(f.value)}))
            elif column in PUSHED and isinstance(f, In):
                self.wanted.append((column, {str(v) for v in f.value if v is not None}))
            else:
                yield f

    def passes(self, row: dict) -> bool:
        return all(row[c] in values for c, values in self.wanted)

    def partitions(self) -> list[Range]:
        system, folder = _open(self.path)
        info = system.get_file_info(folder)
        if info.is_file:
            return [Range("", 0, info.size)]
        if found := manifests(system, folder):
            archives = listed(system, found)
            parts = [Range(a["name"], x, y) for a in archives for x, y in zip(a["splits"], [*a["splits"][1:], a["bytes"]], strict=True) if x < y]
        else:
            from pyarrow.fs import FileSelector

            files = system.get_file_info(FileSelector(folder))
            parts = [Range(f.base_name, 0, f.size) for f in sorted(files, key=lambda f: f.base_name) if f.is_file and f.base_name.endswith((".warc", ".warc.gz"))]
        return parts or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[tuple]:
        if part.first == part.end:
            return
        system, folder = _open(self.path)
        path = f"{folder}/{part.name}" if part.name else folder
        with system.open_input_file(path) as f:
            at = part.first
            while at < part.end:
                f.seek(at)
                fixed = f.read(28)
                if fixed[:4] != b"\x1f\x8b\x08\x04" or fixed[12:16] != b"PL" + struct.pack("<H", 12):  # not of our writer
                    f.seek(at)
                    plain = fixed[:2] != b"\x1f\x8b"
                    for row, body in stream(io.BufferedReader(f) if plain else gzip.GzipFile(fileobj=f), self.passes, self.payload):
                        yield (*row.values(), body)
                    return
                size, head = struct.unpack("<QI", fixed[16:28])
                inflate = zlib.decompressobj(-15)
                found = headers(inflate.decompress(f.read(head)))
                row = columns(found)
                if self.passes(row):
                    body = None
                    if self.payload:
                        rest = inflate.decompress(f.read(size - 28 - head - 8))
                        body = body_of(found, rest[: int(found["content-length"])])
                    yield (*row.values(), body)
                at += size


class Warc(DataSource):
    """``format("warc")``; options: path, payload (true unless "false")."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(self.options["path"], self.options.get("payload", "true") != "false")

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def records_of_pages(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Rows of ``SCHEMA`` for ``pages`` (page_id, url, html): the response with the largest id stands for all with its payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload")).withColumns({"_sha1": F.sha1("payload"), "payload_length": F.octet_length("payload").cast("long")})
    # sums over all rows first, so that a payload with very many pages is one row a task before it is shuffled
    shared = (
        pages.select(F.col("page_id").cast("long").alias("page_id"), payload.alias("payload")).select("page_id", F.sha1("payload").alias("_digest"), F.octet_length("payload").alias("_length"))
        .filter(F.col("_length") >= least_bytes)
        .groupBy("_digest", "_length").agg(F.max("page_id").alias("_last"), F.min("page_id").alias("_first"))
        .filter("_first < _last").drop("_first")
    )
    shared = materialize(shared, "warc-shared")
    if shared.count() <= BROADCAST_DIGESTS:  # then no payload is shuffled
        shared = F.broadcast(shared)
    tied = rows.join(shared, (rows._sha1 == shared._digest) & (rows.payload_length == shared._length), "left")
    revisit = F.coalesce(F.col("page_id") < F.col("_last"), F.lit(False))
    urn = lambda c: F.concat(F.lit("urn:page:"), c.cast("string"))
    return tied.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        urn(F.col("page_id")).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.concat(F.lit("sha1:"), F.col("_sha1")).alias("payload_digest"),
        F.when(revisit, urn(F.col("_last"))).alias("refers_to"),
        "payload_length",
        F.when(~revisit, F.col("payload")).alias("payload"),
    )


def write(records: DataFrame, path: str, mode: str = "append") -> None:
    """``mode``: append to what the folder holds, or overwrite it."""
    register(records.sparkSession)
    records.write.format("warc").mode(mode).option("path", path).save()


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("path", path).option("payload", str(payload).lower()).load()


def pages_of_records(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) as the archives hold it.

    Responses are read with their payloads, and length and digest are computed anew; revisits by their headers alone.
    """
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    response = read(spark, path).filter(F.col("record_type") == "response").select("record_type", "record_id", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    revisit = read(spark, path, payload=False).filter(F.col("record_type") == "revisit").select("record_type", "record_id", "refers_to", F.col("payload_length").alias("payload_bytes"), F.substring_index("payload_digest", ":", -1).alias("payload_digest"))
    return response.unionByName(revisit).select(number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to")).alias("refers_to"))
