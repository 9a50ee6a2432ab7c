"""Legacy archives (ARC) to WARC.

Pages are written as ARC files to the shared folder; what converts them knows nothing but those files.
A first pass over the files gives each record's digest, from which it follows which records revisit
others; a second one reads each file again beside the marks of its records and writes WARC files.
Contents stay in the tasks that read them: marks are all that is shuffled.

An ARC file opens with a version block that names the fields of its record lines; version 1
has five, version 2 ten.  Each record is such a line and as many bytes as it declares.  From
these a WARC record is made: an identifier derived from the record, its timestamp in ISO form,
its type, and SHA-1 digests of block and payload.  Of records with equal payloads the one with
the smallest source id is a response and the others revisit it.  An identifier is made from the
source, the digest and the record's place in its archive, so no two are equal.

Cases: a null payload is empty, and empty payloads equal each other; a null URL is written as
"-", white space in it is percent-encoded; of repeated rows, all with the smallest id are
responses.  Null ids sort after all others.  An empty table writes no archive and gives an
empty result.  Only the named columns are read."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import Batches, BatchFn, columns_as, join_one, new_path, partitions, shared_dir, staged, store_of, utf8

# fixed values: the field names of either version's record lines
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
SOURCE_HEADER = b"X-Source-Id"
ARC_BYTES = 4 << 20
FILE_BYTES = 32 << 20
LEVEL = 2
ARC_LEVEL = 1


class ArcRecord(NamedTuple):
    url: str
    ip: str
    date: str
    mime: str
    content: bytes


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def write_arc(records: list[ArcRecord], version: int = 1, name: str = "pages.arc") -> bytes:
    """One uncompressed ARC file."""
    fields = " ".join(ARC_FIELDS[version])
    block = f"{version} 0 tidemark\n{fields}\n\n".encode()
    date = records[0].date if records else "19960101000000"

    def line(r: ArcRecord, offset: int) -> bytes:
        url = "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in r.url) or "-"
        values = {"URL": url, "IP-address": r.ip, "Archive-date": r.date, "Content-type": r.mime, "Result-code": "200", "Checksum": "-", "Location": "-", "Offset": str(offset), "Filename": name, "Archive-length": str(len(r.content))}
        return (" ".join(values[f] for f in ARC_FIELDS[version]) + "\n").encode()

    out = [line(ArcRecord(f"filedesc://{name}", "0.0.0.0", date, "text/plain", block), 0), block]
    at = sum(map(len, out))
    for r in records:
        out += [b"\n", head := line(r, at + 1), r.content]
        at += 1 + len(head) + len(r.content)
    return b"".join(out)


def read_arc(data: bytes) -> Iterator[ArcRecord]:
    """The records after the version block; lengths are those declared, whatever the bytes hold."""
    end = data.index(b"\n")
    size = int(data[:end].rsplit(b" ", 1)[1])
    block = data[end + 1 : end + 1 + size].split(b"\n")
    version = int(block[0].split(b" ", 1)[0])
    fields = block[1].decode().split(" ")
    if fields != ARC_FIELDS[version]:
        raise ValueError(f"version {version} with unknown fields")
    at = end + 1 + size
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.index(b"\n", at)
        values = dict(zip(fields, data[at:end].decode().split(" "), strict=True))
        size = int(values["Archive-length"])
        if end + 1 + size > len(data):
            raise ValueError(f"a record declares {size} bytes and has {len(data) - end - 1}")
        yield ArcRecord(values["URL"], values["IP-address"], values["Archive-date"], values["Content-type"], data[end + 1 : end + 1 + size])
        at = end + 1 + size


def split_http(content: bytes) -> tuple[bytes, bytes]:
    """(head with its blank line, payload)."""
    at = content.find(b"\r\n\r\n")
    return (content[: at + 4], content[at + 4 :]) if at >= 0 else (b"", content)


def header(head: bytes, name: bytes) -> bytes | None:
    for line in head.split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if colon and key.strip().lower() == name.lower():
            return value.strip()
    return None


def record_id(source: int | None, digest: str, place: str = "") -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'tidemark:{source}:{digest}:{place}')}>"


def iso_date(date: str) -> str:
    """14 digits (fewer are filled up) as YYYY-MM-DDThh:mm:ssZ."""
    d = date[:14] + "19960101000000"[len(date[:14]) :]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def to_warc(r: ArcRecord, source: int | None, digest: str, place: str, first: tuple | None = None) -> bytes:
    """The WARC record of an ARC record; with `first` (source, place, url, date of an equal payload) a revisit."""
    head, _ = split_http(r.content)
    block = head if first else r.content
    fields = [
        ("WARC-Type", "revisit" if first else "response"),
        ("WARC-Record-ID", record_id(source, digest, place)),
        ("WARC-Date", iso_date(r.date)),
        ("WARC-Target-URI", r.url),
        ("WARC-IP-Address", r.ip),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
    ]
    if first:
        fields += [("WARC-Refers-To", record_id(first[0], digest, first[1])), ("WARC-Refers-To-Target-URI", first[2]), ("WARC-Refers-To-Date", iso_date(first[3])), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n" + block + b"\r\n\r\n"


def warc_info(name: str) -> bytes:
    block = b"software: tidemark\r\nformat: WARC File Format 1.1\r\n"
    fields = f"WARC-Type: warcinfo\r\nWARC-Record-ID: {record_id(None, name)}\r\nWARC-Date: 1996-01-01T00:00:00Z\r\nWARC-Filename: {name}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(block)}\r\n\r\n"
    return b"WARC/1.1\r\n" + fields.encode() + block + b"\r\n\r\n"


def read_warc(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of a file of gzip members."""
    waiting = b""
    while True:
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            waiting = waiting or source.read(1 << 20)
            if not waiting:
                if parts:
                    raise ValueError("a record is cut off")
                return
            parts.append(member.decompress(waiting))
            waiting = member.unused_data
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        yield fields, rest[: int(fields["Content-Length"])]


class _Files:
    """A task's files in the shared folder: an attempt's file gets its name only when it is whole."""

    def __init__(self, folder: str, suffix: str) -> None:
        self.store, self.root = store_of(folder)
        self.task, self.suffix, self.done = TaskContext.get(), suffix, []

    @property
    def name(self) -> str:
        return f"{self.task.partitionId():06d}-{len(self.done):04d}{self.suffix}"

    def open(self):
        self.part = f"{self.root}/_{self.name}-{self.task.taskAttemptId()}"
        self.out = self.store.open_output_stream(self.part, compression=None)
        return self.out

    def close(self) -> None:
        self.out.close()
        path = f"{self.root}/{self.name}"
        self.store.move(self.part, path)
        self.done.append(path)

    def paths(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.done, pa.string())], ["path"])


def _folder(spark, label: str) -> str:
    folder = new_path(spark, label)
    store, root = store_of(folder)
    store.create_dir(root, recursive=True)
    return folder


def _dealt(files: DataFrame) -> DataFrame:
    """Paths of files, over all tasks."""
    return files.repartition(partitions(files.sparkSession), "path")


def _as_arc(folder: str, per_file: int) -> BatchFn:
    """Rows (id, url, payload) as ARC files of bounded size, of either version in turn."""

    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        files, held, size, version = _Files(folder, ".arc.gz"), [], 0, 1

        def write() -> None:
            name = files.name
            files.open().write(gzip.compress(write_arc(held, version, name.removesuffix(".gz")), ARC_LEVEL, mtime=0))
            files.close()

        for b in batches:
            for source, url, payload in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2)), strict=True):
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n%s: %s\r\nContent-Length: %d\r\n\r\n" % (SOURCE_HEADER, b"-" if source is None else b"%d" % source, len(payload))
                held.append(ArcRecord(url or "-", "0.0.0.0", "19990101000000", "text/html", head + payload))
                size += len(payload)
                if size >= per_file:
                    write()
                    held, size, version = [], 0, 3 - version
        if held:
            write()
        yield files.paths()

    return run


def write_arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", per_file: int = ARC_BYTES) -> DataFrame:
    """Pages as legacy archives in the shared folder; the files' paths."""
    pages = columns_as(pages, source_id=id_col, url=url_col, payload=payload_col).withColumn("source_id", F.col("source_id").cast("long"))
    return staged(pages.mapInArrow(_as_arc(_folder(pages.sparkSession, "arc"), per_file), "path string"), "arcs")


def records_in(store, path: str) -> Iterator[tuple[int | None, ArcRecord]]:
    """(source id, record) of each record of an ARC file, compressed or not; no id where no header has one."""
    with store.open_input_stream(path, compression=None) as f:
        data = f.read()
    for r in read_arc(gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data):
        s = header(split_http(r.content)[0], SOURCE_HEADER)
        yield (int(s) if s and s.lstrip(b"-").isdigit() else None), r


KNOWN = "path string, no int, source_id long, url string, date string, digest string, n long"


def _digest(uri: str) -> BatchFn:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(uri)
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                for no, (source, r) in enumerate(records_in(store, path)):
                    payload = split_http(r.content)[1]
                    rows.append((path, no, source, r.url, r.date, base32_sha1(payload), len(payload)))
                types = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 7, types, strict=True)], [f.split()[0] for f in KNOWN.split(", ")])

    return run


def _place(path: str, no: int) -> str:
    return f"{path.rpartition('/')[2]}#{no}"


def _convert(uri: str, folder: str) -> BatchFn:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(uri)
        files, out, size = _Files(folder, ".warc.gz"), None, 0

        def put(record: bytes) -> int:
            data = gzip.compress(record, LEVEL, mtime=0)
            out.write(data)
            return len(data)

        for b in batches:
            for row in b.to_pylist():
                marks = {m["no"]: m for m in row["marks"]}
                for no, (source, r) in enumerate(records_in(store, row["path"])):
                    if out is None:
                        out, size = files.open(), 0
                        put(warc_info(files.name))
                    m = marks[no]
                    first = (m["source"], _place(m["path"], m["first_no"]), m["url"], m["date"]) if m["first_no"] is not None else None
                    size += put(to_warc(r, source, m["digest"], _place(row["path"], no), first))
                    if size >= FILE_BYTES:
                        files.close()
                        out = None
        if out is not None:
            files.close()
        yield files.paths()

    return run


def convert_archives(arcs: DataFrame, least: int = 0) -> DataFrame:
    """Writes a WARC record for each record of the ARC files; returns the new files' paths.  Equal payloads
    of at least `least` bytes are kept once."""
    spark = arcs.sparkSession
    uri = shared_dir(spark)
    known = staged(_dealt(arcs).mapInArrow(_digest(uri), KNOWN), "digests")
    # null ids last: a struct's fields are compared in turn
    own = F.struct(F.col("source_id").isNull().alias("unnamed"), "source_id", "url", "date", "path", "no")
    first = staged(known.where(F.col("n") >= least).groupBy("digest", "n").agg(F.min(own).alias("first"), F.count("*").alias("times")), "firsts")
    marked = join_one(known.where(F.col("n") >= least), first, ["digest", "n"], "times", known.count()).unionByName(known.where(F.col("n") < least), allowMissingColumns=True)
    again = ~F.col("first.source_id").eqNullSafe(F.col("source_id")) & F.col("first").isNotNull()
    of = lambda c: F.when(again, F.col(f"first.{c}"))
    marks = marked.groupBy("path").agg(F.collect_list(F.struct("no", "digest", of("source_id").alias("source"), of("path").alias("path"), of("no").alias("first_no"), of("url").alias("url"), of("date").alias("date"))).alias("marks"))  # a file is bounded
    return staged(_dealt(marks).mapInArrow(_convert(uri, _folder(spark, "warc")), "path string"), "files")


def _read(uri: str) -> BatchFn:
    def run(batches: Batches) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(uri)
        names = ["source_id", "n", "digest", "type", "record_id", "refers_to"]
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []
                with store.open_input_stream(path, compression=None) as f:
                    for fields, block in read_warc(f):
                        if fields["WARC-Type"] not in ("response", "revisit"):
                            continue
                        head, payload = split_http(block)
                        source = header(head, SOURCE_HEADER)
                        full = fields["WARC-Type"] == "response"
                        rows.append((None if source in (None, b"-") else int(source), len(payload) if full else int(header(head, b"Content-Length")), base32_sha1(payload) if full else fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To")))
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)], names)

    return run


def read_archives(files: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of the archives' records."""
    spark = files.sparkSession
    rows = staged(_dealt(files).mapInArrow(_read(shared_dir(spark)), "source_id long, n long, digest string, type string, record_id string, refers_to string"), "records")
    first = rows.where("type = 'response'").groupBy("record_id").agg(F.min("source_id").alias("first_id")).withColumnRenamed("record_id", "first_record")
    joined = rows.where("type = 'revisit'").join(first, F.col("refers_to") == F.col("first_record"), "left")
    columns = lambda df, to: df.select(F.col("source_id").alias("page_id"), F.col("n").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), to.alias("refers_to"))
    return columns(joined, F.col("first_id")).union(columns(rows.where("type = 'response'"), F.lit(None).cast("long")))
