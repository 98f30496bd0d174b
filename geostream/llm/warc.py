"""WARC archives: written with an index, read back by coalesced byte ranges.

Pages are put in the shared folder with the digest of their payload; of records with equal payloads one is a response, the
others revisit it. Each task then writes its records, each a gzip member of its own, to archives of its own, and returns an
index row for each: file, offset, length, URL, digest. Readers select index rows first; rows of a file in order of offset
become a few long reads.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostream.llm.common import scratch, stage

#: Fixed values of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RESPONSE, REVISIT = "response", "revisit"
INDEX = "file string, offset long, length long, page_id long, url string, record_type string, payload_digest string"
RECORD = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, target_uri string, payload binary"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    """Rows that share a page_id, or have none, still have ids of their own."""
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def page_of(record: str) -> int | None:
    number = record.strip("<>").split(":")[2]
    return int(number) if number else None


def header_value(text: str) -> str:
    """text with what would end or split a header line percent-encoded: blanks, control characters and all beyond ASCII."""
    return "".join(chr(b) if 0x20 < b < 0x7F else f"%{b:02X}" for b in text.encode("utf-8", "surrogatepass"))


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return b"\r\n".join([VERSION, *[f"{k}: {v}".encode() for k, v in lines], b"", block]) + b"\r\n\r\n"


def page_record(page_id: int | None, row: int, url: str | None, size: int, digest: str, payload: bytes | None, refers_to: str | None, date: str) -> bytes:
    """A response with its payload, or a revisit (payload None) with the HTTP headers alone, which tell the payload's size."""
    own = [("WARC-Record-ID", record_id(page_id, row)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha1:{digest}")]
    own += [("WARC-Target-URI", header_value(url))] if url is not None else []
    own += [("WARC-Refers-To", refers_to), ("WARC-Profile", PROFILE)] if refers_to is not None else []
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return warc_record(REVISIT if payload is None else RESPONSE, [*own, ("Content-Type", "application/http; msgtype=response")], http + (payload or b""))


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record; one that isn't whole is an error."""
    head, mark, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not mark or not lines[0].startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.decode().lower(): v.decode().strip() for k, _, v in (line.partition(b":") for line in lines[1:])}
    size = int(headers["content-length"])
    if len(rest) != size + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("the record's block doesn't have its length")
    return headers, rest[:size]


def http_parts(block: bytes) -> tuple[dict[str, str], bytes]:
    head, _, body = block.partition(b"\r\n\r\n")
    return {k.decode().lower(): v.decode().strip() for k, _, v in (line.partition(b":") for line in head.split(b"\r\n")[1:])}, body


class _Archive:
    """An archive that is being written; its name is new for each attempt of a task, so that nothing is written twice."""

    def __init__(self, folder: str, date: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        system, at = FileSystem.from_uri(self.path)
        self.out, self.size = system.open_output_stream(at, compression=None), 0
        self.add(warc_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))

    def add(self, record: bytes) -> tuple[int, int]:
        """(offset, length) of the record's gzip member."""
        member, offset = gzip.compress(record, 6, mtime=0), self.size
        self.out.write(member)
        self.size += len(member)
        return offset, len(member)


def _write(folder: str, file_bytes: int, date: str):
    def run(batches):
        archive = None
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for row, page, url, size, sha, refers, refers_row, text in zip(*(c.to_pylist() for c in batch.columns)):
                if archive is None or archive.size >= file_bytes:
                    if archive is not None:
                        archive.out.close()
                    archive = _Archive(folder, date)
                digest = base64.b32encode(sha).decode()
                known = refers_row is not None
                record = page_record(page, row, url, size, digest, None if known else text, record_id(refers, refers_row) if known else None, date)
                for column, value in zip(out, (archive.path, *archive.add(record), page, url, REVISIT if known else RESPONSE, digest)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()))], [x.split()[0] for x in INDEX.split(", ")])
        if archive is not None:
            archive.out.close()

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 0, file_bytes: int = 1 << 30, date: str = "1970-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write a record for each page into archives under folder, a URI that all machines reach, and return the index: file, offset, length, page_id, url, record_type, payload_digest.

    The payload is the html in UTF-8, a null one empty. Of records with equal payloads of at least least bytes the one with
    the largest page_id is the response (a null page_id is smaller than any other; of repeated rows one), the others are revisits
    of it, without payload; payloads below least are responses. A null url leaves its header out; one with blanks, line
    ends or letters beyond ASCII has them percent-encoded in the header and as it is in the index. No pages: no archive.
    Other columns are ignored. The index is a table in the shared folder: it names only archives that tasks have
    finished, what lost attempts leave is named nowhere. An archive is closed at file_bytes, each record fits a task's memory.

    Payloads are stored once with their digests, so that a retried task finds the same rows. Only groups of two or more
    equal payloads are joined back, from a table whose size Spark knows: few are broadcast, many join with hot
    groups split.
    """
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    kept = stage(rows.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", F.length("payload").cast("long").alias("size"), F.unhex(F.sha1("payload")).alias("sha"), F.unhex(F.sha2("payload", 256)).alias("key"), "payload"), "warc-pages")
    winner = F.max(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id", "row")).alias("w")
    groups = kept.filter(F.col("size") >= least).groupBy("key").agg(F.count("*").alias("n"), winner)
    shared = stage(groups.filter("n > 1").select("key", F.col("w.page_id").alias("refers_to"), F.col("w.row").alias("refers_row")), "warc-groups")
    joined = kept.join(shared, "key", "left")
    again = F.col("refers_row").isNotNull() & (F.col("row") != F.col("refers_row"))
    ready = joined.select("row", "page_id", "url", "size", "sha", F.when(again, F.col("refers_to")).alias("refers_to"), F.when(again, F.col("refers_row")).alias("refers_row"), F.when(~again, F.col("payload")).alias("payload"))
    return stage(ready.mapInArrow(_write(folder, file_bytes, date), INDEX), "warc-index")


def _ranges(rows: list[tuple[int, int]], gap: int, most: int) -> Iterator[tuple[int, int]]:
    """Runs [first, last) of rows (offset, length) in order that one read covers: no more than gap bytes apart, most bytes long unless a row is longer."""
    first = 0
    while first < len(rows):
        last, end = first + 1, rows[first][0] + rows[first][1]
        while last < len(rows) and rows[last][0] - end <= gap and rows[last][0] + rows[last][1] - rows[first][0] <= most:
            end = max(end, rows[last][0] + rows[last][1])
            last += 1
        yield first, last
        first = last


def _read(gap: int, most: int):
    names = [x.split()[0] for x in RECORD.split(", ")]
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary())

    def records(path: str, rows: list[tuple[int, int]], source) -> Iterator[pa.RecordBatch]:
        for first, last in _ranges(rows, gap, most):
            begin, end = rows[first][0], max(o + n for o, n in rows[first:last])
            source.seek(begin)
            data, out = source.read(end - begin), []
            for offset, length in rows[first:last]:
                headers, block = parse_record(gzip.decompress(data[offset - begin : offset - begin + length]))
                http, body = http_parts(block)
                kind, digest = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha1:")
                if kind == RESPONSE and base32_sha1(body) != digest:
                    raise ValueError(f"payload digest differs in {path} at {offset}")
                refers = headers.get("warc-refers-to")
                out.append((page_of(headers["warc-record-id"]), kind, int(http["content-length"]), digest, page_of(refers) if refers else None, headers.get("warc-target-uri"), body if kind == RESPONSE else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    def run(batches):
        path, source = None, None
        for batch in batches:
            files, offsets, lengths = (batch.column(c).to_pylist() for c in ("file", "offset", "length"))
            at = 0
            while at < len(files):
                end = next((i for i in range(at, len(files)) if files[i] != files[at]), len(files))
                if files[at] != path:
                    if source is not None:
                        source.close()
                    path = files[at]
                    system, place = FileSystem.from_uri(path)
                    source = system.open_input_file(place)
                yield from records(path, list(zip(offsets[at:end], lengths[at:end])), source)
                at = end
        if source is not None:
            source.close()

    return run


def read_archives(index: DataFrame, gap: int = 1 << 16, most: int = 1 << 25, task_bytes: int = 1 << 27) -> DataFrame:
    """page_id, record_type, payload_bytes, payload_digest, refers_to, target_uri, payload of the records of index rows (file, offset, length).

    All columns come from the archives: bytes and digest of the full payload, of a revisit too, whose payload is null. The
    rows are dealt by ranges of file and offset and sorted, task_bytes of archives to a task, so that it reads stretches of files: records no more than gap bytes
    apart are one read of at most most bytes (or one record). A response whose payload has another digest than its header is an error.
    No rows: no records; repeated rows are read each.
    """
    total = index.agg(F.sum("length")).first()[0] or 0
    tasks = max(index.sparkSession.sparkContext.defaultParallelism, total // task_bytes)
    ranged = index.select("file", "offset", "length").repartitionByRange(int(tasks), "file", "offset").sortWithinPartitions("file", "offset")
    return ranged.mapInArrow(_read(gap, most), RECORD)


def shared_uri(spark: SparkSession, path: str) -> str:
    """path as a URI that names its file system, as Spark resolves it, for readers and writers outside Spark."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    whole = there.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(there).toString()
    return "file:///" + whole.removeprefix("file:").lstrip("/") if whole.startswith("file:") else whole


def archive_pages(pages: DataFrame, least: int = 0, **params) -> DataFrame:
    """The records of pages, written to archives in the shared folder and read back; see write_archives and read_archives."""
    return read_archives(write_archives(pages, shared_uri(pages.sparkSession, scratch(pages.sparkSession, "warc")), least, **params))
