"""A data source of file headers: each file is read to the end of its header and no further, or once through for its hash too."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from fnmatch import fnmatch
from typing import NamedTuple

from pyarrow.fs import FileSelector, FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file_path string, file_name string, lines array<string>, bytes_read long, size_bytes long, file_hash string"
#: Bytes that opening a file counts for when files are dealt to tasks.
OPENING = 1 << 20


class Files(InputPartition):
    def __init__(self, paths: list[tuple[str, int]]):
        self.paths = paths


class Header(NamedTuple):
    text: bytes
    bytes_read: int
    file_hash: str | None


def _whole(path: str) -> str:
    """A path as a URI; one without scheme is local."""
    return path if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", path) else f"file://{path}"


def _system(path: str) -> tuple[FileSystem, str, str]:
    """(file system, path in it, what stands before such a path in Spark's paths); the path of a local file isn't decoded."""
    if path.startswith("file:"):
        return FileSystem.from_uri("file:///")[0], "/" + path.removeprefix("file:").lstrip("/"), ""
    system, at = FileSystem.from_uri(path)
    return system, at, path[: len(path) - len(at)] if path.endswith(at) else ""


def _inflated(state: list, data: bytes, most: int) -> bytes:
    """What gzip data add, most bytes of it at most; members follow each other, and what follows the last is ignored."""
    out = bytearray()
    while data and len(out) < most:
        try:
            out += state[0].decompress(data, most - len(out))
        except zlib.error:
            break
        if not state[0].eof:
            data = state[0].unconsumed_tail
            continue
        data, state[0] = state[0].unused_data, zlib.decompressobj(zlib.MAX_WBITS | 32)
    return bytes(out)


def read_header(source, end: bytes, compressed: bool, most: int, chunk: int, with_hash: bool) -> Header:
    """What source (a file that is open for reading) holds up to the line with end, most bytes at most; with_hash: and the SHA-256 of all its bytes, read in the same pass."""
    digest = hashlib.sha256() if with_hash else None
    inflate = [zlib.decompressobj(zlib.MAX_WBITS | 32)]
    text, read, done = bytearray(), 0, False
    while data := source.read(chunk):
        read += len(data)
        if digest is not None:
            digest.update(data)
        if not done:
            begin = max(0, len(text) - len(end))
            text += _inflated(inflate, data, most) if compressed else data
            at = text.find(end, begin)
            line = text.find(b"\n", at) if at >= 0 else -1
            if line >= 0:
                del text[line:]
            done = line >= 0 or len(text) >= most
        if done and digest is None:
            break
    return Header(bytes(text[:most]), read, digest.hexdigest() if digest is not None else None)


class HeaderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.glob = _whole(options["path"]), options.get("pathglobfilter")
        self.end = options.get("end", "END OF HEADER").encode()
        self.most, self.chunk = int(options.get("most", 1 << 20)), int(options.get("chunk", 1 << 16))
        self.with_hash = options.get("hash", "false") == "true"
        self.task_bytes = int(options.get("taskbytes", 1 << 27))

    def partitions(self) -> list[InputPartition]:
        """Files by name order, task_bytes of what is read of them to a task; names that begin with a dot or underscore are skipped, as everywhere in Spark."""
        system, at, _ = _system(self.path)
        info = system.get_file_info(at)
        found = [info] if info.type == FileType.File else system.get_file_info(FileSelector(at, recursive=True))
        hidden = lambda path: any(x[:1] in "._" for x in path[len(at) :].split("/") if x)
        files = sorted((f.path, f.size) for f in found if f.type == FileType.File and (not self.glob or fnmatch(f.base_name, self.glob)) and not hidden(f.path))
        out: list[InputPartition] = []
        own, held = [], 0
        for path, size in files:
            if own and held >= self.task_bytes:
                out.append(Files(own))
                own, held = [], 0
            own.append((path, size))
            held += OPENING + (size if self.with_hash else min(size, self.chunk))
        return [*out, Files(own)]

    def read(self, partition: Files) -> Iterator[tuple]:
        system, _, before = _system(self.path)
        for path, size in partition.paths:
            with system.open_input_file(path) as source:
                header = read_header(source, self.end, path.lower().endswith(".gz"), self.most, min(self.chunk, 1 << 20) if not self.with_hash else max(self.chunk, 1 << 20), self.with_hash)
            lines = header.text.decode("utf-8", "replace").split("\n")
            yield (before + path, path.rsplit("/", 1)[-1], [line.removesuffix("\r") for line in lines], header.bytes_read, size, header.file_hash)


class ObservationHeaders(DataSource):
    """Format observation_headers: file_path, file_name, the lines of the header, bytes_read, size_bytes, and file_hash (SHA-256, in lower-case hex) if asked for.

    Options: path (a folder, with all below it, or a file, on any file system that pyarrow knows), pathGlobFilter, hash (true: files are
    read to their ends, once), end (what stands in a header's last line), most (bytes of a header; a file without that line
    has so many), chunk (bytes of a read), taskBytes. Files ending in .gz are inflated.
    """

    @classmethod
    def name(cls) -> str:
        return "observation_headers"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return HeaderReader({k.lower(): v for k, v in self.options.items()})


def read_headers(spark: SparkSession, path: str, glob: str | None = None, with_hash: bool = False, **options) -> DataFrame:
    """The rows of ObservationHeaders."""
    spark.dataSource.register(ObservationHeaders)
    reader = spark.read.format("observation_headers").option("hash", str(with_hash).lower())
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return reader.options(**options).load(path)
