"""Growing text files as a stream of their complete lines.

The driver plans offsets only: a micro-batch goes, in each file, from the last offset to the last
line end within what a batch may have. Ranges of bytes are dealt to tasks, which open the files
themselves and cut at line ends, so no line passes the driver. The same offsets give the same rows, so a
batch that is repeated after a failure is the same. A file that has shrunk is an error, and a line
without its end waits.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that one task reads, and that a micro-batch has at most; what is left comes with the next ones.
SPLIT, BATCH = 8 << 20, 1 << 30
#: Bytes in which a line end is looked for at once.
LOOK = 1 << 16


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path and the path in it; a path without a scheme is one of this machine."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def sizes(path: str) -> dict[str, int]:
    """Bytes of a file, or of each file of a folder; names that begin with a dot or an underscore are passed over."""
    fs, inner = opened(path)
    scheme = path[: len(path) - len(inner)] if path.endswith(inner) else ""
    found = fs.get_file_info(inner)
    if found.type == pafs.FileType.File:
        return {path: found.size}
    infos = fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True))
    return {scheme + f.path: f.size for f in infos if f.type == pafs.FileType.File and f.base_name[0] not in "._"}


def line_end(f: pa.NativeFile, start: int, limit: int, size: int) -> int:
    """The offset after the last line end in [start, limit); if there is none, after the first one behind; ``start`` if no line is complete."""
    at = limit
    while at > start:
        a = max(start, at - LOOK)
        f.seek(a)
        if (k := f.read(at - a).rfind(b"\n")) >= 0:
            return a + k + 1
        at = a
    at = limit
    while at < size:
        f.seek(at)
        part = f.read(min(LOOK, size - at))
        if (k := part.find(b"\n")) >= 0:
            return at + k + 1
        at += len(part)
    return start


@dataclass
class Range(InputPartition):
    """The lines of a file that begin in [start, stop); those before ``end`` are complete."""

    file: str
    start: int
    stop: int
    first: bool
    end: int


def lines_of(part: Range) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the lines that begin in a range, without their ends."""
    fs, inner = opened(part.file)
    with fs.open_input_file(inner) as f:
        f.seek(part.start if part.first else part.start - 1)
        raw, at = f.read(part.stop - f.tell()), part.start if part.first else part.start - 1
        while not raw.endswith(b"\n") and at + len(raw) < part.end:  # the last line reaches over
            more = f.read(min(LOOK, part.end - at - len(raw)))
            k = more.find(b"\n")
            raw += more if k < 0 else more[: k + 1]
            if k >= 0:
                break
    if not part.first:  # the line that began before belongs to the range ahead
        skip = raw.find(b"\n") + 1
        raw, at = raw[skip:], at + skip
    if at >= part.stop:
        return
    for line in raw.split(b"\n")[:-1]:
        yield at, line
        at += len(line) + 1


class TailReader(DataSourceStreamReader):
    def __init__(self, path: str, encoding: str, split: int, batch: int):
        self.path, self.encoding, self.split, self.batch = path, encoding, split, batch
        #: where the planned batches end; not known to a query that goes on from its checkpoint until its first batch
        self.at: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        self.at = {}
        return {}

    def latestOffset(self) -> dict:
        out, left = dict(self.at or {}), self.batch if self.at is not None else None
        for file, size in sorted(sizes(self.path).items()):
            start = out.get(file, 0)
            if size < start:
                raise ValueError(f"{file} has shrunk from {start} to {size} bytes")
            limit = size if left is None else min(size, start + left)
            if limit <= start:
                continue
            fs, inner = opened(file)
            with fs.open_input_file(inner) as f:
                end = line_end(f, start, limit, size)
            if end > start:
                out[file] = end
                left = None if left is None else max(0, left - (end - start))
        if gone := set(self.at or {}) - set(sizes(self.path)):
            raise ValueError(f"{min(gone)} is gone")
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        self.at = dict(end)
        out = []
        for file, stop in sorted(end.items()):
            first = start.get(file, 0)
            out += [Range(file, a, min(a + self.split, stop), a == first, stop) for a in range(first, stop, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        at, lines = [], []

        def batch() -> pa.RecordBatch:
            text = [x.removesuffix(b"\r").decode(self.encoding, "replace") for x in lines]
            return pa.RecordBatch.from_arrays([pa.array([partition.file] * len(at)), pa.array(at, pa.int64()), pa.array(text, pa.string())], ["file", "offset", "line"])

        for offset, line in lines_of(partition):
            at.append(offset)
            lines.append(line)
            if len(at) == 10_000:
                yield batch()
                at, lines = [], []
        if at:
            yield batch()


class TailSource(DataSource):
    """``spark.readStream.format("tail").option("path", file or folder).load()``: file, byte offset and text of each complete line.

    Options: ``encoding`` (one in which a line feed is one byte), ``splitBytes`` of a task and
    ``batchBytes`` of a micro-batch. A query that goes on from its checkpoint has no such limit in its first
    batch, which is split like others. Paths are those of pyarrow's file systems (local, HDFS, S3, GCS).
    """

    @classmethod
    def name(cls) -> str:
        return "tail"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def streamReader(self, schema) -> TailReader:
        o = self.options
        return TailReader(o["path"], o.get("encoding", "utf-8"), int(o.get("splitBytes", SPLIT)), int(o.get("batchBytes", BATCH)))
