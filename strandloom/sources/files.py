"""Python data sources for files that all machines share: references by byte ranges, and one text file in order.

A reference becomes rows by byte range, each range read by a task of its own, so that neither a file nor a line has to
fit into one. An ordered text file is written by all tasks at once, each line at the byte where it belongs.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import Row, StructType

#: Bytes of a range, and letters of a row.
RANGE, PART = 64 << 20, 1 << 16
#: Bytes that are read or written at once.
STEP = 1 << 20


def posix(spark: SparkSession, path: str) -> str | None:
    """The path in the file system that all machines see as folders, or None if only Spark's own readers reach it."""
    if path.startswith("file:"):
        return "/" + path.removeprefix("file:").lstrip("/")
    default = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"  # noqa: SLF001
    return path if "://" not in path and default.startswith("file:") else None


def files_under(path: str) -> list[str]:
    """A file itself, or the files of a folder in order of name, but for those that begin with a dot or underscore."""
    if not os.path.isdir(path):
        return [path]
    return [p for x in sorted(os.listdir(path)) if x[0] not in "._" and os.path.isfile(p := os.path.join(path, x))]


@dataclass
class ByteRange(InputPartition):
    path: str
    number: int
    start: int
    end: int


class ReferenceReader(DataSourceReader):
    def __init__(self, path: str, size: int, part: int):
        self.path, self.size, self.part = path, size, part

    def partitions(self) -> list[ByteRange]:
        """Ranges of each file behind its first line, which is looked for a step at a time."""
        out = []
        for path in files_under(self.path):
            begin, total = 0, os.path.getsize(path)
            with open(path, "rb") as f:
                while block := f.read(STEP):
                    at = block.find(b"\n")
                    begin += at + 1 if at >= 0 else len(block)
                    if at >= 0:
                        break
            out += [ByteRange(path, i, a, min(a + self.size, total)) for i, a in enumerate(range(begin, max(total, begin + 1), self.size))]
        return out

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        """ref_id, range, before (letters of the range before this part), part. A letter belongs to the range that its
        first byte is in. Line breaks are left out; a range without letters has one empty part."""
        held, before, first = b"", 0, True

        def rows(text: str, rest: bool) -> Iterator[pa.RecordBatch]:
            nonlocal before
            stop = len(text) if rest else len(text) - len(text) % self.part
            for i in range(0, stop, self.part):
                piece = text[i : min(i + self.part, stop)]
                yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([partition.number], pa.int64()), pa.array([before], pa.int64()), pa.array([piece])], ["ref_id", "range", "before", "part"])
                before += len(piece)

        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end and (block := f.read(min(STEP, partition.end - at))):
                at += len(block)
                if first:  # what goes on from the range before belongs to it
                    block = block[self.skipped(block) if partition.number else 0 :]  # noqa: PLW2901
                    first = False
                held += block.replace(b"\n", b"")
                whole = len(held) - self.open_bytes(held)
                text = held[:whole].decode()
                keep = len(text) % self.part
                yield from rows(text, False)
                held = text[len(text) - keep :].encode() + held[whole:]
            while self.open_bytes(held) and (byte := f.read(1)):
                held += byte
        if held or not before:
            yield from rows(held.decode() or "", True)
        if not before:
            yield pa.RecordBatch.from_arrays([pa.array([partition.path]), pa.array([partition.number], pa.int64()), pa.array([0], pa.int64()), pa.array([""])], ["ref_id", "range", "before", "part"])

    @staticmethod
    def skipped(block: bytes) -> int:
        return next((i for i, b in enumerate(block[:4]) if b & 0xC0 != 0x80), min(4, len(block)))

    @staticmethod
    def open_bytes(block: bytes) -> int:
        """Bytes at the end that begin a letter of UTF-8 without ending it."""
        for k in range(1, min(4, len(block)) + 1):
            b = block[-k]
            if b & 0xC0 != 0x80:
                return k if k < (1 if b < 0x80 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4) else 0
        return 0


class ReferenceSource(DataSource):
    """Options: path (a file or folder), range (bytes of a range), part (letters of a row)."""

    @classmethod
    def name(cls) -> str:
        return "reference_ranges"

    def schema(self) -> str:
        return "ref_id string, range long, before long, part string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ReferenceReader(self.options["path"], int(self.options.get("range", RANGE)), int(self.options.get("part", PART)))


@dataclass
class Written(WriterCommitMessage):
    end: int


class LineWriter(DataSourceWriter):
    """Writes lines at their offsets into a file beside the one asked for, which takes its place in the end.

    A task that runs again writes the same bytes at the same places. Nothing is seen of a job that fails.
    """

    def __init__(self, path: str):
        self.path, self.temporary = path, f"{path}.{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        held, size, begin, end = [], 0, 0, 0
        out = os.open(self.temporary, os.O_CREAT | os.O_WRONLY, 0o644)
        try:
            for offset, line in iterator:
                raw = line.encode() + b"\n"
                if held and (offset != begin + size or size > STEP):
                    os.pwrite(out, b"".join(held), begin)
                    held, size = [], 0
                if not held:
                    begin = offset
                held.append(raw)
                size += len(raw)
                end = max(end, offset + len(raw))
            if held:
                os.pwrite(out, b"".join(held), begin)
            os.fsync(out)
        finally:
            os.close(out)
        return Written(end)

    def commit(self, messages: list[Written | None]) -> None:
        with open(self.temporary, "ab") as f:
            f.truncate(max((m.end for m in messages if m), default=0))
        os.replace(self.temporary, self.path)

    def abort(self, messages: list[Written | None]) -> None:
        if os.path.exists(self.temporary):
            os.unlink(self.temporary)


class LineSink(DataSource):
    """Option: path. Rows are (offset, line); offsets follow each other without gaps, in any partitions."""

    @classmethod
    def name(cls) -> str:
        return "ordered_lines"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        path = self.options["path"]
        if os.path.isdir(path):
            raise IsADirectoryError(path)
        os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
        return LineWriter(path)
