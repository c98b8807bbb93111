"""Text files that grow and are rotated, as a stream of their complete lines.

The offset of the stream is a byte position for each file. A file is known by
its device, inode and the checksum of its beginning (its first line, or
``HEAD_BYTES`` of it), not by its name: a file that was renamed is read on from
where it was left, and one that was emptied and written anew, or that got the
inode of a deleted one, is read from its start. Positions are ends of lines, so
a line that is still being written waits for its end. Ranges of more than
``part_bytes`` are split over tasks.

Files must lie at the same path for the driver and the tasks, as a mounted log
folder does. Its pattern should match rotated names too, so that the end of a
file is not lost that was rotated between two batches. Names that end in one of
``SKIPPED`` are left out, as compressed copies hold lines read before.
"""

from __future__ import annotations

import glob
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

HEAD_BYTES = 256
PART_BYTES = 64 << 20
READ_BYTES = 4 << 20
SKIPPED = (".gz", ".tmp", ".zst")
SCHEMA = "value string, path string"


class LostLines(RuntimeError):
    """A file is gone whose lines a batch needs."""


@dataclass
class Range(InputPartition):
    """The lines of a file that begin from ``start`` on and before ``stop``; ``first`` is where its batch begins."""

    key: str
    path: str
    first: int
    start: int
    stop: int


def identity(file) -> str | None:
    """What a file is known by; None for one without a complete beginning."""
    head = os.pread(file.fileno(), HEAD_BYTES, 0)
    line = head.find(b"\n")
    if line < 0 and len(head) < HEAD_BYTES:
        return None
    status = os.fstat(file.fileno())
    return f"{status.st_dev}:{status.st_ino}:{zlib.crc32(head[: line + 1] if line >= 0 else head)}"


def last_line_end(file, low: int, size: int) -> int:
    """The end of the last complete line before ``size``, ``low`` if there is none after it."""
    high = size
    while high > low:
        at = max(low, high - (64 << 10))
        found = os.pread(file.fileno(), high - at, at).rfind(b"\n")
        if found >= 0:
            return at + found + 1
        high = at
    return low


def listing(pattern: str) -> dict[str, str]:
    """The path of each file by its identity."""
    out = {}
    for path in sorted(glob.glob(pattern, recursive=True)):
        if path.endswith(SKIPPED) or not os.path.isfile(path):
            continue
        try:
            with open(path, "rb") as file:
                key = identity(file)
        except FileNotFoundError:  # rotated away meanwhile; it is found by its next name
            continue
        if key is not None:
            out[key] = path
    return out


class GrowingText(DataSource):
    """``spark.readStream.format("growing_text").option("path", pattern)``."""

    @classmethod
    def name(cls) -> str:
        return "growing_text"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options):
        self.pattern = options["path"].removeprefix("file://")
        self.part_bytes = int(options.get("part_bytes", PART_BYTES))
        self.fail_on_loss = options.get("fail_on_loss", "true").lower() == "true"
        self.seen: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        """Ends of complete lines; only the new end of a file that grew is looked at."""
        out, seen = {}, {}
        for key, path in listing(self.pattern).items():
            try:
                with open(path, "rb") as file:
                    if identity(file) != key:
                        continue
                    size = os.fstat(file.fileno()).st_size
                    known, end = self.seen.get(key, (0, 0))
                    if size < known:
                        known, end = 0, 0
                    if size > known:
                        end = last_line_end(file, end, size)
            except FileNotFoundError:
                continue
            seen[key] = (size, end)
            out[key] = end
        self.seen = seen
        return out

    def partitions(self, start: dict, end: dict) -> list[Range]:
        paths, out = listing(self.pattern), []
        for key, stop in sorted(end.items()):
            first = start.get(key, 0)
            if stop < first:  # written anew with the same beginning
                first = 0
            if stop <= first:
                continue
            if key not in paths:
                if self.fail_on_loss:
                    raise LostLines(f"a file of {self.pattern} is gone with {stop - first} bytes that were not read")
                continue
            for low in range(first, stop, self.part_bytes):
                out.append(Range(key, paths[key], first, low, min(low + self.part_bytes, stop)))
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        path = partition.path
        try:
            file = open(path, "rb")
            if identity(file) != partition.key:
                file.close()
                raise FileNotFoundError
        except FileNotFoundError:
            path = listing(self.pattern).get(partition.key)
            if path is None:
                if self.fail_on_loss:
                    raise LostLines(f"{partition.path} is gone with lines that were not read") from None
                return
            file = open(path, "rb")
        with file:
            if partition.start > partition.first:  # the line that runs into this part belongs to the one before
                file.seek(partition.start - 1)
                file.readline()
            else:
                file.seek(partition.start)
            while (at := file.tell()) < partition.stop:
                block = file.read(min(READ_BYTES, partition.stop - at))
                if not block.endswith(b"\n"):
                    block += file.readline()
                lines = block.decode("utf-8", "replace").removesuffix("\n").split("\n")
                values = pa.array([line.removesuffix("\r") for line in lines], pa.string())
                yield pa.RecordBatch.from_arrays([values, pa.array([path] * len(lines), pa.string())], names=["value", "path"])

    def commit(self, end: dict) -> None:
        pass
