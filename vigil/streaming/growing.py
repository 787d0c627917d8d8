"""Growing log files as a stream: a Python data source of appended lines.

A receiver appends to one file a day and kind, and rotates or replaces files.
Spark's file source reads a file once; this source keeps, per file, how many
bytes have been read.  An offset maps a file's name to the identity of its
content (a digest of its first line) and the end of its last whole line, so

* appended lines arrive once, also across a restart from the checkpoint;
* a line that is still being written waits for its line end;
* a file that was rotated goes on under its new name from where it was read,
  and the new file of the old name starts at 0;
* a file that became shorter was written anew and starts at 0.

A batch is a set of byte ranges; long ones are cut into parts that tasks read
side by side, each taking the lines that begin in its part.  A range whose
file was renamed after planning is found by its identity; if it is gone, the
batch fails rather than lose lines.

Limits: files are opened with ``pyarrow.fs``, so their store must be one that it
knows (local, HDFS, S3, GCS; ``file:`` and ``hdfs:`` URIs or paths).  Files of
equal first lines (CSV headers) are told apart by name alone and must not be
renamed.  An offset holds one entry for each file in the folder: old files are
to be moved out of it.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Longest first line that identifies a file, bytes looked at at once, bytes of a task, lines of a batch.
HEAD, BLOCK, PART_BYTES, BATCH_LINES = 1 << 16, 1 << 20, 64 << 20, 10_000
SCHEMA = "path string, start bigint, value string"


def open_store(path: str):
    """(file system, folder inside it)."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri("file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path)
    return fs.LocalFileSystem(), path


def identity(f) -> str | None:
    """Digest of the first whole line; None as long as there is none."""
    f.seek(0)
    head = f.read(HEAD)
    end = head.find(b"\n")
    if end < 0 and len(head) < HEAD:
        return None
    return hashlib.sha256(head[:end + 1] if end >= 0 else head).hexdigest()[:24]


def whole_lines(f, size: int) -> int:
    """The end of the last whole line among the first ``size`` bytes."""
    at = size
    while at > 0:
        low = max(0, at - BLOCK)
        f.seek(low)
        found = f.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def ranges(start: dict, end: dict) -> list[tuple[str, str, int, int]]:
    """(name, identity, from, to) of what is new between two offsets."""
    out = []
    for name, (ident, to) in sorted(end.items()):
        had = start.get(name)
        if had and had[0] == ident:
            low = had[1] if had[1] <= to else 0  # shorter: written anew
        else:
            # Renamed: its content was known under a name that now holds another file, or none.
            moved = [s[1] for n, s in start.items() if s[0] == ident and s[1] <= to and (n not in end or end[n][0] != ident)]
            low = max(moved, default=0)
        if low < to:
            out.append((name, ident, low, to))
    return out


@dataclass
class Part(InputPartition):
    """Lines that begin in ``start`` <= byte < ``stop``; the range's whole lines are ``low`` to ``high``."""

    name: str
    ident: str
    start: int
    stop: int
    low: int
    high: int


class GrowingReader(DataSourceStreamReader):
    def __init__(self, path: str, pattern: str, part_bytes: int):
        self.path, self.pattern, self.part_bytes = path, pattern, part_bytes

    def files(self) -> list:
        from pyarrow import fs

        store, folder = open_store(self.path)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return [(store, i) for i in found if i.type == fs.FileType.File and fnmatch.fnmatch(i.base_name, self.pattern)
                and not i.base_name.startswith((".", "_"))]

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        out = {}
        for store, info in self.files():
            try:
                with store.open_input_file(info.path) as f:
                    ident = identity(f)
                    if ident is not None:
                        out[info.base_name] = [ident, whole_lines(f, f.size())]
            except FileNotFoundError:
                continue  # renamed since it was listed: the next offset has it
        return out

    def partitions(self, start: dict, end: dict) -> list[Part]:
        parts = []
        for name, ident, low, high in ranges(start, end):
            for at in range(low, high, self.part_bytes):
                parts.append(Part(name, ident, at, min(at + self.part_bytes, high), low, high))
        return parts

    def opened(self, part: Part):
        """The part's file, by its name or else by its content."""
        files = {i.base_name: (store, i) for store, i in self.files()}
        for name in [part.name, *sorted(n for n in files if n != part.name)]:
            if name in files:
                store, info = files[name]
                f = store.open_input_file(info.path)
                if identity(f) == part.ident and f.size() >= part.high:
                    return f
                f.close()
        raise FileNotFoundError(f"{self.path}/{part.name} was replaced or shortened before bytes {part.low} to {part.high} were read")

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        with self.opened(part) as f:
            at = part.start
            if at > part.low:
                # A line belongs to the part it begins in: go to the first one.
                f.seek(at - 1)
                at = at - 1 + self.skip(f, part.high - at + 1)
            f.seek(at)
            starts, lines, rest, rest_at, pos = [], [], b"", at, at
            while pos < part.high and rest_at < part.stop:
                block = f.read(min(BLOCK, part.high - pos))
                if not block:
                    raise EOFError(f"{self.path}/{part.name} became shorter while it was read")
                pos += len(block)
                *found, rest = (rest + block).split(b"\n") if rest else block.split(b"\n")
                for line in found:
                    if rest_at >= part.stop:
                        break
                    starts.append(rest_at)
                    lines.append(line.rstrip(b"\r").decode("utf-8", "replace"))
                    rest_at += len(line) + 1
                    if len(lines) == BATCH_LINES:
                        yield self.batch(part, starts, lines)
                        starts, lines = [], []
            if lines:
                yield self.batch(part, starts, lines)

    @staticmethod
    def skip(f, most: int) -> int:
        """Bytes up to and with the next line end."""
        done = 0
        while done < most:
            block = f.read(min(BLOCK, most - done))
            found = block.find(b"\n")
            if found >= 0:
                return done + found + 1
            done += len(block)
            if not block:
                break
        return done

    @staticmethod
    def batch(part: Part, starts: list[int], lines: list[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part.name] * len(lines), pa.string()), pa.array(starts, pa.int64()),
                                           pa.array(lines, pa.string())], names=["path", "start", "value"])


class GrowingLines(DataSource):
    """``readStream.format("growing_lines")``: options ``path``, ``pattern``, ``partBytes``."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> GrowingReader:
        return GrowingReader(self.options["path"], self.options.get("pattern", "*"), int(self.options.get("partbytes", PART_BYTES)))


def growing_lines(spark: SparkSession, path: str, pattern: str = "*", part_bytes: int = PART_BYTES) -> DataFrame:
    """Lines appended to the files of a folder: (``path``, ``start`` byte, ``value``)."""
    spark.dataSource.register(GrowingLines)
    reader = spark.readStream.format("growing_lines").option("path", path).option("pattern", pattern)
    return reader.option("partBytes", part_bytes).load()


def growing_events(spark: SparkSession, path: str, pattern: str = "*.ndjson*", schema=None, part_bytes: int = PART_BYTES) -> DataFrame:
    """``stream_events`` over growing NDJSON files: parsed envelope rows, with
    the name of the file and the place of the line in it."""
    from vigil.sources.files import parse_ndjson, typed_events

    return typed_events(parse_ndjson(growing_lines(spark, path, pattern, part_bytes), schema))
