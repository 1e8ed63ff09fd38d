"""Sources of Spark's own kind: WAV windows read by ranges of frames, and lines that are appended to files.

``register(spark)`` makes them known; then ``spark.read.format("wav_windows")`` and ``spark.readStream.format("appended_lines")`` work from
DataFrames and SQL. Files are opened through ``pyarrow.fs``, on the machine that reads a partition.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

#: Bytes of appended lines that a partition reads, about.
PART_BYTES = 4 << 20


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path there of a URI or of a path on this machine."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def listed(path: str, suffix: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of a folder's files with a suffix, by path; hidden files don't count."""
    system, where = opened(path)
    info = system.get_file_info(where)
    if info.type == pafs.FileType.File:
        return [(path, info.size)]
    if info.type == pafs.FileType.NotFound:
        raise FileNotFoundError(path)
    root = path.rstrip("/")
    found = system.get_file_info(pafs.FileSelector(where, recursive=True))
    names = [(f.path[len(where.rstrip("/")) :], f.size) for f in found if f.type == pafs.FileType.File]
    return sorted((root + n, size) for n, size in names if n.endswith(suffix) and not any(part[:1] in "._" for part in n.strip("/").split("/")))


# windows of WAV files


class WavShape(NamedTuple):
    """Where a file's samples are, and what they are like."""

    rate: int
    channels: int
    width: int
    frames: int
    begin: int


def wav_shape(source) -> WavShape:
    """From the chunks of an open file in front of its samples, which aren't read."""
    source.seek(0)
    riff = source.read(12)
    if len(riff) < 12 or riff[:4] != b"RIFF" or riff[8:] != b"WAVE":
        raise ValueError("not a WAV file")
    shape = None
    while len(head := source.read(8)) == 8:
        name, size = head[:4], struct.unpack("<I", head[4:])[0]
        if name == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack("<HHIIHH", source.read(size)[:16])
            if kind not in (1, 0xFFFE) or bits % 8:
                raise ValueError("only PCM is read")
            shape = rate, channels, bits // 8
        elif name == b"data":
            if shape is None:
                raise ValueError("samples before their format")
            begin, end = source.tell(), source.size()
            return WavShape(*shape, min(size, end - begin) // (shape[1] * shape[2]), begin)
        else:
            source.seek(source.tell() + size + size % 2)
    raise ValueError("no samples")


class Window(InputPartition):
    def __init__(self, path: str, window: int, shape: WavShape, first: int, frames: int) -> None:
        self.path, self.window, self.shape, self.first, self.frames = path, window, tuple(shape), first, frames


_COMPARED = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


class WavReader(DataSourceReader):
    """A partition for each window that the filters on path and window let through; it reads its own frames only."""

    def __init__(self, path: str, seconds: float, schema: pa.Schema) -> None:
        self.path, self.seconds, self.schema = path, seconds, schema
        self.rules: list[tuple[str, object, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if name not in ("path", "window") or not (type(f) in _COMPARED or isinstance(f, In)):
                yield f
            elif isinstance(f, In):
                self.rules.append((name, lambda a, b: a in b, f.value))
            else:
                self.rules.append((name, _COMPARED[type(f)], f.value))

    def _passes(self, name: str, value: object) -> bool:
        return all(rule(value, wanted) for column, rule, wanted in self.rules if column == name)

    def partitions(self) -> Sequence[Window]:
        found = []
        for path, _ in listed(self.path, ".wav"):
            if not self._passes("path", path):
                continue
            system, where = opened(path)
            with system.open_input_file(where) as source:
                shape = wav_shape(source)
            size = max(1, round(self.seconds * shape.rate))
            for k in range(-(-shape.frames // size)):
                if self._passes("window", k):
                    found.append(Window(path, k, shape, k * size, min(size, shape.frames - k * size)))
        return found

    def read(self, partition: Window | None) -> Iterator[pa.RecordBatch]:
        if not isinstance(partition, Window):  # a source without windows
            return
        shape = WavShape(*partition.shape)
        frame = shape.channels * shape.width
        system, where = opened(partition.path)
        with system.open_input_file(where) as source:
            pcm = source.read_at(partition.frames * frame, shape.begin + partition.first * frame)
        row = {"path": partition.path, "window": partition.window, "start": partition.first / shape.rate, "rate": shape.rate, "channels": shape.channels, "width": shape.width, "frames": partition.frames, "pcm": pcm}
        yield pa.RecordBatch.from_pylist([row], self.schema)


class WavWindows(DataSource):
    """Options: path (a file or folder) and seconds (of a window, 30 by default)."""

    @classmethod
    def name(cls) -> str:
        return "wav_windows"

    def schema(self) -> str:
        return "path string, window int, start double, rate int, channels int, width int, frames long, pcm binary"

    def reader(self, schema) -> WavReader:
        from pyspark.sql.pandas.types import to_arrow_schema

        return WavReader(self.options["path"], float(self.options.get("seconds", 30)), to_arrow_schema(schema))


# appended lines


class Lines(InputPartition):
    def __init__(self, path: str, begin: int, end: int) -> None:
        self.path, self.begin, self.end = path, begin, end


def whole_lines(path: str, begin: int, end: int) -> int:
    """Where the last whole line before end ends, begin if there is none; the file is read backwards, a piece at a time."""
    system, where = opened(path)
    with system.open_input_file(where) as source:
        at = end
        while at > begin:
            low = max(begin, at - (1 << 16))
            found = source.read_at(at - low, low).rfind(b"\n")
            if found >= 0:
                return low + found + 1
            at = low
    return begin


class LinesReader(DataSourceStreamReader):
    """Offsets are bytes read of each file; a line counts once its line feed is there. Files may grow and come; one that shrinks is an error."""

    def __init__(self, path: str, part_bytes: int) -> None:
        self.path, self.part_bytes = path, part_bytes

    def initialOffset(self) -> dict:  # noqa: N802
        return {"files": "{}"}

    def latestOffset(self) -> dict:  # noqa: N802
        return {"files": json.dumps({path: size for path, size in listed(self.path, "")}, sort_keys=True)}

    def partitions(self, start: dict, end: dict) -> Sequence[Lines]:
        was, now = json.loads(start["files"]), json.loads(end["files"])
        found = []
        for path, size in now.items():
            begin = was.get(path, 0)
            if size < begin:
                raise ValueError(f"{path} has shrunk from {begin} to {size} bytes")
            # a line that was cut at begin is read from its own beginning now, one that is cut at the end is left for the next batch
            begin = whole_lines(path, 0, begin) if begin else 0
            end_ = whole_lines(path, begin, size)
            while begin < end_:
                stop = end_ if end_ - begin <= self.part_bytes else whole_lines(path, begin, begin + self.part_bytes)
                if stop == begin:  # a line longer than a part: as far as the next line feed
                    stop = self._line_end(path, begin + self.part_bytes, end_)
                found.append(Lines(path, begin, stop))
                begin = stop
        return found

    @staticmethod
    def _line_end(path: str, at: int, end: int) -> int:
        system, where = opened(path)
        with system.open_input_file(where) as source:
            while at < end:
                found = source.read_at(min(1 << 16, end - at), at).find(b"\n")
                if found >= 0:
                    return at + found + 1
                at += 1 << 16
        return end

    def read(self, partition: Lines) -> Iterator[tuple]:
        system, where = opened(partition.path)
        with system.open_input_file(where) as source:
            data = source.read_at(partition.end - partition.begin, partition.begin)
        at = partition.begin
        for line in data.split(b"\n")[:-1]:
            yield partition.path, at, line.removesuffix(b"\r").decode("utf-8", "replace")
            at += len(line) + 1

    def commit(self, end: dict) -> None:
        pass


class AppendedLines(DataSource):
    """Options: path (a file or folder) and part_bytes. Rows: path, place (the byte that a line begins at), line."""

    @classmethod
    def name(cls) -> str:
        return "appended_lines"

    def schema(self) -> str:
        return "path string, place long, line string"

    def streamReader(self, schema) -> LinesReader:  # noqa: N802
        return LinesReader(self.options["path"], int(self.options.get("part_bytes", PART_BYTES)))


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, and let filters reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for source in (WavWindows, AppendedLines):
        spark.dataSource.register(source)
