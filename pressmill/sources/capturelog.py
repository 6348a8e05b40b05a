"""Capture logs as a data source: batches by byte ranges, streams that follow growing files.

The source only finds lines and moves bytes; ``match.parse_capture_lines`` takes them
apart in the JVM.  ``CaptureLog`` reads what the Arrow file systems reach (local, HDFS,
object stores); for other stores ``files.read_capture_log`` has Spark's text reader."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SPLIT_BYTES, CHUNK_BYTES = 64 << 20, 1 << 20
SCHEMA = "value string, path string, at bigint"
_ARROW = pa.schema([("value", pa.string()), ("path", pa.string()), ("at", pa.int64())])


class Range(InputPartition):
    """The lines of a file that begin in ``start`` to ``end``."""

    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files_of(path: str) -> dict[str, int]:
    """Sizes of the files at ``path`` (a file or a folder), by their place below it."""
    system, place = _opened(path)
    info = system.get_file_info(place)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(place, recursive=True, allow_not_found=True))
    hidden = lambda p: any(part[:1] in "._" for part in p[len(place) :].split("/") if part)
    return {f.path: f.size for f in sorted(found, key=lambda f: f.path) if f.type == fs.FileType.File and (f.path == place or not hidden(f.path))}


def ranges(path: str, start: int, end: int, split_bytes: int) -> list[Range]:
    return [Range(path, low, min(low + split_bytes, end)) for low in range(start, end, split_bytes)]


def lines_of(root: str, part: Range, chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[list[bytes], list[int]]]:
    """The lines that begin in a range, and where, chunk by chunk.

    A range that doesn't begin a file begins after the first line end from the byte before
    it on; the last line goes on beyond the range's end."""
    system, _ = _opened(root)
    with system.open_input_file(part.path) as f:
        at = max(part.start - 1, 0)
        f.seek(at)
        rest, skip = b"", part.start > 0
        while True:
            data = f.read(chunk_bytes)
            lines = (rest + data).split(b"\n")
            rest = lines.pop() if data else b""
            if not data and lines == [b""]:
                return
            places = []
            for line in lines:
                places.append(at)
                at += len(line) + 1
            if skip and lines:
                lines, places, skip = lines[1:], places[1:], False
            own = sum(p < part.end for p in places)
            yield lines[:own], places[:own]
            if not data or own < len(places) or at >= part.end:
                return


def batches_of(root: str, part: Range) -> Iterator[pa.RecordBatch]:
    for lines, places in lines_of(root, part):
        if lines:
            yield pa.RecordBatch.from_arrays([pa.array([x.decode("utf-8", "replace") for x in lines], pa.string()), pa.array([part.path] * len(lines), pa.string()), pa.array(places, pa.int64())], schema=_ARROW)


class CaptureLog(DataSource):
    """``spark.read.format("capture_log").load(path)`` and the same of a stream; a row has
    a line, its file and where in it the line begins.  Option ``splitBytes``."""

    @classmethod
    def name(cls) -> str:
        return "capture_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))

    def streamReader(self, schema):
        return _StreamReader(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)))


class _Reader(DataSourceReader):
    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def partitions(self):
        return [r for path, size in files_of(self.path).items() for r in ranges(path, 0, size, self.split_bytes)] or [Range("", 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from batches_of(self.path, partition)


class _StreamReader(DataSourceStreamReader):
    """Follows files that are added or grow; a line counts once its end is written, so
    each is read in one batch only.  An offset has the bytes read of every file."""

    def __init__(self, path: str, split_bytes: int):
        self.path, self.split_bytes = path, split_bytes

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {path: n for path, size in files_of(self.path).items() if (n := self._whole(path, size))}

    def _whole(self, path: str, size: int) -> int:
        """The bytes up to the last line end."""
        system, _ = _opened(self.path)
        with system.open_input_file(path) as f:
            while size:
                low = max(0, size - CHUNK_BYTES)
                f.seek(low)
                end = f.read(size - low).rfind(b"\n")
                if end >= 0:
                    return low + end + 1
                size = low
        return 0

    def partitions(self, start, end):
        return [r for path, n in sorted(end.items()) for r in ranges(path, start.get(path, 0), n, self.split_bytes)] or [Range("", 0, 0)]

    def read(self, partition):
        if partition.path:
            yield from batches_of(self.path, partition)


def register(spark) -> None:
    spark.dataSource.register(CaptureLog)
