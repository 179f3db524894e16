"""Streaming source for files that keep growing.

Spark's file source takes a file once; this one follows appended bytes.  The
offset of the stream is the number of bytes taken per file, beside a hash of
the file's head.  A batch is cut into byte ranges that executors read on their
own in large blocks and hand on as Arrow batches, so a large backlog is read in
parallel.  A file whose head changed was rotated and is read from its start; the
old one goes on under its new name if that is followed too.  Only whole lines
are taken.

Options: ``glob``; ``rangebytes``, the bytes of a task; ``startingposition``
(``earliest`` or ``latest``); ``maxbytespertrigger``, about the bytes of a
micro-batch (a line is never cut); ``progresslocation``, a folder in which the
driver notes what is committed, so that the first batch after a restart is
bounded too: without it that batch takes all there is.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

RANGE_BYTES = 64 * 1024 * 1024
_BLOCK = 1024 * 1024
_OVERHANG = 16 * 1024
_HEAD = 1024


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    stop: int
    first: int


@dataclass(frozen=True)
class Taken:
    """Bytes taken of a file, and the hash of its first ``head`` bytes."""

    bytes: int = 0
    head: int = 0
    hash: str = ""


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path else f"file://{path}")


def _dump(files: dict[str, Taken]) -> dict:
    return {"files": json.dumps({p: [t.bytes, t.head, t.hash] for p, t in sorted(files.items())})}


def _load(offset: dict) -> dict[str, Taken]:
    return {p: Taken(*t) if isinstance(t, list) else Taken(t) for p, t in json.loads(offset["files"]).items()}


class _TailReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.folder, self.glob = options["path"], options.get("glob", "*")
        self.range_bytes = int(options.get("rangebytes", RANGE_BYTES))
        self.from_end = options.get("startingposition", "earliest") == "latest"
        self.most = int(options.get("maxbytespertrigger", 0))
        self.progress = options.get("progresslocation")
        self.reached: dict[str, Taken] | None = None
        self.seen: dict[str, tuple] = {}

    def _listed(self) -> dict[str, tuple[int, int]]:
        """Size and time of change of every followed file."""
        from fnmatch import fnmatch

        from pyarrow import fs

        files, root = _files(self.folder)
        found = files.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        return {f.path: (f.size, f.mtime_ns or 0) for f in found if f.is_file and fnmatch(f.base_name, self.glob)}

    def _head(self, path: str, n: int) -> str:
        files, _ = _files(self.folder)
        with files.open_input_file(path) as f:
            return hashlib.sha256(f.read(n)).hexdigest()[:16]

    def _whole_lines(self, path: str, first: int, stop: int, size: int) -> int:
        """Offset after the last line break before ``stop``; if a single line is longer, after the next one (``first`` if there is none)."""
        files, _ = _files(self.folder)
        with files.open_input_file(path) as f:
            end = stop
            while end > first:
                start = max(first, end - _BLOCK)
                f.seek(start)
                at = f.read(end - start).rfind(b"\n")
                if at >= 0:
                    return start + at + 1
                end = start
            f.seek(stop)
            while stop < size:
                block = f.read(min(_BLOCK, size - stop))
                at = block.find(b"\n")
                if at >= 0 or not block:
                    return stop + at + 1 if block else first
                stop += len(block)
        return first

    def _noted(self) -> dict[str, Taken] | None:
        if not self.progress:
            return None
        files, root = _files(self.progress)
        try:
            with files.open_input_file(f"{root}/taken.json") as f:
                return _load({"files": f.read().decode()})
        except FileNotFoundError:
            return None

    def _start_of(self, path: str, before: dict[str, Taken]) -> int:
        """Where to go on in a file: what was taken of it, also under the name it had before a rotation; else its start."""
        known = before.get(path)
        if known and self._head(path, known.head) == known.hash:
            return known.bytes
        if not known:
            for other, t in before.items():
                if t.head and self._head(path, t.head) == t.hash and self._replaced(other, t):
                    return t.bytes
        return 0

    def _replaced(self, path: str, t: Taken) -> bool:
        try:
            return self._head(path, t.head) != t.hash
        except FileNotFoundError:
            return True

    def _upto(self, before: dict[str, Taken], most: int) -> dict[str, Taken]:
        """What to take next: ``most`` bytes (0: no bound) in even shares; files that did not change are not opened."""
        out, listed = {}, self._listed()
        grown = {}
        for path, stat in listed.items():
            if self.seen.get(path) == stat and path in before and before[path].bytes >= stat[0]:
                out[path] = before[path]
            else:
                grown[path] = (self._start_of(path, before), stat[0])
        left = most
        for i, (path, (first, size)) in enumerate(sorted(grown.items(), key=lambda g: g[1][1] - g[1][0])):
            stop = size if not most else min(size, first + max(left, 0) // (len(grown) - i))
            stop = self._whole_lines(path, first, stop, size) if stop > first or not most else first
            left -= max(stop - first, 0)
            head = min(_HEAD, stop)
            out[path] = Taken(stop, head, self._head(path, head))
            self.seen[path] = listed[path]
        return out

    def initialOffset(self) -> dict:
        self.reached = self._upto({}, 0) if self.from_end else {}
        return _dump(self.reached)

    def latestOffset(self) -> dict:
        if self.reached is None:
            self.reached = self._noted()
        self.reached = self._upto(self.reached or {}, self.most if self.reached is not None else 0)
        return _dump(self.reached)

    def partitions(self, start: dict, end: dict) -> list[ByteRange]:
        taken, now = _load(start), _load(end)
        ranges = []
        for path, t in now.items():
            if taken.get(path) == t:
                continue
            first = self._start_of(path, taken)
            for at in range(first, t.bytes, self.range_bytes):
                ranges.append(ByteRange(path, at, min(at + self.range_bytes, t.bytes), first))
        return ranges

    def read(self, part: ByteRange) -> Iterator[pa.RecordBatch]:
        """Lines that start inside the range; the last one may end behind it."""
        for block in self.blocks(part):
            lines = [t for t in (x.rstrip("\r") for x in block.decode("utf-8", errors="replace").split("\n")) if t.strip()]
            if lines:
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string()), pa.array([part.path] * len(lines), pa.string())], names=["value", "source_file"])

    def blocks(self, part: ByteRange) -> Iterator[bytes]:
        """The bytes of those lines, read once and in large blocks."""
        files, _ = _files(self.folder)
        with files.open_input_file(part.path) as f:
            # Unless it is the first, a range begins after the line break that comes at or after the byte before it.
            skip = part.start > part.first
            at = part.start - skip
            f.seek(at)
            held = b""
            while at < part.stop:
                left = part.stop - at - len(held)
                block = f.read(min(_BLOCK, left) if left > 0 else _OVERHANG)
                held += block
                if not block and (skip or b"\n" not in held):
                    return
                if skip:
                    begin = held.find(b"\n") + 1
                    at += begin or len(held)
                    held = held[begin:] if begin else b""
                    skip = not begin
                    continue
                # The line that holds the range's last byte is the last one.
                last = held.find(b"\n", max(part.stop - 1 - at, 0)) if at + len(held) >= part.stop else -1
                cut = last + 1 if last >= 0 else held.rfind(b"\n") + 1
                if cut:
                    yield held[:cut]
                    at, held = at + cut, held[cut:]

    def commit(self, end: dict) -> None:
        if self.progress:
            files, root = _files(self.progress)
            files.create_dir(root, recursive=True)
            with files.open_output_stream(f"{root}/taken.json") as f:
                f.write(end["files"].encode())


class GrowingFiles(DataSource):
    """``spark.readStream.format("growing_files").option("glob", "*.log").load(folder)``."""

    @classmethod
    def name(cls) -> str:
        return "growing_files"

    def schema(self) -> str:
        return "value string, source_file string"

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _TailReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(GrowingFiles)
