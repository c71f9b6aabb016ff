"""STR8: a streaming data source that follows text files as they grow, by a byte offset for each file.

    spark.dataSource.register(FollowedLines)
    spark.readStream.format("followed_lines").option("path", folder).option("suffix", ".jsonl").load()

A batch is the complete lines that were added to the files of a folder since the batch before: (file, offset, line).
The offset of a file is kept in the query's checkpoint, so that after a restart each line comes once. The end of a batch
is set at a line's end: a line that is still being written waits for its newline. A file that became shorter than its
offset was written anew and is read from its start. Stretches of over ``split`` bytes are read by several tasks: each
reads the lines that begin in its part. Paths are those of pyarrow's file systems (local, HDFS, S3).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as fs
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

TAIL = 1 << 16


@dataclass
class Stretch(InputPartition):
    """The lines of a file that begin at start or later and before stop."""

    file: str
    start: int
    stop: int


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _last_line_end(store: fs.FileSystem, file: str, start: int, size: int) -> int:
    """The place after the last newline between start and size; start if there is none."""
    with store.open_input_file(file) as data:
        stop = size
        while stop > start:
            begin = max(start, stop - TAIL)
            data.seek(begin)
            at = data.read(stop - begin).rfind(b"\n")
            if at >= 0:
                return begin + at + 1
            stop = begin
    return start


class Follower(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.suffix, self.split = options["path"], options.get("suffix", ""), int(options.get("split", 64 << 20))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        store, folder = _opened(self.path)
        found = store.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        return {f.path: _last_line_end(store, f.path, 0, f.size) for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffix) and not f.base_name.startswith((".", "_"))}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for file, stop in sorted(end.items()):
            begin = start.get(file, 0)
            begin = begin if begin <= stop else 0
            out += [Stretch(file, at, min(at + self.split, stop)) for at in range(begin, stop, self.split)]
        return out

    def read(self, part: Stretch) -> Iterator[tuple]:
        store, _ = _opened(self.path)
        with store.open_input_file(part.file) as data:
            # From the byte before: what stands up to its newline belongs to the part before.
            lines = _lines(data, max(part.start - 1, 0))
            if part.start:
                next(lines, None)
            for at, line in lines:
                if at >= part.stop:
                    break
                yield part.file, at, line.rstrip(b"\r").decode("utf-8", "replace")

    def commit(self, end: dict) -> None:
        pass


def _lines(data, at: int) -> Iterator[tuple[int, bytes]]:
    """Place and bytes of the lines from a place on, without their newlines."""
    data.seek(at)
    held: list[bytes] = []
    while block := data.read(1 << 20):
        first, *rest = block.split(b"\n")
        held.append(first)
        for following in rest:
            line = b"".join(held)
            yield at, line
            at, held = at + len(line) + 1, [following]
    if line := b"".join(held):
        yield at, line


class FollowedLines(DataSource):
    @classmethod
    def name(cls) -> str:
        return "followed_lines"

    def schema(self) -> str:
        return "file string, offset long, line string"

    def streamReader(self, schema) -> Follower:
        return Follower(self.options)
