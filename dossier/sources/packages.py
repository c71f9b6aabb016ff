"""SRC14, SRC10: archives and workbooks of a folder as batch data sources, and files written by tasks.

    spark.dataSource.register(ArchiveEntries)
    spark.read.format("archive_entries").option("path", folder).load()

``archive_entries`` reads only the directories of ZIP files, by place, never what they hold; ``workbook_rows`` reads the
sheets of XLSX files. Files are dealt to partitions by size, so that small ones share a task and a large one has its own.
Paths are those of pyarrow's file systems. A file that can't be read is one row that says why.

A ZIP's directory is checked before it is believed: it lies in the file, every entry's local header and data do too, and
no two entries share a byte. Sizes are what the entries declare, added up as whole numbers of any length; a total of
2**64 or more is none.
"""

from __future__ import annotations

import fnmatch
import io
import struct
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import pandas as pd
import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BinaryType

from dossier.sources.follow import _opened as opened
from dossier.sources.sheets import workbook

#: Entries listed, entries of an archive at most.
LISTED, MOST_ENTRIES = 200, 100_000


class Damaged(ValueError):
    """Why an archive's directory isn't believed."""


@dataclass(frozen=True)
class Entry:
    name: str
    size: int
    packed: int

    def listed(self) -> bool:
        """Neither a folder nor what systems add."""
        return not self.name.endswith("/") and not self.name.startswith("__MACOSX/") and not self.name.endswith(".DS_Store")


def total(entries: list[Entry]) -> int | None:
    out = sum(e.size for e in entries)
    return out if out < 1 << 64 else None


def _wide(extra: bytes, fields: list[int]) -> list[int]:
    """Sizes and places with those of 32 set bits taken from the ZIP64 field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, n = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide, k, out = extra[at + 4 : at + 4 + n], 0, []
            for f in fields:
                if f == 0xFFFFFFFF:
                    if k + 8 > len(wide):
                        raise Damaged("a ZIP64 field is cut off")
                    f, k = struct.unpack_from("<Q", wide, k)[0], k + 8
                out.append(f)
            return out
        at += 4 + n
    if 0xFFFFFFFF in fields:
        raise Damaged("a ZIP64 field is missing")
    return fields


def directory(read: Callable[[int, int], bytes], length: int, most: int = MOST_ENTRIES) -> list[Entry]:
    """The entries of a ZIP file of so many bytes; read(place, n) gives its bytes."""
    begin = max(0, length - 22 - 0xFFFF)
    tail = read(begin, length - begin)
    at = tail.rfind(b"PK\5\6", 0, max(0, len(tail) - 18))
    if at < 0:
        raise Damaged("no end of a central directory")
    count, size, place = struct.unpack_from("<HLL", tail, at + 10)
    end = begin + at
    if end >= 20 and (count == 0xFFFF or 0xFFFFFFFF in (size, place)):
        locator = read(end - 20, 20)
        if locator[:4] == b"PK\6\7":
            end = struct.unpack_from("<Q", locator, 8)[0]
            wide = read(end, 56) if end + 56 <= length else b""
            if wide[:4] != b"PK\6\6":
                raise Damaged("no ZIP64 record where its locator says")
            count, size, place = struct.unpack_from("<QQQ", wide, 32)
    if count > most:
        raise Damaged(f"{count} entries, over {most}")
    if place + size > end:
        raise Damaged("the central directory lies outside the file")
    listed, out, spans, at = read(place, size), [], [], 0
    for _ in range(count):
        if at + 46 > len(listed) or listed[at : at + 4] != b"PK\1\2":
            raise Damaged("the central directory is cut off")
        flags, packed, unpacked, n_name, n_extra, n_comment = *struct.unpack_from("<H", listed, at + 8), *struct.unpack_from("<LLHHH", listed, at + 20)
        local = struct.unpack_from("<L", listed, at + 42)[0]
        name, extra = listed[at + 46 : at + 46 + n_name], listed[at + 46 + n_name : at + 46 + n_name + n_extra]
        at += 46 + n_name + n_extra + n_comment
        if at > len(listed):
            raise Damaged("the central directory is cut off")
        unpacked, packed, local = _wide(extra, [unpacked, packed, local])
        head = read(local, 30) if local + 30 <= place else b""
        if head[:4] != b"PK\3\4":
            raise Damaged("an entry has no local header")
        stop = local + 30 + sum(struct.unpack_from("<HH", head, 26)) + packed
        if stop > place:
            raise Damaged("an entry lies outside the file")
        spans.append((local, stop))
        out.append(Entry(name.decode("utf-8" if flags & 0x800 else "cp437", "replace"), unpacked, packed))
    spans.sort()
    if any(a[1] > b[0] for a, b in zip(spans, spans[1:], strict=False)):
        raise Damaged("two entries share bytes of the file")
    return out


@dataclass
class Files(InputPartition):
    paths: list[str]


class FolderReader(DataSourceReader):
    """Partitions of a folder's files by size; subclasses give rows(path, store)."""

    def __init__(self, options: dict[str, str], pattern: str):
        self.path, self.pattern, self.bytes = options["path"], options.get("pattern", pattern), int(options.get("bytes", 64 << 20))

    def partitions(self) -> list[Files]:
        store, folder = opened(self.path)
        found = [(f.path, f.size or 0) for f in store.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True)) if f.type == fs.FileType.File and fnmatch.fnmatch(f.base_name, self.pattern) and not f.base_name.startswith((".", "_"))]
        out, held, weight = [], [], 0
        for path, size in sorted(found):
            # Opening a file costs as much as reading some of it.
            if held and weight + size + (1 << 20) > self.bytes:
                out.append(Files(held))
                held, weight = [], 0
            held.append(path)
            weight += size + (1 << 20)
        return [*out, Files(held)] if held else out

    def read(self, part: Files) -> Iterator[tuple]:
        store, _ = opened(self.path)
        for path in part.paths:
            yield from self.rows(path, store)


class _Entries(FolderReader):
    def rows(self, path, store):
        try:
            with store.open_input_file(path) as file:

                def read(place: int, n: int) -> bytes:
                    file.seek(place)
                    return file.read(n)

                every = [e for e in directory(read, file.size()) if e.listed()]
        except (Damaged, OSError, struct.error) as e:
            yield path, None, None, None, None, None, None, str(e)
            return
        whole = total(every)
        head = len(every), None if whole is None else Decimal(whole), None if len(every) <= LISTED else "truncated"
        for n, e in enumerate(every[:LISTED]):
            yield path, n, e.name, Decimal(e.size), Decimal(e.packed), *head
        if not every:
            yield path, None, None, None, None, *head


class ArchiveEntries(DataSource):
    """(path, seq, name, size, packed, entries, total, problem): sizes have 64 bits without a sign."""

    @classmethod
    def name(cls) -> str:
        return "archive_entries"

    def schema(self) -> str:
        return "path string, seq int, name string, size decimal(20,0), packed decimal(20,0), entries int, total decimal(20,0), problem string"

    def reader(self, schema) -> DataSourceReader:
        return _Entries(self.options, "*.zip")


class _Rows(FolderReader):
    def rows(self, path, store):
        try:
            with store.open_input_stream(path) as file, zipfile.ZipFile(io.BytesIO(file.read())) as archive:
                for sheet in workbook(archive):
                    for n, cells in sheet.rows:
                        yield path, sheet.number, sheet.name, n, [c.raw for c in cells], [c.shown for c in cells], None
                    if sheet.problem:
                        yield path, sheet.number, sheet.name, None, None, None, sheet.problem
        except Exception as e:  # whatever a damaged file makes a parser raise is a finding about that file
            yield path, None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]


class WorkbookRows(DataSource):
    """(path, number, sheet, row, cells, shown, problem): cells as written, and as shown with dates and percentages."""

    @classmethod
    def name(cls) -> str:
        return "workbook_rows"

    def schema(self) -> str:
        return "path string, number int, sheet string, row int, cells array<string>, shown array<string>, problem string"

    def reader(self, schema) -> DataSourceReader:
        return _Rows(self.options, "*.xlsx")


@F.pandas_udf(BinaryType())
def zip_of(parts: pd.Series) -> pd.Series:
    """An archive of parts, array<struct<name,text>>, always of the same bytes for the same parts."""

    def one(some) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
            for part in some:
                archive.writestr(zipfile.ZipInfo(part["name"]), part["text"])
        return out.getvalue()

    return parts.map(lambda some: None if some is None else one(some))


def write_files(rows: DataFrame, folder: str) -> int:
    """Writes (name, content) rows as files of a folder; a task that is repeated writes the same files. Returns their number."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)
        n = 0
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist(), strict=True):
                with store.open_output_stream(f"{base}/{name}") as out:
                    out.write(content)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.select("name", "content").mapInArrow(write, "n long").groupBy().sum("n").first()[0] or 0


def write_archives(rows: DataFrame, folder: str) -> int:
    """Writes (name, parts) rows, parts as for zip_of, as archives of a folder; returns their number.

    The parts travel one a row, so that a task holds one archive and not a batch of 10,000. Null parts are none. Of a
    column bytes, where there is one, an archive is cut to so many bytes (null: whole).
    """
    most = F.col("bytes") if "bytes" in rows.columns else F.lit(None)
    flat = rows.select("name", most.cast("long").alias("bytes"), F.posexplode_outer("parts").alias("at", "part")).select("name", "bytes", "at", F.col("part")["name"].alias("part"), F.col("part")["text"].alias("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = opened(folder)
        store.create_dir(base, recursive=True)

        def archives() -> Iterator[tuple[str, int | None, memoryview]]:
            held = None
            pieces = (batch.slice(k, 256) for batch in batches for k in range(0, batch.num_rows, 256))
            for name, most, at, part, text in (row for some in pieces for row in zip(*(c.to_pylist() for c in some.columns), strict=True)):
                if not at:  # the first part of the next archive, or one without parts
                    if held is not None:
                        archive.close()
                        yield *held, out.getbuffer()
                    held, out = (name, most), io.BytesIO()
                    archive = zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED)
                if at is not None:
                    archive.writestr(zipfile.ZipInfo(part), text)
            if held is not None:
                archive.close()
                yield *held, out.getbuffer()

        n = 0
        for name, most, content in archives():
            with store.open_output_stream(f"{base}/{name}") as file:
                file.write(content[:most])
            n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return flat.mapInArrow(write, "n long").groupBy().sum("n").first()[0] or 0
