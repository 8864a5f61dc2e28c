"""Data sources of Spark for what it can't read or write itself: a sink of WAV files, a reader of workbooks.

    register(spark)
    signals.write.format("wave").option("fs", 16_000).mode("append").save(folder)
    spark.read.format("workbook").option("sheet", "rooms").load(folder)

Paths may name any file system that pyarrow opens (local, hdfs, s3, ...).
"""

from __future__ import annotations

import datetime
import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs as files
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import BooleanType, DataType, DateType, DoubleType, IntegralType, StringType, StructField, StructType, TimestampType

from echolith.schema import FS
from echolith.sources.audio import wave_bytes


def register(spark: SparkSession) -> None:
    """Makes the formats wave and workbook known to a session."""
    for source in (Waves, Workbooks):
        spark.dataSource.register(source)


def _opened(path: str) -> tuple[files.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return (files.LocalFileSystem(), posixpath.abspath(path)) if "://" not in path else files.FileSystem.from_uri(path)


# -- WAV files


@dataclass
class Written(WriterCommitMessage):
    """A task's folder of finished files."""

    folder: str
    count: int


class Waves(DataSource):
    """Writes rows (name string, x array of doubles within -1 and 1) as 16-bit WAV files, a folder for each task.

    A task writes to a folder of its own attempt; the job's commit renames the folders of the attempts that count and sets _SUCCESS, so that an attempt that is lost or retried leaves no file. Names that repeat within a task get a number. A row without a name or samples, or whose name has a slash, fails the job: use where() to leave it out. An empty table gives a folder with _SUCCESS alone. Other columns play no part. Mode overwrite deletes what was there once all is written, append adds folders.
    """

    @classmethod
    def name(cls) -> str:
        return "wave"

    def writer(self, schema: StructType, overwrite: bool) -> WaveWriter:
        if missing := {"name", "x"} - set(schema.names):
            raise ValueError(f"a table of signals has the columns name and x; missing: {', '.join(sorted(missing))}")
        return WaveWriter(self.options["path"], int(self.options.get("fs", FS)), overwrite)


class WaveWriter(DataSourceArrowWriter):
    def __init__(self, path: str, fs: int, overwrite: bool):
        self.path, self.fs, self.overwrite, self.job = path, fs, overwrite, uuid.uuid4().hex

    def _staging(self, root: str) -> str:
        return f"{root}/_staging-{self.job}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = _opened(self.path)
        folder, count, seen = uuid.uuid4().hex, 0, {}
        for b in batches:
            names, signals = b.column(b.schema.names.index("name")), b.column(b.schema.names.index("x"))
            for i in range(len(b)):  # one signal at a time
                name, x = names[i].as_py(), signals[i].values
                if name is None or x is None or "/" in name:
                    raise ValueError(f"no file can be made of the row named {name!r}")
                if not count:
                    system.create_dir(f"{self._staging(root)}/{folder}")
                seen[name] = seen.get(name, 0) + 1
                number = f"-{seen[name]}" if seen[name] > 1 else ""
                with system.open_output_stream(f"{self._staging(root)}/{folder}/{name}{number}.wav") as out:
                    out.write(wave_bytes(x.to_numpy(zero_copy_only=False), self.fs))
                count += 1
        return Written(folder, count)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        system.create_dir(root)
        if self.overwrite:
            for old in system.get_file_info(files.FileSelector(root)):
                if old.path != self._staging(root):
                    (system.delete_dir if old.type == files.FileType.Directory else system.delete_file)(old.path)
        for m in messages:
            if m is not None and m.count:
                system.move(f"{self._staging(root)}/{m.folder}", f"{root}/part-{m.folder}")
        self.abort(messages)
        system.open_output_stream(f"{root}/_SUCCESS").close()

    def abort(self, messages: list[Written | None]) -> None:
        system, root = _opened(self.path)
        if system.get_file_info(self._staging(root)).type == files.FileType.Directory:
            system.delete_dir(self._staging(root))


# -- workbooks

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
#: Rows of the first file that a schema is read off, where none is given.
SAMPLE = 1000
#: Day 0 of serial dates (before March 1900 they are a day off, as in every program that writes them).
EPOCH = datetime.datetime(1899, 12, 30)


def _column(ref: str) -> int:
    """The column of a cell such as AB12, from 0."""
    at = 0
    for c in ref:
        if not c.isalpha():
            break
        at = at * 26 + ord(c.upper()) - 64
    return at - 1


def _text(e: ElementTree.Element) -> str:
    """A string item's text: its runs, without phonetic hints."""
    return "".join(t.text or "" for part in [e, *e.findall(f"{MAIN}r")] for t in part.findall(f"{MAIN}t"))


def _elements(book: zipfile.ZipFile, name: str, tag: str) -> Iterator[ElementTree.Element]:
    """A part's elements of a kind, one at a time."""
    with book.open(name) as part:
        events = ElementTree.iterparse(part, ("start", "end"))
        _, root = next(events)
        for event, e in events:
            if event == "end" and e.tag == MAIN + tag:
                yield e
                e.clear()
                if tag == "row":
                    root.find(f"{MAIN}sheetData").clear()


def _sheet_part(book: zipfile.ZipFile, sheet: str | None) -> str | None:
    """The part that holds a sheet, the first one if none is named; None if there is no such sheet."""
    links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        if sheet is None or s.get("name") == sheet:
            return posixpath.normpath(posixpath.join("xl", links[s.get(LINK)])) if not links[s.get(LINK)].startswith("/") else links[s.get(LINK)][1:]
    return None


def sheet_rows(source, sheet: str | None = None) -> Iterator[dict[int, str | float | bool | datetime.datetime]]:
    """The rows of an OOXML workbook's sheet, each its cells by column. Empty cells and errors are left out."""
    with zipfile.ZipFile(source) as book:
        part = _sheet_part(book, sheet)
        if part is None:
            return
        shared = [_text(e) for e in _elements(book, "xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in book.namelist() else []
        for row in _elements(book, part, "row"):
            cells, at = {}, -1
            for c in row.findall(f"{MAIN}c"):
                at = _column(c.get("r")) if c.get("r") else at + 1
                kind, value, inline = c.get("t", "n"), c.findtext(f"{MAIN}v"), c.find(f"{MAIN}is")
                if kind == "inlineStr" and inline is not None:
                    cells[at] = _text(inline)
                elif value is not None and kind != "e":
                    cells[at] = shared[int(value)] if kind == "s" else value if kind == "str" else value == "1" if kind == "b" else datetime.datetime.fromisoformat(value) if kind == "d" else float(value)
            yield cells


def _fitted(value, kind: DataType):
    """A cell's value as a column's type, null if it doesn't fit."""
    try:
        if value is None:
            return None
        if isinstance(kind, StringType):
            return str(int(value)) if isinstance(value, float) and value.is_integer() else str(value).lower() if isinstance(value, bool) else str(value)
        if isinstance(kind, BooleanType):
            return value if isinstance(value, bool) else None
        if isinstance(kind, (DateType, TimestampType)):
            at = value if isinstance(value, datetime.datetime) else datetime.datetime.fromisoformat(value) if isinstance(value, str) else EPOCH + datetime.timedelta(days=value)
            return at.date() if isinstance(kind, DateType) else at
        number = float(value)
        return (int(number) if number.is_integer() else None) if isinstance(kind, IntegralType) else number
    except (TypeError, ValueError, OverflowError):
        return None


@dataclass
class Book(InputPartition):
    path: str


class Workbooks(DataSource):
    """Reads a sheet (option sheet, the first by default) of each .xlsx file at a path, a task for each file.

    The first row names the columns. With a schema, columns are found by name, missing ones and cells that don't fit are null; without one, it is read off the first file's first SAMPLE rows: numbers and booleans where all cells are, else strings. Names that are empty or repeat are left out after the first. Blank rows are left out, a file without the sheet or without rows gives none.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> StructType:
        kinds: dict[str, set[type]] = {}
        for path in _books(self.options["path"])[:1]:
            for i, row in enumerate(_named(path, self.options.get("sheet"))):
                if i > SAMPLE:
                    break
                for name, value in row.items():
                    kinds.setdefault(name, set()).update({type(value)} - {type(None)})
        types = {frozenset({float}): DoubleType(), frozenset({bool}): BooleanType()}
        return StructType([StructField(name, types.get(frozenset(found), StringType())) for name, found in kinds.items()])

    def reader(self, schema: StructType) -> WorkbookReader:
        return WorkbookReader(self.options["path"], self.options.get("sheet"), schema)


def _books(path: str) -> list[str]:
    system, root = _opened(path)
    found = system.get_file_info(root)
    if found.type == files.FileType.NotFound:
        raise FileNotFoundError(path)
    inside = system.get_file_info(files.FileSelector(root, recursive=True)) if found.type == files.FileType.Directory else [found]
    prefix = path.split("://")[0] + "://" if "://" in path and not path.startswith("file:") else ""
    return sorted(prefix + f.path for f in inside if f.is_file and f.path.lower().endswith(".xlsx") and not posixpath.basename(f.path).startswith(("~", ".", "_")))


def _named(path: str, sheet: str | None) -> Iterator[dict]:
    """Rows by the names in the first one; first a row of nulls, so that names are known without rows."""
    system, place = _opened(path)
    with system.open_input_file(place) as source:
        rows = sheet_rows(source, sheet)
        names: dict[int, str] = {}
        for at, value in next(rows, {}).items():
            if (name := _fitted(value, StringType())) and name not in names.values():
                names[at] = name
        yield dict.fromkeys(names.values())
        for row in rows:
            if row:
                yield {name: row.get(at) for at, name in names.items()}


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, schema: StructType):
        self.path, self.sheet, self.columns = path, sheet, [(f.name, f.dataType) for f in schema]

    def partitions(self) -> list[Book]:
        return [Book(p) for p in _books(self.path)]

    def read(self, partition: Book | None) -> Iterator[tuple]:
        if partition is None:
            return
        rows = _named(partition.path, self.sheet)
        next(rows)
        for row in rows:
            yield tuple(_fitted(row.get(name), kind) for name, kind in self.columns)
