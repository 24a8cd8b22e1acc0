"""File listings and contents.

``listing`` walks directories with a Python data source: unlike the built-in binary
reader it keeps names that begin with a dot or an underscore, empty files and
directories, so that validation can speak about them.  Predicates on path, name, size and
kind are pushed into it: folders that no path in question is below are not entered, and of files
that name or path rule out no state is asked for.  Folders become tasks, large ones several.
Folders may be paths, or URIs of a store that Arrow's file systems know; listed paths begin alike.
``contents`` reads bytes with the built-in reader, which pushes the size limit into its scan.
"""

from __future__ import annotations

import os
import time
import zlib
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceStreamReader, EqualNullSafe, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, Not,
    StringContains, StringEndsWith, StringStartsWith,
)

from ..schema import FILES
from . import store

NAME = "pagewright_listing"
FOLDERS, ENTRIES, BATCH = 256, 20_000, 8192  # folders that the driver looks into; entries a task; rows a batch
OPENED, HELD = 250, 1 << 20  # files that a task opens; bytes of contents that a batch gathers
SETTLE = 1000  # milliseconds after which a change is taken for over
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
_SCHEMA = pa.schema([("path", pa.string()), ("name", pa.string()), ("size", pa.int64()), ("modified_time", pa.timestamp("us", "UTC")), ("is_dir", pa.bool_())])
_TESTS: dict[type, Callable] = {
    EqualTo: lambda v, w: v == w, EqualNullSafe: lambda v, w: v == w, GreaterThan: lambda v, w: v > w, GreaterThanOrEqual: lambda v, w: v >= w, LessThan: lambda v, w: v < w,
    LessThanOrEqual: lambda v, w: v <= w, In: lambda v, w: v in w, StringStartsWith: lambda v, w: v.startswith(w), StringEndsWith: lambda v, w: v.endswith(w), StringContains: lambda v, w: w in v,
}


class Condition:
    """One pushed predicate.  Listings hold no nulls, so a condition is true or false."""

    def __init__(self, f: Filter) -> None:
        self.negated = isinstance(f, Not)
        inner = f.child if isinstance(f, Not) else f
        self.column, self.kind = inner.attribute[0], type(inner)
        self.value = getattr(inner, "value", None)

    @classmethod
    def of(cls, f: Filter) -> Condition | None:
        inner = f.child if isinstance(f, Not) else f
        known = type(inner) in _TESTS or isinstance(inner, (IsNull, IsNotNull))
        return cls(f) if known and len(inner.attribute) == 1 and inner.attribute[0] in ("path", "name", "size", "is_dir") else None

    def holds(self, value) -> bool:
        if self.kind in (IsNull, IsNotNull):
            found = self.kind is IsNotNull
        else:
            found = self.value is not None and _TESTS[self.kind](value, self.value)
        return found != self.negated

    def enters(self, folder: str) -> bool:
        """Whether something at or below a folder may meet the condition."""
        if self.column != "path" or self.negated or self.kind not in (EqualTo, EqualNullSafe, In, StringStartsWith):
            return True
        wanted = self.value if self.kind is In else [self.value]
        return any(w is not None and (w.startswith(folder) or (self.kind is StringStartsWith and folder.startswith(w))) for w in wanted)


class _Folder(InputPartition):
    """A folder's own files, or the ``part``-th of ``parts`` shares of them, or all that is below it."""

    def __init__(self, path: str, recursive: bool, part: int = 0, parts: int = 1) -> None:
        self.path, self.recursive, self.part, self.parts = path, recursive, part, parts


class ListingReader(DataSourceReader):
    def __init__(self, root: str, dirs: bool) -> None:
        self.root, self.dirs = root, dirs
        self.conditions: list[Condition] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            condition = Condition.of(f)
            if condition is None:
                yield f
            else:
                self.conditions.append(condition)

    def _enters(self, folder: str) -> bool:
        return all(c.enters(folder) for c in self.conditions)

    def partitions(self) -> list[InputPartition]:
        """Folders by level until there are FOLDERS of them; those looked into so far by themselves, the last ones with all below."""
        out: list[InputPartition] = []
        level = [self.root] if self._enters(self.root) else []
        looked = 0
        while level and looked + len(level) < FOLDERS:
            below = []
            for folder in level:
                inside = self._inside(folder)
                below += [path for path, _, _, real in inside if real and self._enters(path)]
                entries = len(inside)
                parts = max(1, -(-entries // ENTRIES))
                out += [_Folder(folder, False, k, parts) for k in range(parts)]
                looked += 1
            level = sorted(below)
        return out + [_Folder(folder, True) for folder in level]

    def _inside(self, folder: str) -> list[tuple[str, str, bool, bool]]:
        """(path, name, is it a directory, is it one itself and no link to one), by name; nothing of folders that can't be read."""
        try:
            if store.has_scheme(folder):
                return sorted((path, name, is_dir, is_dir) for path, name, is_dir, _, _ in store.below(folder))
            with os.scandir(folder) as found:
                return sorted((e.path, e.name, e.is_dir(), e.is_dir(follow_symlinks=False)) for e in found)
        except OSError:
            return []

    @staticmethod
    def _state(path: str) -> tuple[int, float]:
        """Size and time of modification."""
        if store.has_scheme(path):
            found = store.info(path)
            return found.size or 0, (found.mtime_ns or 0) / 1e9
        s = os.stat(path)
        return int(s.st_size), s.st_mtime

    def _row(self, path: str, is_dir: bool) -> tuple | None:
        known = {"path": path, "name": os.path.basename(path), "is_dir": is_dir}
        if not all(c.holds(known[c.column]) for c in self.conditions if c.column != "size"):
            return None  # without a look at the file
        try:
            size, at = self._state(path)
        except OSError:
            return None  # entries that can't be read are passed over
        if not all(c.holds(size) for c in self.conditions if c.column == "size"):
            return None
        return path, known["name"], size, datetime.fromtimestamp(at, timezone.utc), is_dir

    def _rows(self, partition: _Folder) -> Iterator[tuple]:
        folders = [partition.path]
        while folders:
            folder = folders.pop()
            entries = self._inside(folder)
            for path, name, is_dir, _ in entries:
                if not is_dir and (partition.parts == 1 or zlib.crc32(os.fsencode(name)) % partition.parts == partition.part):
                    yield self._row(path, False)
            if self.dirs and partition.part == 0:
                yield self._row(folder, True)
            if partition.recursive:
                folders += [path for path, _, _, real in reversed(entries) if real and self._enters(path)]

    def read(self, partition: _Folder) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), _SCHEMA.types)], schema=_SCHEMA)

        for row in self._rows(partition):
            if row:
                held.append(row)
                if len(held) == BATCH:
                    yield batch()
                    held = []
        if held:
            yield batch()


class _Span(InputPartition):
    """Of a folder's entries those whose state changed after ``low`` and up to ``high`` (ns)."""

    def __init__(self, folder: _Folder, low: int, high: int) -> None:
        self.folder, self.low, self.high = folder, low, high


class ListingStreamReader(DataSourceStreamReader):
    """New and changed files by the time of their last change; offsets are times, whatever the number of files.

    On local folders that time also moves when a file is renamed or moved here with an old date.  What changed
    within the last ``settle`` milliseconds waits for the next batch, as clocks and half written
    files are not to be relied on.  A file that changes twice between two batches is reported once, as it is then.
    """

    def __init__(self, root: str, dirs: bool, settle: int) -> None:
        self.listing, self.settle = ListingReader(root, dirs), settle

    def initialOffset(self) -> dict:
        return {"upto": "0"}

    def latestOffset(self) -> dict:
        return {"upto": str(time.time_ns() - self.settle * 1_000_000)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Span(folder, int(start["upto"]), int(end["upto"])) for folder in self.listing.partitions()]

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        for batch in self.listing.read(partition.folder):
            changed = [self._changed(path) for path in batch.column("path").to_pylist()]
            inside = [c is not None and partition.low < c <= partition.high for c in changed]
            if any(inside):
                yield batch.filter(pa.array(inside))

    @staticmethod
    def _changed(path: str) -> int | None:
        if store.has_scheme(path) and not path.startswith("file:"):
            return store.info(path).mtime_ns
        try:
            s = os.stat(store.resolve(path)[1])
        except OSError:
            return None
        return max(s.st_mtime_ns, s.st_ctime_ns)


class ListingSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def streamReader(self, schema) -> ListingStreamReader:
        return ListingStreamReader(self.options.get("path", ""), self.options.get("dirs", "false") == "true", int(self.options.get("settle", SETTLE)))

    def schema(self) -> str:
        return FILES

    def reader(self, schema) -> ListingReader:
        return ListingReader(self.options.get("path", ""), self.options.get("dirs", "false") == "true")


def listing(spark: SparkSession, directory: str, dirs: bool = False) -> DataFrame:
    """path, name, size, modified_time, is_dir of everything below a directory.

    Switches the session's pushdown into Python data sources on, which this one makes use of.
    """
    if not directory:
        raise ValueError("directory cannot be empty")
    if not (store.info(directory).type is FileType.Directory if store.has_scheme(directory) else os.path.isdir(directory)):
        raise FileNotFoundError(f"directory does not exist: {directory}")
    spark.conf.set(PUSHDOWN, "true")
    spark.dataSource.register(ListingSource)
    return spark.read.format(NAME).option("path", directory).option("dirs", str(dirs).lower()).load()


def listing_stream(spark: SparkSession, directory: str, settle: int = SETTLE) -> DataFrame:
    """The listing's columns for files as they appear or change below a directory; unlike the built-in file stream it sees
    empty files, names that begin with a dot, and changes of files that it has reported before."""
    spark.dataSource.register(ListingSource)
    return spark.readStream.format(NAME).option("path", directory).option("settle", settle).load()


def readable(listed: DataFrame, max_file_size: int) -> DataFrame:
    """Of a listing, files that are not empty and within the limit, in predicates that a source can take."""
    return listed.where((F.col("size") > 0) & (F.col("size") <= max_file_size) & ~F.col("is_dir"))


def contents(spark: SparkSession, paths: str | list[str], max_file_size: int = 100 << 20) -> DataFrame:
    """path and content of the PDF files at or below the paths, within the size limit."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]")
    out = read.load(paths).where((F.col("length") > 0) & (F.col("length") <= max_file_size))
    return out.select(F.regexp_replace("path", "^file:/*(?=/)", "").alias("path"), "content")


def dealt(files: DataFrame, each: int = OPENED) -> DataFrame:
    """Paths of listed files, dealt to tasks by number: a listing's tasks are as long as its folders, which says nothing about the work on the contents."""
    paths = files.select("path")
    return paths.repartition(max(1, -(-paths.count() // each)), "path")


def content_of(files: DataFrame) -> DataFrame:
    """path and content of listed files, also of such as the built-in reader passes over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(held: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), (pa.string(), pa.binary()))], ["path", "content"])

        held, size = [], 0
        for paths in batches:
            for path in paths.column(0).to_pylist():
                held.append((path, store.read_bytes(path)))
                size += len(held[-1][1])
                if size >= HELD:  # a large file goes on by itself or with a few small ones
                    yield batch(held)
                    held, size = [], 0
        if held:
            yield batch(held)

    return files.select("path").mapInArrow(run, "path string, content binary")
