"""Reports (path, line, text) written as text files, by a Python data source.

Every task writes one file; a report is a line with a form feed and its path, then its lines.  Files are
written under a folder that readers do not look into, and moved when all tasks are done, so a
failed task or job leaves nothing: an attempt that is not committed is removed with that folder.
Files go through Arrow's file systems, so a path may be a URI of any store that they know.

Lines that begin with a form feed get one more, so any text reads back; line ends are the
separator and must not be inside a text (``reports.as_lines`` sees to that).
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

NAME = "pagewright_reports"
MARK = "\f"


@dataclass
class Part(WriterCommitMessage):
    name: str | None


def _store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class ReportWriter(DataSourceArrowWriter):
    def __init__(self, uri: str, overwrite: bool) -> None:
        self.uri, self.overwrite, self.job = uri, overwrite, uuid.uuid4().hex

    def _pending(self, root: str) -> str:
        return posixpath.join(root, f"_pending-{self.job}")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, root = _store(self.uri)
        at = TaskContext.get()
        name = f"part-{at.partitionId():05d}-{at.taskAttemptId()}-{self.job}.txt"
        current, out = None, None
        try:
            for batch in iterator:
                if batch.num_rows and out is None:
                    store.create_dir(self._pending(root), recursive=True)
                    out = store.open_output_stream(posixpath.join(self._pending(root), name))
                for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                    if path != current or current is None:
                        out.write(f"{MARK}{path}\n".encode("utf-8", "replace"))
                        current = path
                    if text is None or "\n" in text:
                        raise ValueError(f"a report's line is missing or has a line end: {path}")
                    out.write(f"{MARK if text.startswith(MARK) else ''}{text}\n".encode("utf-8", "replace"))
        finally:
            if out is not None:
                out.close()
        return Part(name if out is not None else None)

    def commit(self, messages: list[Part | None]) -> None:
        store, root = _store(self.uri)
        store.create_dir(root, recursive=True)
        if self.overwrite:
            old = [f.path for f in store.get_file_info(fs.FileSelector(root)) if f.base_name.startswith("part-")]
            for path in old:
                store.delete_file(path)
        for m in messages:
            if m is not None and m.name:
                store.move(posixpath.join(self._pending(root), m.name), posixpath.join(root, m.name))
        self.abort(messages)
        with store.open_output_stream(posixpath.join(root, "_SUCCESS")):
            pass

    def abort(self, messages: list[Part | None]) -> None:
        store, root = _store(self.uri)
        if store.get_file_info(self._pending(root)).type is not fs.FileType.NotFound:
            store.delete_dir(self._pending(root))


class ReportSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return "path string, text string"

    def writer(self, schema, overwrite: bool) -> ReportWriter:
        return ReportWriter(self.options["path"], overwrite)


def write_reports(lines: DataFrame, path: str, mode: str = "append") -> None:
    """Reports of (path, line, text), each whole in one file, its lines in order."""
    lines.sparkSession.dataSource.register(ReportSource)
    dealt = lines.select("path", "line", "text").repartition("path").sortWithinPartitions("path", "line")
    dealt.select("path", "text").write.format(NAME).mode(mode).option("path", path).save()


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(path, line, text) of the reports in a folder; a file at a time, as their order is the lines' order."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="part-*")
    blocks = whole.select(F.explode(F.split(F.concat(F.lit("\n"), F.col("value")), f"\n{MARK}(?!{MARK})")).alias("block")).where("block <> ''")
    rows = F.split(F.regexp_replace("block", "\n$", ""), "\n")
    lines = blocks.select(F.get(rows, F.lit(0)).alias("path"), F.posexplode(F.slice(rows, F.lit(2), F.size(rows))).alias("line", "text"))
    return lines.select("path", "line", F.regexp_replace("text", f"^{MARK}", "").alias("text"))
