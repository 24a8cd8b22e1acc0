"""A library of generated files: every conversation is a file of several pages.

Files are made once a session, in the shared folder, and then only read.  Names,
extensions, images, notes, boxes and document information follow from the ids alone, so
that SQL over the conversations can say what reading the files must give.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, pdf, store
from .adapters import table
from .pdf_writer import Page, write
from .shared import shared_path

FILTERS = ("DCTDecode", "JPXDecode", None, "CCITTFaxDecode")
CUT = b"%PDF-1.4\n%cut\n"
_made: dict[tuple[str, str], str] = {}


def name_of(conv: int) -> str:
    return (f"Report {conv}.pdf", f"summary_{conv}.PDF", f"data-set_{conv}.pdf", f"notes_{conv}.txt", f"draft_{conv}.pdf")[conv % 5]


def page_of(conv: int, turn: int, text: str) -> Page:
    images = [((turn + 1) * (k == 0), 2, FILTERS[turn % 4] if k == 0 else None, "DeviceRGB", 8 * (turn % 2 == 0), b"x" * (turn + 1)) for k in range(turn % 3)]
    notes = [("Text", f"Note {conv} of {turn}", (10, 20, 30, 45))] if turn % 2 == 0 else []
    if turn % 4 == 0:
        notes += [(None, "untyped", None), ("Link", "", None)]
    return Page(text, images, notes, (0, 0, 600 + turn, 800) if conv % 2 == 0 else None, 90 * (turn % 4))


def file_of(conv: int, turns: list[tuple[int, str]]) -> bytes:
    """Valid files, but for drafts: every second one is empty, the others are cut off."""
    if conv % 5 == 4:
        return CUT if conv % 2 else b""
    info = {"Title": f" conversation {conv} ", "Author": "someone" if conv % 2 else "", "Subject": f"{len(turns)} pages", "Producer": "pagewright", "CreationDate": "D:20240102030405Z", "Keywords": "a; b,c", "Shelf": str(conv % 4)}
    return write([page_of(conv, turn, text or "") for turn, text in turns], info, packed=conv % 2 == 1)


def library(spark: SparkSession, sf_dir: str) -> str:
    """The library's folder; made at the first call."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _made:
        root = shared_path(spark, "library")

        def run(batches):
            for batch in batches:
                for conv, turns in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    store.write_bytes(f"{root}/f{conv % 4}/{name_of(conv)}", file_of(conv, [(t["turn"], t["text"]) for t in turns]))
                yield pa.RecordBatch.from_arrays([batch.column(0)], ["conv_id"])

        turns = F.array_sort(F.collect_list(F.struct(F.col("turn").cast("int").alias("turn"), "text")))
        books = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("turns"))
        books.mapInArrow(run, "conv_id long").agg(F.count(F.lit(1))).collect()
        _made[key] = root
    return _made[key]


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.listing(spark, library(spark, sf_dir))


def parsed(spark: SparkSession, sf_dir: str, fields=pdf.ALL) -> DataFrame:
    """Pages of all files that a listing takes for readable, cut off ones included."""
    from ..operators.search import list_files

    return pdf.parse(files.content_of(files.dealt(list_files(listed(spark, sf_dir)))), fields)


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readable pages with all fields, parsed once a session: extraction reads them once for every kind of element."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} pages")
    if key not in _made:
        path = shared_path(spark, "library-pages")
        parsed(spark, sf_dir).where("page_number is not null").write.parquet(path)
        _made[key] = path
    return spark.read.parquet(_made[key])
