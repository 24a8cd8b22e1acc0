"""Parsed PDF files as rows: the one place where documents cross into Python.

``parse`` gives a row a page (schema.PARSED).  A file that cannot be opened gives one row
without a page number and with the error; a page that cannot be read keeps its row with
its own error.  Only the fields asked for are computed, as no optimizer can look inside.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from ..schema import PARSED
from .pdf_objects import Document, PdfError, Stream
from .pdf_text import numbers, page_text, text_string

HELD, ROWS = 1 << 20, 2048  # bytes of files and their texts, and pages, that small files share a batch of
ALL = ("text", "images", "annotations", "info")


def _images(doc: Document, page: dict, with_data: bool) -> list[dict]:
    resources = doc.resolve(page.get("Resources", page["inherited"].get("Resources")))
    objects = doc.resolve(resources.get("XObject")) if isinstance(resources, dict) else None
    out = []
    for name in sorted(objects) if isinstance(objects, dict) else []:
        x = doc.resolve(objects[name])
        if not isinstance(x, Stream) or doc.resolve(x.dict.get("Subtype")) != "Image":
            continue
        get = lambda *keys: next((v for k in keys if (v := doc.resolve(x.dict.get(k))) is not None), None)  # noqa: B023, E731
        integer = lambda v: int(v) if isinstance(v, (int, float)) else None
        filters, space = get("Filter"), get("ColorSpace")
        last = doc.resolve(filters[-1]) if isinstance(filters, list) and filters else filters
        out.append({
            "name": str(name), "width": integer(get("Width")), "height": integer(get("Height")), "filter": str(last) if isinstance(last, str) else None,
            "color_space": str(space) if isinstance(space, str) else None, "bits": integer(get("BitsPerComponent")), "data": x.raw if with_data else None,
        })
    return out


def _annotations(doc: Document, page: dict) -> list[dict]:
    out = []
    for ref in doc.resolve(page.get("Annots")) or []:
        a = doc.resolve(ref)
        if isinstance(a, dict):
            kind = doc.resolve(a.get("Subtype"))
            out.append({"subtype": None if kind is None else str(kind), "contents": text_string(doc.resolve(a.get("Contents"))), "rect": numbers(doc, a.get("Rect"), 4)})
    return out


def read_pages(data: bytes, fields: Sequence[str] = ALL, pages: Sequence[int] = (), image_data: bool = True) -> Iterator[dict]:
    """Rows (without path and size) of one file; never raises for bad files."""
    try:
        doc = Document.open(data)
        listed = list(doc.pages())
        info = doc.resolve(doc.trailer.get("Info")) if "info" in fields else None
        info = {str(k): t for k, v in info.items() if (t := text_string(doc.resolve(v))) is not None} if isinstance(info, dict) else {}
        if doc.encrypted:
            raise PdfError("encrypted PDF")
        if not listed:
            raise PdfError("malformed PDF: no pages")
    except (PdfError, RecursionError, ValueError, TypeError, KeyError, IndexError, AttributeError) as e:
        yield {"error": str(e) or type(e).__name__, "encrypted": "encrypted" in str(e)}
        return
    whole = {"n_pages": len(listed), "info": info, "version": doc.version, "encrypted": False}
    wanted = set(pages)
    for number, page in enumerate(listed, 1):
        if wanted and number not in wanted:
            continue
        row = whole | {"page_number": number, "text": None, "images": [], "annotations": [], "error": None}
        try:
            own = numbers(doc, page.get("MediaBox"), 4)
            row["own_media_box"], row["media_box"] = own is not None, own or numbers(doc, page["inherited"].get("MediaBox"), 4)
            row["crop_box"] = numbers(doc, page.get("CropBox", page["inherited"].get("CropBox")), 4)
            turn = doc.resolve(page.get("Rotate", page["inherited"].get("Rotate")))
            row["rotation"] = int(turn) if isinstance(turn, (int, float)) else 0
            if "images" in fields:
                row["images"] = _images(doc, page, image_data)
            if "annotations" in fields:
                row["annotations"] = _annotations(doc, page)
            if "text" in fields:
                row["text"] = page_text(doc, page)
        except (PdfError, RecursionError, ValueError, TypeError, KeyError, IndexError, AttributeError) as e:
            row["error"] = f"page {number}: {e}"
        yield row


def parse(files: DataFrame, fields: Sequence[str] = ALL, pages: Sequence[int] = (), image_data: bool = True) -> DataFrame:
    """files: path, content (binary).  Rows by file and page; a file is held by one task at a time."""

    schema = to_arrow_schema(_parse_datatype_string(PARSED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                path, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py() or b""
                rows = [{"path": path, "size": len(data)} | r | {"info": list(r.get("info", {}).items())} for r in read_pages(data, fields, pages, image_data)]
                held += rows
                size += len(data) + sum(len(r.get("text") or "") for r in rows)
                if size >= HELD or len(held) >= ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema=schema)
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=schema)

    return files.select("path", "content").mapInArrow(run, PARSED)
