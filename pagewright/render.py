"""Results as text for people: bounded, so it may gather what it shows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.text import shown

ADVICE = {
    "scanned_images": "Mostly scanned images; look at the images instead.",
    "mixed": "Text and images; the images may matter as well.",
    "no_content": "Nothing readable was found.",
}


def listing(df: DataFrame, title: str, columns: dict[str, str], first: int = 10) -> str:
    """A numbered list of the first rows, and how many more there are."""
    rows = df.limit(first).collect()
    total = df.count()
    out = [f"{title}: {total}"]
    for k, r in enumerate(rows, 1):
        out.append(f"{k}. " + ", ".join(f"{label} {r[c]}".lstrip() for c, label in columns.items() if r[c] is not None))
    if total > first:
        out.append(f"... and {total - first} more")
    return "\n".join(out)


def record(df: DataFrame, title: str) -> str:
    """The first row's fields that hold something, one a line."""
    row = df.first()
    lines = [title]
    for name, value in (row.asDict().items() if row else ()):
        if value not in (None, "", []):
            lines.append(f"{name.replace('_', ' ').capitalize()}: {value}")
    return "\n".join(lines)


def document(df: DataFrame) -> str:
    row = df.first()
    if row["error"]:
        return f"Error: {row['error']}"
    head = [f"File: {row['path']}", f"Pages: {row['pages']}", f"Size: {row['size']} bytes", f"Content type: {row['content_type']}"]
    if row["has_images"]:
        head.append(f"Images: {row['image_count']}")
    if row["content_type"] in ADVICE:
        head.append(ADVICE[row["content_type"]])
    return "\n".join(head) + "\n\n" + row["content"]


def search(found: DataFrame) -> str:
    return listing(found, "PDF files", {"name": ""})


def assets(images: DataFrame) -> str:
    return listing(images, "Images", {"page_number": "page", "width": "width", "height": "height", "format": "format", "size": "bytes"})


def validation(checked: DataFrame) -> str:
    row = checked.first()
    return f"{row['path']} is valid" if row["valid"] else f"{row['path']} is not valid: {row['message']}"


def file_stats(found: DataFrame) -> str:
    return record(found, "File")


def directory(found: DataFrame) -> str:
    return record(found, "Directory")


def server(info: DataFrame) -> str:
    """The catalogue by section; its size is fixed but for the first ten files."""
    out: dict[str, list[str]] = {}
    for r in info.collect():
        out.setdefault(r["section"], []).append(f"{r['key']}: {r['value']}" if r["value"] else r["key"])
    return "\n".join(f"{section}\n  " + "\n  ".join(lines) for section, lines in out.items())


def extraction(counts: DataFrame) -> str:
    return record(counts, "Elements")


def matches(found: DataFrame) -> str:
    """The first matches in page order, each with a preview of its text."""
    ordered = found.orderBy("path", "page_number", F.col("line_idx").asc_nulls_last(), "element_id")
    return listing(ordered.withColumn("text", shown(F.col("text"))), "Matches", {"page_number": "page", "text": "text:"})
