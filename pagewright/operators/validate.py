"""Validation as data: the first failing rule's message, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _with_path(text: str, path: Column) -> Column:
    return F.concat(F.lit(text + ": "), path)


def _too_large(size: Column, limit: int) -> Column:
    return F.format_string(f"file too large: %d bytes (max: {limit} bytes)", size)


def message(
    path: Column, size: Column, is_dir: Column, limit: int, *, require_ext: bool = True, allow_empty: bool = False,
    check_path: bool = False, parse_error: Column | None = None,
) -> Column:
    """One chain for all gates.  A null size means that the file does not exist."""
    rules: list[tuple[Column, Column]] = []
    if check_path:
        rules.append((F.coalesce(path, F.lit("")) == "", F.lit("path cannot be empty")))
        rules.append((size.isNull() & ~F.coalesce(is_dir, F.lit(False)), _with_path("file does not exist", path)))
    rules.append((F.coalesce(is_dir, F.lit(False)), _with_path("path is a directory, not a file", path)))
    if require_ext:
        rules.append((~F.endswith(F.lower(path), F.lit(".pdf")), _with_path("file is not a PDF", path)))
    if not allow_empty:
        rules.append((size == 0, _with_path("file is empty", path)))
    rules.append((size > limit, _too_large(size, limit)))
    if parse_error is not None:
        rules.append((parse_error.isNotNull(), F.concat(F.lit("invalid PDF file: "), parse_error)))
    chain = None
    for condition, text in rules:
        chain = F.when(condition, text) if chain is None else chain.when(condition, text)
    return chain


def listing_message(limit: int) -> Column:
    """The gate of listings: a file with the extension, not empty, within the limit."""
    return message(F.col("path"), F.col("size"), F.col("is_dir"), limit)


def reader_message(limit: int) -> Column:
    """The reader's gate lets empty files through."""
    return message(F.col("path"), F.col("size"), F.col("is_dir"), limit, allow_empty=True)


def extraction_message(limit: int) -> Column:
    """The extraction gate asks neither for the extension nor for contents."""
    return message(F.col("path"), F.col("size"), F.col("is_dir"), limit, require_ext=False, allow_empty=True, check_path=True)


def validate(files: DataFrame, parsed: DataFrame | None, limit: int) -> DataFrame:
    """(path, valid, message) for every listed path; parsed gives the errors of those that were opened."""
    base = files.select("path", "size", "is_dir")
    error = None
    if parsed is not None:
        errors = parsed.groupBy(F.col("path").alias("e_path")).agg(F.max(F.when(F.col("page_number").isNull(), F.col("error"))).alias("parse_error"))
        base = base.join(errors, F.col("path") == F.col("e_path"), "left")
        error = F.col("parse_error")
    text = message(F.col("path"), F.col("size"), F.col("is_dir"), limit, check_path=True, parse_error=error)
    return base.select("path", text.isNull().alias("valid"), F.coalesce(text, F.lit("")).alias("message"))
