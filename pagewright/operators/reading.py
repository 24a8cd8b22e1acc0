"""Text of documents: page-ordered assembly under a byte cap, and content types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import MAX_TEXT_BYTES, PAGE_BREAK
from ..functions.text import byte_length, cut_bytes, is_blank, trim_unicode

LEAST_TEXT = 50
NO_TEXT = "no text content could be extracted from PDF"


def capped_pages(pages: DataFrame, cap: int = MAX_TEXT_BYTES) -> DataFrame:
    """Pages up to the one whose running byte count passes the cap; that one is cut to fit.

    Pages without text (their extraction failed) are left out and count nothing.
    """
    upto = W.partitionBy("path").orderBy("page_number").rowsBetween(W.unboundedPreceding, W.currentRow)
    size = byte_length(F.col("text"))
    running = pages.where("text is not null").withColumn("__size", size)
    running = running.withColumn("__upto", F.sum("__size").over(upto))
    before = F.col("__upto") - F.col("__size")
    room = F.lit(cap) - before
    cut = F.when(F.col("__upto") <= cap, F.col("text")).otherwise(cut_bytes(F.col("text"), room))
    kept = running.where(before <= cap).withColumn("truncated", F.col("__upto") > cap).withColumn("text", cut)
    return kept.withColumn("text_bytes", F.least("__size", room)).drop("__upto", "__size")


def content_type(text: Column, has_images: Column) -> Column:
    """By bytes of text left without page breaks and outer white space."""
    meaningful = trim_unicode(F.replace(trim_unicode(F.coalesce(text, F.lit(""))), F.lit(PAGE_BREAK.strip()), F.lit("")))
    enough = F.octet_length(meaningful) >= LEAST_TEXT
    images = F.coalesce(has_images, F.lit(False))
    return (
        F.when(enough & images, "mixed").when(enough, "text").when(images, "scanned_images").otherwise("no_content")
    )


def document_texts(pages: DataFrame, cap: int = MAX_TEXT_BYTES) -> DataFrame:
    """(path, pages, content): page texts in order, a break after each one that has a successor.

    The cap bounds what is gathered for one document, however many pages it has.
    """
    counts = pages.groupBy(F.col("path").alias("c_path")).agg(F.max("page_number").alias("last_page"), F.count(F.lit(1)).alias("pages"))
    kept = capped_pages(pages, cap).join(counts, F.col("path") == F.col("c_path"))
    broken = F.when((F.col("page_number") < F.col("last_page")) & ~F.col("truncated"), F.concat("text", F.lit(PAGE_BREAK))).otherwise(F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("page_number", broken.alias("part"))))
    texts = kept.groupBy("path").agg(F.concat_ws("", F.transform(parts, lambda p: p["part"])).alias("content"))
    return counts.join(texts, F.col("c_path") == F.col("path"), "left").select(F.col("c_path").alias("path"), "pages", F.coalesce("content", F.lit("")).alias("content"))


def image_counts(parsed: DataFrame) -> DataFrame:
    """All image objects of each document, of any size."""
    return parsed.groupBy("path").agg(F.coalesce(F.sum(F.coalesce(F.size("images"), F.lit(0))), F.lit(0)).cast("long").alias("image_count"))


def read_documents(parsed: DataFrame, cap: int = MAX_TEXT_BYTES) -> DataFrame:
    """(path, content, pages, size, content_type, has_images, image_count, error).

    A document without any text keeps its row and content type; ``error`` says so.
    """
    texts = F.when(F.col("page_number").isNotNull(), F.col("text"))
    rows = parsed.select("path", "page_number", texts.alias("text"), "size", F.coalesce(F.size("images"), F.lit(0)).alias("n_images"), F.when(F.col("page_number").isNull(), F.col("error")).alias("open_error"))
    # one pass: files are parsed once, and their pages dealt by path once
    upto = W.partitionBy("path").orderBy("page_number").rowsBetween(W.unboundedPreceding, W.currentRow)
    bytes_ = byte_length(F.col("text"))
    running = rows.withColumn("__upto", F.sum(bytes_).over(upto))
    before, whole = F.col("__upto") - bytes_, F.col("__upto") <= cap
    part = F.struct("page_number", F.when(whole, F.col("text")).otherwise(cut_bytes(F.col("text"), F.lit(cap) - before)).alias("part"), whole.alias("whole"))
    of = running.groupBy("path").agg(
        F.max("size").alias("size"), F.sum("n_images").cast("long").alias("image_count"), F.max("open_error").alias("open_error"), F.max("page_number").alias("last_page"),
        F.count("page_number").alias("pages"), F.array_sort(F.collect_list(F.when(F.col("text").isNotNull() & (before <= cap), part))).alias("parts"),
    )
    broken = F.transform("parts", lambda p: F.when((p["page_number"] < F.col("last_page")) & p["whole"], F.concat(p["part"], F.lit(PAGE_BREAK))).otherwise(p["part"]))
    of = of.withColumn("content", F.concat_ws("", broken))
    has = F.coalesce(F.col("image_count") > 0, F.lit(False))
    empty = F.when(F.col("open_error").isNotNull(), F.concat(F.lit("failed to open PDF: "), "open_error")).when(F.col("content") == "", F.lit(f"failed to extract text content: {NO_TEXT}"))
    return of.select(
        "path", "content", "pages", "size",
        content_type(F.col("content"), has).alias("content_type"), has.alias("has_images"), F.coalesce("image_count", F.lit(0)).alias("image_count"), empty.alias("error"),
    )


def page_has_text() -> Column:
    return F.col("text").isNotNull() & ~is_blank(F.col("text"))
