"""Aggregates over files and documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import timestamp_text
from .search import walk_key


def size_summary(size: Column, name: Column, order: Column) -> list[Column]:
    """Count, total, average and the extremes; of equal sizes the first in order names them."""
    total = F.coalesce(F.sum(size), F.lit(0)).cast("long")
    count = F.count(F.lit(1))
    average = F.when(count > 0, F.floor(total / F.greatest(count, F.lit(1)))).otherwise(0)
    return [
        count.alias("total_files"),
        total.alias("total_size"),
        F.coalesce(F.max(size), F.lit(0)).cast("long").alias("largest_size"),
        F.min_by(name, F.struct(-size, order)).alias("largest_name"),
        F.coalesce(F.min(size), F.lit(0)).cast("long").alias("smallest_size"),
        F.min_by(name, F.struct(size, order)).alias("smallest_name"),
        average.cast("long").alias("average_size"),
    ]


def directory_stats(files: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row, or a row for each value of ``by``.  Partial aggregates, so one hot directory is no burden."""
    summary = size_summary(F.col("size"), F.col("name"), walk_key(F.col("path")))
    return (files.groupBy(*by) if by else files).agg(*summary)


def page_counts(pages: DataFrame) -> DataFrame:
    return pages.groupBy("path").agg(F.count(F.lit(1)).alias("pages"))


def file_stats(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Size, pages, dates and document information of each file that could be opened."""
    trimmed = lambda k: F.nullif(F.trim(F.element_at("info", k)), F.lit(""))
    doc = parsed.groupBy("path").agg(
        F.max("n_pages").alias("pages"), F.first("info", True).alias("info"),
        F.max(F.when(F.col("page_number").isNull(), F.col("error"))).alias("error"),
    ).where("error is null").withColumnRenamed("path", "d_path")
    return files.join(doc, F.col("path") == F.col("d_path")).select(
        "path", "size", F.col("pages"), timestamp_text(F.col("modified_time")).alias("modified_date"),
        trimmed("Title").alias("title"), trimmed("Author").alias("author"), trimmed("Subject").alias("subject"),
        trimmed("Producer").alias("producer"), trimmed("CreationDate").alias("created_date"),
    )
