"""The driver's tables as page and file relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import byte_length


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a document, each turn a page."""
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("path"), (F.col("turn") + 1).cast("int").alias("page_number"), "text")


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document is a file of its size, in its source's directory."""
    d = table(spark, sf_dir, "documents")
    name = F.concat(F.lpad(F.col("doc_id").cast("string"), 12, "0"), F.lit(".pdf"))
    return d.select("doc_id", F.col("source").alias("directory"), F.concat_ws("/", "source", name).alias("path"), name.alias("name"), byte_length(F.coalesce("text", F.lit(""))).alias("size"), F.lit(False).alias("is_dir"))


def part_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as file names."""
    p = table(spark, sf_dir, "part")
    name = F.concat("p_name", F.lit(".pdf"))
    return p.select("p_partkey", name.alias("path"), name.alias("name"), F.col("p_size").cast("long").alias("size"), F.lit(False).alias("is_dir"))
