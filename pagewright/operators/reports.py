"""Results as lines of text, by file: (path, line, text), for any number of files and with nothing on the driver.

Each format is a relation over the operators' results.  Lists show their first entries and how many
more there are; the entries are taken by a limited rank a path, so a file with millions of them is
no burden.  Texts with line ends become several lines, in order; ``part`` is their place in it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import shown
from ..render import ADVICE

FIRST = 10  # entries that a list shows


def _lines(df: DataFrame, texts: Column) -> DataFrame:
    """A row a text of the list, numbered."""
    return df.select("path", F.posexplode(texts).alias("line", "text"))


def as_lines(texts: DataFrame) -> DataFrame:
    """(path, line, text) with a row for each line of a text; numbers go on from one text to the next."""
    split = texts.select("path", "line", F.posexplode(F.split("text", "\n")).alias("part", "text"))
    number = F.row_number().over(W.partitionBy("path").orderBy("line", "part")) - 1
    return split.select("path", number.alias("line"), "text")


def list_lines(df: DataFrame, title: str, columns: dict[str, str], order: Sequence[Column], first: int = FIRST) -> DataFrame:
    """A title with the number of rows, the first rows with their labelled columns, and how many more there are; by path."""
    shown_columns = [F.when(F.col(c).isNotNull(), F.trim(F.concat(F.lit(f"{label} "), F.col(c).cast("string")))) for c, label in columns.items()]
    ranked = df.withColumn("line", F.row_number().over(W.partitionBy("path").orderBy(*order))).where(F.col("line") <= first)
    entries = ranked.select("path", "line", F.concat(F.col("line").cast("string"), F.lit(". "), F.array_join(F.array_compact(F.array(*shown_columns)), ", ")).alias("text"))
    counts = df.groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    head = counts.select("path", F.lit(0).alias("line"), F.concat(F.lit(f"{title}: "), F.col("n").cast("string")).alias("text"))
    more = counts.where(F.col("n") > first).select("path", F.lit(first + 1).alias("line"), F.concat(F.lit("... and "), (F.col("n") - first).cast("string"), F.lit(" more")).alias("text"))
    return head.unionByName(entries).unionByName(more)


def record_lines(df: DataFrame, title: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A title and a line for each column that holds something; a row a path."""
    names = [c for c in (columns or df.columns)]
    kinds = dict(df.dtypes)

    def line(c: str) -> Column:
        value = F.array_join(F.transform(F.col(c), lambda x: x.cast("string")), ", ") if kinds[c].startswith("array") else F.col(c).cast("string")
        return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(f"{c.replace('_', ' ').capitalize()}: "), value))

    return _lines(df, F.array_compact(F.array(F.lit(title), *map(line, names))))


def document(read: DataFrame) -> DataFrame:
    """Of ``reading.read_documents``: what a file is, advice, and its text; or its error."""
    advice = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])[F.col("content_type")]
    fields = {"File": F.col("path"), "Pages": F.col("pages"), "Size": F.concat(F.col("size").cast("string"), F.lit(" bytes")), "Content type": F.col("content_type"), "Images": F.when(F.col("has_images"), F.col("image_count"))}
    head = [F.concat(F.lit(f"{k}: "), v.cast("string")) for k, v in fields.items()]
    whole = F.array_compact(F.array(*head, advice, F.lit(""), F.coalesce("content", F.lit(""))))
    return as_lines(_lines(read, F.when(F.col("error").isNotNull(), F.array(F.concat(F.lit("Error: "), F.col("error")))).otherwise(whole)))


def search(listed: DataFrame) -> DataFrame:
    """Listed files by folder: a folder's report is under its path."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return list_lines(listed.withColumn("path", folder), "PDF files", {"name": ""}, [F.col("name")])


def assets(images: DataFrame) -> DataFrame:
    return list_lines(images, "Images", {"page_number": "page", "width": "width", "height": "height", "format": "format", "size": "bytes"}, [F.col("page_number"), F.col("image_idx")] if "image_idx" in images.columns else [F.col("page_number"), F.col("width")])


def validation(checked: DataFrame) -> DataFrame:
    text = F.when(F.col("valid"), F.concat("path", F.lit(" is valid"))).otherwise(F.concat("path", F.lit(" is not valid: "), F.coalesce("message", F.lit(""))))
    return checked.select("path", F.lit(0).alias("line"), text.alias("text"))


def file_stats(found: DataFrame) -> DataFrame:
    return record_lines(found, "File")


def directory(found: DataFrame) -> DataFrame:
    """Of ``stats.directory_stats`` by directory."""
    return record_lines(found.withColumnRenamed("directory", "path"), "Directory", [c for c in found.columns if c != "directory"])


def server(info: DataFrame) -> DataFrame:
    """The catalogue, a report a section."""
    entry = F.when(F.col("value") != "", F.concat("key", F.lit(": "), "value")).otherwise(F.col("key"))
    order = W.partitionBy("section").orderBy("key", "value")
    return info.select(F.col("section").alias("path"), (F.row_number().over(order) - 1).alias("line"), entry.alias("text"))


def extraction(counts: DataFrame) -> DataFrame:
    return record_lines(counts, "Elements", [c for c in counts.columns if c != "path"])


def matches(found: DataFrame) -> DataFrame:
    """The first matches in page order, each with a preview of its text."""
    order = [F.col("page_number"), F.col("line_idx").asc_nulls_last(), F.col("element_id")]
    return as_lines(list_lines(found.withColumn("text", shown(F.col("text"))), "Matches", {"page_number": "page", "text": "text:"}, order))
