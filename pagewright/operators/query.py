"""Queries over elements and summaries of what they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Box, Query
from ..functions.text import contains_folded


def intersects(box: Box) -> Column:
    """Closed boxes: touching counts."""
    return ~((F.col("urx") < box.llx) | (F.col("llx") > box.urx) | (F.col("ury") < box.lly) | (F.col("lly") > box.ury))


def says(text: str) -> Column:
    """Only texts and annotations can contain a text."""
    return F.col("type").isin("text", "annotation") & F.coalesce(contains_folded(F.col("text"), text), F.lit(False))


def predicate(q: Query) -> Column:
    out = F.lit(True)
    if q.types:
        out &= F.col("type").isin(*q.types)
    if q.pages:
        out &= F.col("page_number").isin(*q.pages)
    if q.min_confidence > 0:
        out &= F.col("confidence") >= q.min_confidence
    if q.box is not None:
        out &= intersects(q.box)
    if q.text:
        out &= says(q.text)
    return out


def query(elements: DataFrame, q: Query) -> DataFrame:
    """Top-level elements that meet all conditions."""
    return elements.where((F.col("level") == 0) & predicate(q))


def of_type(elements: DataFrame, kind: str) -> DataFrame:
    return elements.where(F.col("type") == kind)


CELL = 256.0


def box_join(elements: DataFrame, boxes: DataFrame, cell: float = CELL) -> DataFrame:
    """(box_id, element columns) for every box an element touches; boxes: box_id, q_llx, q_lly, q_urx, q_ury.

    Both sides are laid on a grid and joined on its cells, so the number of boxes may
    grow; a pair is kept only in the cell that holds the lower left corner of its
    overlap, so none appears twice.
    """
    at = lambda c: F.floor(F.col(c) / cell).cast("int")
    over = lambda a, b: F.explode(F.sequence(at(a), at(b)))
    e = elements.withColumn("__gx", over("llx", "urx")).withColumn("__gy", over("lly", "ury"))
    b = boxes.withColumn("__bx", over("q_llx", "q_urx")).withColumn("__by", over("q_lly", "q_ury"))
    overlap = (F.col("urx") >= F.col("q_llx")) & (F.col("llx") <= F.col("q_urx")) & (F.col("ury") >= F.col("q_lly")) & (F.col("lly") <= F.col("q_ury"))
    once = (F.col("__gx") == F.floor(F.greatest("llx", "q_llx") / cell)) & (F.col("__gy") == F.floor(F.greatest("lly", "q_lly") / cell))
    joined = e.join(b, (F.col("__gx") == F.col("__bx")) & (F.col("__gy") == F.col("__by")) & overlap & once)
    return joined.drop("__gx", "__gy", "__bx", "__by", "q_llx", "q_lly", "q_urx", "q_ury")


def counts_by_type(elements: DataFrame, by: str = "path") -> DataFrame:
    """Top-level elements by type.  Tables are not elements, so they never count."""
    kind = lambda k: F.count_if(F.col("type") == k).alias(f"{k}_elements")
    return elements.where("level = 0").groupBy(by).agg(kind("text"), kind("image"), kind("vector"), kind("form"), kind("annotation"), F.count(F.lit(1)).alias("total_elements"))


def summary(found: DataFrame) -> DataFrame:
    """Long form: a row for each type, for each page, and one over all (also of nothing)."""
    sets = found.groupingSets([["type"], ["page_number"]], "type", "page_number").agg(
        F.count(F.lit(1)).alias("n"), F.sum("confidence").alias("__sum"), F.grouping("type").alias("__t"),
    )
    kind = F.when(F.col("__t") == 0, "type").otherwise("page")
    key = F.when(F.col("__t") == 0, F.col("type")).otherwise(F.col("page_number").cast("string"))
    parts = sets.select(kind.alias("kind"), key.alias("key"), "n", "__sum")
    # the whole is the sum over types, whose exchange is used again
    whole = parts.where("kind = 'type'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("__sum"), F.lit(0.0)).alias("__sum"))
    rows = parts.unionByName(whole.select(F.lit("all").alias("kind"), F.lit("").alias("key"), "n", "__sum"))
    return rows.select("kind", "key", "n", F.when(F.col("n") > 0, F.col("__sum") / F.col("n")).otherwise(0.0).alias("avg_confidence"))


def extraction_summary(elements: DataFrame) -> DataFrame:
    """(path, page_number, type, n, quality): the page breakdown; quality is a constant."""
    return elements.where("level = 0").groupBy("path", "page_number", "type").agg(F.count(F.lit(1)).alias("n")).withColumn("quality", F.lit("medium"))
