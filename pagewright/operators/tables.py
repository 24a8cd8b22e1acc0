"""Table inference: cluster elements into rows, take the most common row width.

A row is anchored: an element belongs to it while it lies within the tolerance of the
row's first element.  Estimated lines stand on a grid coarser than the tolerance, where
anchoring means equal heights; that is a plain grouping.  Boxes from elsewhere go
through a fold over each scope's elements in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..config import TableRules
from ..schema import ELEMENTS


def _scope(rules: TableRules) -> list[str]:
    return ["path"] if rules.scope == "document" else ["path", "page_number"]


def _text_elements(elements: DataFrame) -> DataFrame:
    return elements.where("type = 'text' and level = 0")


def grid_rows(elements: DataFrame, rules: TableRules = TableRules()) -> DataFrame:
    """row_index and col_index for elements whose heights are equal or further apart than the tolerance."""
    scope = _scope(rules)
    down = W.partitionBy(*scope).orderBy(F.col("lly").desc())
    across = W.partitionBy(*scope, "lly").orderBy("page_number", "line_idx", "element_id")
    return _text_elements(elements).withColumn("row_index", F.dense_rank().over(down) - 1).withColumn("col_index", F.row_number().over(across) - 1)


def anchored_rows(elements: DataFrame, rules: TableRules = TableRules()) -> DataFrame:
    """row_index and col_index for any boxes.

    Only the distinct heights of a scope are folded, one after the other as they stream past.
    """
    scope = _scope(rules)
    text = _text_elements(elements)
    heights = text.select(*[F.col(c).alias(f"h_{c}") for c in scope], F.col("lly").alias("y")).distinct()
    names, kinds = heights.columns, dict(heights.dtypes)
    in_order = heights.repartition(*names[:-1]).sortWithinPartitions(*names[:-1], F.desc("y"))
    placed = in_order.mapInArrow(lambda b: _folded(b, rules.row_tolerance), ", ".join([*(f"{c} {kinds[c]}" for c in names), "row_index int"]))
    on = [F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in scope] + [F.col("lly") == F.col("y")]
    joined = text.join(placed, on).drop(*names)
    across = W.partitionBy(*scope, "row_index").orderBy(F.col("lly").desc(), "page_number", F.col("line_idx").asc_nulls_first(), "element_id")
    return joined.withColumn("col_index", F.row_number().over(across) - 1)


def _folded(batches: Iterator[pa.RecordBatch], tolerance: float) -> Iterator[pa.RecordBatch]:
    """Adds the row of each height; a scope's heights come in falling order, and only its anchor is held."""
    current, anchor, row = None, 0.0, -1
    for batch in batches:
        out = []
        *keys, heights = (c.to_pylist() for c in batch.columns)
        for key, y in zip(zip(*keys), heights):
            if key != current:
                current, anchor, row = key, y, 0
            elif abs(anchor - y) > tolerance:
                anchor, row = y, row + 1
            out.append(row)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.int32())], [*batch.schema.names, "row_index"])


def row_widths(rows: DataFrame, rules: TableRules = TableRules()) -> DataFrame:
    """(scope, row_index, width)."""
    return rows.groupBy(*_scope(rules), "row_index").agg(F.count(F.lit(1)).alias("width"))


def structure(rows: DataFrame, rules: TableRules = TableRules()) -> DataFrame:
    """Most common width (of equally common ones the smallest), its share, and the sizes, by scope."""
    scope = _scope(rules)
    freq = row_widths(rows, rules).groupBy(*scope, "width").agg(F.count(F.lit(1)).alias("freq"))
    out = freq.groupBy(*scope).agg(
        F.min_by("width", F.struct(-F.col("freq"), F.col("width"))).alias("n_columns"), F.max("freq").alias("kept_rows"),
        F.sum("freq").alias("n_rows"), F.sum(F.col("freq") * F.col("width")).alias("n_elements"),
    )
    return out.withColumn("confidence", F.col("kept_rows") / F.col("n_rows"))


def detected(rows: DataFrame, rules: TableRules = TableRules()) -> DataFrame:
    """Structures that make a table: strictly above the threshold."""
    return structure(rows, rules).where(
        (F.col("n_elements") >= rules.least_elements) & (F.col("n_rows") >= rules.least_rows)
        & (F.col("confidence") >= rules.least_confidence) & (F.col("confidence") > rules.threshold)
    )


def rows_of(elements: DataFrame, rules: TableRules, grid: bool) -> DataFrame:
    return grid_rows(elements, rules) if grid else anchored_rows(elements, rules)


def tables(elements: DataFrame, rules: TableRules = TableRules(), grid: bool = False) -> DataFrame:
    """A row for each table: columns, rows kept, cells, header, confidence."""
    found = detected(rows_of(elements, rules, grid), rules)
    return found.select(*_scope(rules), "n_columns", F.col("kept_rows").alias("n_rows"), (F.col("n_columns") * F.col("kept_rows")).alias("cell_count"), F.lit(True).alias("has_headers"), "confidence")


def _kept(elements: DataFrame, rules: TableRules, grid: bool) -> DataFrame:
    """The text elements in rows of their table's width."""
    scope = _scope(rules)
    rows = rows_of(elements, rules, grid)
    found = detected(rows, rules).select(*[F.col(c).alias(f"f_{c}") for c in scope], "n_columns", F.col("confidence").alias("table_confidence"))
    width = F.count(F.lit(1)).over(W.partitionBy(*scope, "row_index"))
    on = [F.col(c) == F.col(f"f_{c}") for c in scope]
    return rows.withColumn("width_of_row", width).join(found, on).where(F.col("width_of_row") == F.col("n_columns"))


def cells(elements: DataFrame, rules: TableRules = TableRules(), grid: bool = False) -> DataFrame:
    """A row for each cell; rows of other widths go, the rest keep their index.  Only row 0 is a header."""
    scope = _scope(rules)
    return _kept(elements, rules, grid).select(
        *scope, F.col("row_index").cast("int").alias("row_index"), F.col("col_index").cast("int").alias("col_index"), (F.col("row_index") == 0).alias("is_header"),
        F.col("text").alias("content"), "llx", "lly", "urx", "ury", F.col("confidence").alias("confidence"), "table_confidence",
    )


def table_elements(elements: DataFrame, rules: TableRules = TableRules(), grid: bool = False) -> DataFrame:
    """Each table as an element of its own: the box around its cells, and its sizes as detail."""
    scope = _scope(rules)
    boxes = _kept(elements, rules, grid).groupBy(*scope).agg(
        F.min("llx").alias("llx"), F.min("lly").alias("lly"), F.max("urx").alias("urx"), F.max("ury").alias("ury"), F.first("table_confidence").alias("confidence"),
        F.count(F.lit(1)).alias("n"), F.first("n_columns").alias("columns"), *([] if "page_number" in scope else [F.min("page_number").alias("page_number")]),
    )
    detail = F.to_json(F.struct((F.col("n") / F.col("columns")).cast("long").alias("rows"), "columns", F.col("n").alias("cells"), F.lit(True).alias("has_headers")))
    given = {
        "element_id": F.format_string("table_%d_0", "page_number"), "level": F.lit(0), "type": F.lit("table"), "detail": detail,
        "width": F.col("urx") - F.col("llx"), "height": F.col("ury") - F.col("lly"),
    }
    kinds = dict(elements.dtypes)
    return boxes.select(*[given.get(c, F.col(c) if c in boxes.columns else F.lit(None)).cast(kinds[c]).alias(c) for c in ELEMENTS])


def with_tables(elements: DataFrame, rules: TableRules = TableRules(), grid: bool = False) -> DataFrame:
    """Complete mode: elements, and the tables found among their texts as elements of type ``table``."""
    return elements.select(*ELEMENTS).unionByName(table_elements(elements, rules, grid))


def semantic_groups(elements: DataFrame, distance: float = 20.0) -> DataFrame:
    """Grouping by proximity leaves elements as they are."""
    return elements
