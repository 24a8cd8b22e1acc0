"""Grouping by proximity: elements of a page whose boxes are near each other, directly or by way of others.

Two boxes are near if the gap between them, straight across, is at most the distance.

1. Equal boxes of a page are one node.
2. Boxes whose lower left corners share a cell of side distance / sqrt(2) are near for certain:
   they take the least of them as their label, with no pair in sight.
3. Boxes are laid on a coarser grid, joined by its cells, and checked exactly; what stays is which
   labels are near, each pair of labels once.
4. Labels become groups by repeated least labels: every label takes the least one near it, then the
   label of its label, until none changes.  A round is a table in the shared folder.

All keys begin with page and node, so pages spread over tasks, and no page is gathered in one.
Joins are told to merge: written tables of numbers are small as files and many times that as rows,
and by their files' size Spark would collect and broadcast them by way of the driver.

Defined cases: elements without a path, a page or a finite box are groups of their own; corners
in the wrong order are put right; elements that are equal in id and box stay rows of their own;
without elements there are no groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import remove, written

DISTANCE = 20.0  # fixed value: the threshold that clients know
CELL, MOST_CELLS, FARTHEST = 64.0, 16, 1e9
PAGE = ["path", "page_number"]
MERGE = "shuffle_merge"
CORNERS = ["x0", "y0", "x1", "y1"]


def _boxed(elements: DataFrame) -> DataFrame:
    """elements with corners in order; null where there is no finite box on a page."""
    least, most = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    placed = F.col("path").isNotNull() & F.col("page_number").isNotNull()
    for c in ("llx", "lly", "urx", "ury"):
        placed = placed & F.coalesce(F.abs(c) <= FARTHEST, F.lit(False))  # a NaN is larger than any number
    pairs = (least("llx", "urx"), least("lly", "ury"), most("llx", "urx"), most("lly", "ury"))
    return elements.select("*", *[F.when(placed, v).alias(n) for n, v in zip(CORNERS, pairs)])


def _nodes(boxed: DataFrame, distance: float) -> DataFrame:
    """(page, node, corners, label): distinct boxes, numbered within their page, with the least node sharing their corner's cell."""
    distinct = boxed.where("x0 is not null").select(*PAGE, *CORNERS).distinct()
    numbered = distinct.withColumn("node", F.row_number().over(W.partitionBy(*PAGE).orderBy(*CORNERS)))
    side = max(distance, 1e-9) / 2**0.5 * (1 - 1e-12)
    return numbered.withColumn("label", F.min("node").over(W.partitionBy(*PAGE, F.floor(F.col("x0") / side), F.floor(F.col("y0") / side))))


def near_labels(nodes: DataFrame, distance: float, cell: float = CELL) -> DataFrame:
    """(page, u, v): labels of boxes that are near, u > v, each pair once."""
    extent = nodes.groupBy(*PAGE).agg(F.greatest(F.max("x1") - F.min("x0"), F.max("y1") - F.min("y0")).alias("extent"))
    # a page of any size has cells of which no box covers more than MOST_CELLS or so each way
    sized = nodes.join(extent.select(*[F.col(c).alias(f"e_{c}") for c in PAGE], F.greatest(F.lit(cell), F.lit(2 * distance), F.col("extent") / MOST_CELLS).alias("cell")).hint(MERGE), [F.col(c) == F.col(f"e_{c}") for c in PAGE])
    at = lambda c, by: F.floor((F.col(c) + by) / F.col("cell"))
    over = lambda a, b, by: F.explode(F.sequence(at(a, -by), at(b, by)))
    half = distance / 2  # boxes that are near touch when either grows by half of it
    laid = sized.select(*PAGE, "node", "label", *CORNERS, "cell", over("x0", "x1", half).alias("gx")).select("*", over("y0", "y1", half).alias("gy"))
    other = laid.select(*[F.col(c).alias(f"o_{c}") for c in (*PAGE, "node", "label", *CORNERS, "gx", "gy")])
    on = [F.col(c) == F.col(f"o_{c}") for c in (*PAGE, "gx", "gy")]
    across = F.greatest(F.lit(0.0), F.col("o_x0") - F.col("x1"), F.col("x0") - F.col("o_x1"))
    up = F.greatest(F.lit(0.0), F.col("o_y0") - F.col("y1"), F.col("y0") - F.col("o_y1"))
    near = (F.col("label") > F.col("o_label")) & (across * across + up * up <= distance * distance)
    met = laid.join(other.hint(MERGE), [*on, near])
    return met.select(*PAGE, F.col("label").alias("u"), F.col("o_label").alias("v")).distinct()


def _least_labels(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(page, node, label): each label's least label in reach."""
    spark = nodes.sparkSession
    same = lambda prefix: [F.col(c) == F.col(f"{prefix}_{c}") for c in PAGE]
    named = lambda df, prefix: df.select(*[F.col(c).alias(f"{prefix}_{c}") for c in df.columns])
    links, links_path = written(links.unionByName(links.select(*PAGE, F.col("v").alias("u"), F.col("u").alias("v"))), "proximity-links")
    labels, path = written(nodes.select(*PAGE, F.col("label").alias("node"), "label").distinct(), "proximity-labels")
    while True:
        offered = links.join(named(labels, "l").hint(MERGE), [*same("l"), F.col("v") == F.col("l_node")]).groupBy(*PAGE, "u").agg(F.min("l_label").alias("least"))
        met = labels.join(named(offered, "o").hint(MERGE), [*same("o"), F.col("node") == F.col("o_u")], "left")
        taken = met.select(*PAGE, "node", "label", F.least("label", F.coalesce("o_least", "label")).alias("now"))
        of = taken.select(*[F.col(c).alias(f"t_{c}") for c in PAGE], F.col("node").alias("t_node"), F.col("now").alias("t_now"))
        jumped = taken.join(of.hint(MERGE), [*same("t"), F.col("now") == F.col("t_node")]).select(*PAGE, "node", F.col("t_now").alias("label"), (F.col("t_now") != F.col("label")).alias("changed"))
        seen = Observation()
        after, after_path = written(jumped.observe(seen, F.count_if("changed").alias("n")).drop("changed"), "proximity-labels")
        remove(spark, path)
        labels, path = after, after_path
        if not seen.get["n"]:
            remove(spark, links_path)
            return labels


def groups(elements: DataFrame, distance: float = DISTANCE, cell: float = CELL) -> DataFrame:
    """elements with group_id, the least element id among those in reach on the page, and group_size."""
    boxed = _boxed(elements)
    nodes, path = written(_nodes(boxed, distance), "proximity-nodes")
    reached = _least_labels(nodes, near_labels(nodes, distance, cell)).select(*[F.col(c).alias(f"r_{c}") for c in PAGE], F.col("node").alias("r_node"), F.col("label").alias("r_label"))
    of = nodes.join(reached.hint(MERGE), [*[F.col(c) == F.col(f"r_{c}") for c in PAGE], F.col("label") == F.col("r_node")])
    of = of.select(*[F.col(c).alias(f"n_{c}") for c in (*PAGE, *CORNERS)], F.col("r_label").alias("__group"))
    joined = boxed.where("x0 is not null").join(of.hint(MERGE), [F.col(c) == F.col(f"n_{c}") for c in (*PAGE, *CORNERS)])
    members = W.partitionBy(*PAGE, "__group")
    grouped = joined.select(*elements.columns, F.min("element_id").over(members).alias("group_id"), F.count(F.lit(1)).over(members).alias("group_size"))
    alone = boxed.where("x0 is null").select(*elements.columns, F.col("element_id").alias("group_id"), F.lit(1).cast("long").alias("group_size"))
    return grouped.unionByName(alone)


def regions(grouped: DataFrame) -> DataFrame:
    """(page, group_id, n_elements, box, text): a row a group, its texts in reading order."""
    order = F.struct((-F.col("ury")).alias("down"), "llx", "element_id")
    said = F.array_sort(F.collect_list(F.when(F.col("text").isNotNull(), F.struct(order.alias("at"), "text"))))
    out = grouped.groupBy(*PAGE, "group_id").agg(F.count(F.lit(1)).alias("n_elements"), F.min("llx").alias("llx"), F.min("lly").alias("lly"), F.max("urx").alias("urx"), F.max("ury").alias("ury"), said.alias("said"))
    return out.select(*PAGE, "group_id", "n_elements", "llx", "lly", "urx", "ury", F.array_join(F.transform("said", lambda s: s["text"]), "\n").alias("text"))
