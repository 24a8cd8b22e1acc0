"""Table functions for SQL text: anchored rows over ordered partitions, and shell patterns by LATERAL.

    SELECT * FROM anchored_rows(TABLE(elements), 5.0)
    SELECT name, pattern FROM files, LATERAL glob_matches(name, array('*.pdf', 'r*'))

``anchored_rows`` asks for partitions by path and rows from the top itself, so Spark deals and sorts them, and holds
the anchor of the current row alone.  ``analyze`` gives its columns: those of its table, and ``row_index``.
"""

from __future__ import annotations

import re

from pyspark.sql import Row, SparkSession
from pyspark.sql.types import IntegerType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from .text import glob_regex

TOLERANCE = 5.0  # fixed value: how far from its first element a row reaches


class AnchoredRows:
    """Rows of elements that lie within the tolerance of the first one's height."""

    @staticmethod
    def analyze(elements: AnalyzeArgument, tolerance: AnalyzeArgument | None = None) -> AnalyzeResult:
        if not elements.isTable or not {"path", "lly"} <= set(elements.dataType.names):
            raise ValueError("anchored_rows needs a table with path and lly")
        schema = StructType(list(elements.dataType.fields)).add("row_index", IntegerType())
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn("path")], orderBy=[OrderingColumn("lly", ascending=False)])

    def __init__(self) -> None:
        self.anchor: float | None = None
        self.row = -1

    def eval(self, elements: Row, tolerance: float = TOLERANCE):
        if self.row < 0 or abs(self.anchor - elements["lly"]) > float(tolerance):
            self.anchor, self.row = elements["lly"], self.row + 1
        yield (*elements, self.row)


class GlobMatches:
    """The patterns of a list that match a name, whole and case by case; malformed ones match nothing."""

    def __init__(self) -> None:
        self.known: dict[str, re.Pattern | None] = {}

    def _compiled(self, pattern: str) -> re.Pattern | None:
        if pattern not in self.known:
            if len(self.known) > 1000:  # patterns may come from a table
                self.known.clear()
            text = glob_regex(pattern)
            self.known[pattern] = re.compile(text.removesuffix("$") + r"\Z") if text is not None else None
        return self.known[pattern]

    def eval(self, name: str, patterns: list):
        for pattern in patterns or () if name is not None else ():
            compiled = self._compiled(pattern) if pattern is not None else None
            if compiled is not None and compiled.match(name):
                yield (pattern,)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("anchored_rows", udtf(AnchoredRows))
    spark.udtf.register("glob_matches", udtf(GlobMatches, returnType="pattern string"))
