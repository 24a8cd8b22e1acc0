"""Pages of a sorted relation, by number or after a key, without a global sort in one task.

Rows are dealt by ranges of the sort keys once and written; a row for each range says how many rows and which
first keys it has.  A page reads the ranges that it overlaps, and numbers rows within these.

Defined cases: rows with equal keys are ordered by all their columns, so pages never overlap or
leave a row out; nulls come first in rising and last in falling order; a page beyond the end is
empty; a page longer than what is left is short.
"""

from __future__ import annotations

import bisect
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import remove, shared_path

RANGE = "__range"


@dataclass(frozen=True)
class Pages:
    """A relation dealt by ranges: ``table`` holds its columns and RANGE; ``starts`` is where each range begins, and the total."""

    table: DataFrame
    path: str
    order: tuple[tuple[str, bool], ...]
    starts: tuple[int, ...]

    @property
    def total(self) -> int:
        return self.starts[-1]

    def page(self, offset: int, limit: int, place: str = "place") -> DataFrame:
        """Rows offset to offset + limit, with their place in the whole."""
        if offset < 0 or limit < 0:
            raise ValueError("offset and limit must not be negative")
        first = max(bisect.bisect_right(self.starts, offset) - 1, 0)
        last = bisect.bisect_left(self.starts, offset + limit)
        inside = self.table.where(F.col(RANGE).between(first, last - 1) if last > first else F.lit(False))
        columns = [c for c in self.table.columns if c != RANGE]
        begins = F.element_at(F.array(*[F.lit(s).cast("long") for s in self.starts[first : max(last, first + 1)]]), F.col(RANGE) - first + 1)
        number = F.row_number().over(W.partitionBy(RANGE).orderBy(*_columns(self.order, columns))) - 1 + begins
        return inside.select(*[F.col(f"`{c}`") for c in columns], number.alias(place)).where((F.col(place) >= offset) & (F.col(place) < offset + limit))

    def after(self, keys: Sequence, limit: int) -> DataFrame:
        """The first rows that come after these key values, one for each sort key: a page for those who go on from a row.

        Only ranges that may hold such rows are read, as the condition is on the columns that they are dealt by.
        """
        later = F.lit(False)
        same = F.lit(True)
        for (name, rising), value in zip(self.order, keys, strict=True):
            c = F.col(f"`{name}`")
            more = (c > F.lit(value)) if rising else (c < F.lit(value))
            null_is_later = c.isNull() if not rising and value is not None else F.lit(False)
            from_null = c.isNotNull() if rising and value is None else F.lit(False)
            later = later | (same & (F.coalesce(more, F.lit(False)) | null_is_later | from_null))
            same = same & c.eqNullSafe(F.lit(value))
        columns = [c for c in self.table.columns if c != RANGE]
        return self.table.where(later).select(*[F.col(f"`{c}`") for c in columns]).orderBy(*_columns(self.order, columns)).limit(limit)

    def close(self) -> None:
        remove(self.table.sparkSession, self.path)


def _columns(order: Sequence[tuple[str, bool]], columns: Sequence[str]) -> list[Column]:
    keys = [F.col(f"`{c}`").asc() if rising else F.col(f"`{c}`").desc() for c, rising in order]
    named = {c for c, _ in order}
    return keys + [F.col(f"`{c}`").asc() for c in columns if c not in named]


def pages(df: DataFrame, order: Sequence[str | tuple[str, bool]]) -> Pages:
    """order: column names, or (name, whether rising)."""
    keys = tuple((o, True) if isinstance(o, str) else o for o in order)
    path = shared_path(df.sparkSession, "pages")
    dealt = df.repartitionByRange(*_columns(keys, df.columns)).withColumn(RANGE, F.spark_partition_id())
    dealt.write.parquet(path)
    table = df.sparkSession.read.schema(dealt.schema).parquet(path)
    counts = {r[RANGE]: r["n"] for r in table.groupBy(RANGE).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a range
    starts = (0, *accumulate(counts.get(k, 0) for k in range(max(counts, default=-1) + 1)))
    return Pages(table, path, keys, starts)
