"""The two encodings of boxes: corners, and origin with extent."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rectangle(llx: Column, lly: Column, urx: Column, ury: Column) -> Column:
    """Corners as struct<x, y, width, height>."""
    return F.struct(llx.alias("x"), lly.alias("y"), (urx - llx).alias("width"), (ury - lly).alias("height"))


def corners(rect: Column) -> Column:
    """struct<x, y, width, height> as struct<llx, lly, urx, ury>."""
    x, y = rect["x"], rect["y"]
    return F.struct(x.alias("llx"), y.alias("lly"), (x + rect["width"]).alias("urx"), (y + rect["height"]).alias("ury"))
