"""Image formats and size estimates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stream filter names and the format names reported for them.
FORMATS = {
    "CCITTFaxDecode": "TIFF/Fax",
    "DCTDecode": "JPEG",
    "FlateDecode": "PNG/Deflate",
    "JBIG2Decode": "JBIG2",
    "JPXDecode": "JPEG2000",
    "LZWDecode": "LZW",
    "RunLengthDecode": "RLE",
}
UNKNOWN = "unknown"
SUPPORTED = tuple(FORMATS.values())


def image_format(filter_name: Column, color_space: Column | None = None) -> Column:
    """The filter's format; unlisted filters are their own; without one the colour space may say."""
    table = F.create_map(*[F.lit(x) for pair in FORMATS.items() for x in pair])
    named = F.nullif(filter_name, F.lit(""))
    rest = F.lit(UNKNOWN) if color_space is None else F.coalesce(F.nullif(color_space, F.lit("")), F.lit(UNKNOWN))
    return F.coalesce(table[named], named, rest)


def estimated_size(width: Column, height: Column, bits: Column) -> Column:
    """Three components of whole bytes a pixel; under eight bits that is nothing."""
    return (width.cast("long") * height.cast("long") * F.expr("3L") * F.floor(F.coalesce(bits, F.lit(8)) / 8)).cast("long")
