"""Document-level relations from parsed files: images, page sizes, metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formats import estimated_size, image_format
from .elements import page_images


def images(parsed: DataFrame) -> DataFrame:
    """Images with an extent: page, pixels, format and estimated size."""
    i = page_images(parsed).where("width > 0 and height > 0")
    return i.select("path", "page_number", "image_idx", "width", "height", image_format(F.col("filter"), F.col("color_space")).alias("format"), estimated_size(F.col("width"), F.col("height"), F.col("bits")).alias("size"))


def page_info(parsed: DataFrame, inherit: bool = True) -> DataFrame:
    """Page sizes from media boxes.  Without ``inherit`` a document with a page that has no
    media box of its own is an error: one row with the message."""
    pages = parsed.where("page_number is not null")
    box = lambda k: F.element_at("media_box", k)
    out = pages.select(
        "path", F.col("page_number").alias("number"), (box(3) - box(1)).alias("width"), (box(4) - box(2)).alias("height"), "rotation",
        box(1).alias("llx"), box(2).alias("lly"), box(3).alias("urx"), box(4).alias("ury"), F.lit(None).cast("string").alias("error"),
    )
    if inherit:
        return out
    bad = pages.where("not own_media_box").groupBy(F.col("path").alias("b_path")).agg(F.min("page_number").alias("bad_page"))
    joined = out.join(bad, F.col("path") == F.col("b_path"), "left")
    message = F.format_string("failed to get info for page %d: invalid MediaBox", F.col("bad_page"))
    good = joined.where("bad_page is null").drop("b_path", "bad_page")
    null = lambda c: F.lit(None).cast("double").alias(c)
    failed = bad.select(F.col("b_path").alias("path"), F.col("bad_page").alias("number"), null("width"), null("height"), F.lit(None).cast("int").alias("rotation"), null("llx"), null("lly"), null("urx"), null("ury"), message.alias("error"))
    return good.unionByName(failed)


STANDARD = ("Title", "Author", "Subject", "Creator", "Producer", "CreationDate", "ModDate", "Keywords", "Trapped")


def metadata(parsed: DataFrame) -> DataFrame:
    """Document information, one row a document; entries of other names stay a map."""
    doc = parsed.groupBy("path").agg(F.first("info", True).alias("info"), F.max("n_pages").alias("pages"), F.first("version", True).alias("version"), F.max("encrypted").alias("encrypted"))
    get = lambda k: F.nullif(F.trim(F.element_at("info", k)), F.lit(""))
    words = F.filter(F.transform(F.split(get("Keywords"), "[,;]"), lambda w: F.trim(w)), lambda w: w != "")
    return doc.select(
        "path", get("Title").alias("title"), get("Author").alias("author"), get("Subject").alias("subject"), get("Creator").alias("creator"),
        get("Producer").alias("producer"), get("CreationDate").alias("creation_date"), get("ModDate").alias("modification_date"),
        words.alias("keywords"), "pages", "version", F.coalesce("encrypted", F.lit(False)).alias("encrypted"),
        F.map_filter("info", lambda k, v: ~k.isin(*STANDARD)).alias("custom_properties"),
    )
